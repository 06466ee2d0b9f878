"""Backtest evaluation (C9-C12): portfolio returns, cumulative log returns,
annualised summary, factor regression, multi-signal comparison.

Portfolio returns reduce the (date, asset) weights to one row per date
(and signal) with a partial aggregation; everything after that works on
series bounded by the calendar (one row per date per signal).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelsignal.functions.columns import log1p_or_null, safe_div
from panelsignal.operators.ols import grouped_ols, simple_regression
from panelsignal.operators.windows import ASSET, DATE, add_lags

TRADING_DAYS = 252


def forward_return_panel(
    panel: DataFrame, ret: str = "return", out: str = "forward_return"
) -> DataFrame:
    """Next row's return per asset, kept for every row (NULL at the end)."""
    return add_lags(panel.select(DATE, ASSET, ret), {out: (ret, -1)}).select(DATE, ASSET, out)


def portfolio_returns(
    weights: DataFrame,
    returns: DataFrame | None = None,
    *,
    by: Sequence[str] = (),
    weight: str = "weight",
    ret: str = "forward_return",
) -> DataFrame:
    """A1/A2 + J3: sum(weight x forward return) per date (and ``by``).

    With ``returns`` the weights are LEFT JOINed to the forward returns on
    (date, asset) (J3: e.g. weights read back from storage).  Without it,
    ``ret`` is a column of ``weights`` (the forward return carried from the
    asset stage), and no join is needed.  Weights without a return
    contribute nothing; a date whose products are all missing gets 0.0
    (the empty-sum convention of the reference).
    """
    if returns is None:
        j = weights
    else:
        j = weights.join(returns.select(DATE, ASSET, ret), on=[DATE, ASSET], how="left")
    return j.groupBy(DATE, *by).agg(
        F.coalesce(F.sum(F.col(weight) * F.col(ret)), F.lit(0.0)).alias("return")
    )


def cumulative_log_returns(port: DataFrame, *, by: Sequence[str] = (), ret: str = "return") -> DataFrame:
    """100 x running sum of log(1 + r) in date order (per ``by``)."""
    w = Window.partitionBy(*by).orderBy(DATE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return port.select(
        DATE, *by, (F.sum(log1p_or_null(ret)).over(w) * F.lit(100.0)).alias("cumulative_return")
    )


def performance_summary(port: DataFrame, *, by: Sequence[str] = (), ret: str = "return") -> DataFrame:
    """A3/A4: annualised mean, volatility (ddof 1) and their ratio."""
    g = port.groupBy(*by) if by else port.groupBy()
    s = g.agg(
        (F.avg(ret) * F.lit(float(TRADING_DAYS))).alias("mean_return"),
        (F.stddev_samp(ret) * F.lit(math.sqrt(TRADING_DAYS))).alias("volatility"),
    )
    return s.withColumn("sharpe", safe_div(F.col("mean_return"), F.col("volatility")))


def shift_factors(factors: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every factor column (rf included) moved one factor date earlier.

    Aligns the factor returns of the next date with a forward portfolio
    return; done on the factor series *before* joining, so the shift
    follows the factor calendar.  The series has one row per date.
    """
    w = Window.orderBy(DATE)
    return factors.select(DATE, *[F.lead(c, 1).over(w).alias(c) for c in columns])


def factor_regression(
    port: DataFrame,
    factors: DataFrame,
    regressors: Sequence[str],
    *,
    by: Sequence[str] = (),
    rf: str = "rf",
    max_dates: int | None = None,
) -> DataFrame:
    """OLS of 100 x (return - rf) on 100 x the shifted factors, with t-stats.

    Output: by..., variable, coefficient, tstat (variable 'Intercept' first).
    """
    from panelsignal.plans.joins import bounded_broadcast

    shifted = shift_factors(factors, [*regressors, rf])
    data = port.join(bounded_broadcast(shifted, max_dates), on=DATE, how="left")
    data = data.where(F.col("return").isNotNull())
    data = data.select(
        *by,
        ((F.col("return") - F.col(rf)) * F.lit(100.0)).alias("return_rf"),
        *[(F.col(c) * F.lit(100.0)).alias(c) for c in regressors],
    )
    if len(regressors) == 1:
        return simple_regression(data, "return_rf", regressors[0], keys=by)
    return grouped_ols(data, "return_rf", regressors, keys=by)
