"""Universe filter, cross-sectional z-score, alpha and forward returns.

Plan shape: the per-asset quantities (signal, previous price, forward
return) are columns of one asset-partitioned window stage.  The
cross-sectional mean and standard deviation are a ``groupBy(date)``
with map-side partial aggregation whose one-row-per-date result is
broadcast back (bounded by the calendar days of the span), so the panel
itself is never shuffled by date and a wide date is never one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsignal.functions.columns import finite_or_null, safe_div
from panelsignal.operators.windows import ASSET, DATE, _tmp, add_lags, cross_section_stats
from panelsignal.plans.joins import join_per_key
from panelsignal.plans.materialize import materialize


def prev_and_forward_lags(
    columns: Sequence[str],
    *,
    price: str = "price",
    ret: str = "return",
    prev_out: str = "prev_price",
    fwd_out: str = "fwd_return",
) -> dict:
    """The W5/W6 lag specs for :func:`add_lags` (or ``add_signals(extra_lags=...)``)."""
    lags = {}
    if price in columns:
        lags[prev_out] = (price, 1)
    if ret in columns:
        lags[fwd_out] = (ret, -1)
    return lags


def add_prev_and_forward(
    df: DataFrame,
    *,
    price: str = "price",
    ret: str = "return",
    prev_out: str = "prev_price",
    fwd_out: str = "fwd_return",
    key: str = ASSET,
    by: Sequence[str] = (),
) -> DataFrame:
    """W5 + W6: previous row's price and next row's return of the same asset."""
    lags = {}
    if price in df.columns:
        lags[prev_out] = (price, 1)
    if ret in df.columns:
        lags[fwd_out] = (ret, -1)
    return add_lags(df, lags, key=key, by=by)


def universe_filter(
    df: DataFrame,
    signal: str,
    price_min: float = 5.0,
    *,
    prev_price: str = "prev_price",
    required: Sequence[str] = ("predicted_beta", "specific_risk"),
) -> DataFrame:
    """Previous price strictly above the bound and required fields present.

    All predicates refer to columns staged on the unfiltered panel (the
    lagged price in particular), then one conjunctive filter is applied.
    """
    return df.where(universe_condition(signal, price_min, prev_price=prev_price, required=required))


def universe_condition(
    signal: str,
    price_min: float = 5.0,
    *,
    prev_price: str = "prev_price",
    required: Sequence[str] = ("predicted_beta", "specific_risk"),
) -> Column:
    """The filter's predicate; a NaN or infinite value counts as missing."""
    cond = finite_or_null(prev_price) > F.lit(float(price_min))
    for c in (signal, *required):
        cond = cond & finite_or_null(c).isNotNull()
    return cond


def add_zscore(
    df: DataFrame,
    value: str,
    out: str = "score",
    *,
    keys: Sequence[str] = (DATE,),
    max_keys: int | None = None,
) -> DataFrame:
    """(x - mean) / std (ddof 1) within each key group; NULL when undefined.

    ``max_keys`` is the proven bound on the number of key groups (e.g.
    calendar days x signals); the per-key statistics are broadcast only
    when that bound fits.
    """
    m, s = _tmp("mean"), _tmp("std")
    stats = cross_section_stats(df, value, keys=keys).select(
        *keys, F.col("mean").alias(m), F.col("std").alias(s)
    )
    df = join_per_key(df, stats, on=list(keys), how="inner", max_rows=max_keys)
    return df.withColumn(out, safe_div(F.col(value) - F.col(m), F.col(s))).drop(m, s)


def add_alpha(
    df: DataFrame,
    score: str = "score",
    ic: float = 0.05,
    risk: str = "specific_risk",
    out: str = "alpha",
) -> DataFrame:
    """alpha = score x IC x specific risk."""
    return df.withColumn(out, F.col(score) * F.lit(float(ic)) * F.col(risk))


def alphas_from_signal(
    df: DataFrame,
    signal: str,
    *,
    price_min: float = 5.0,
    ic: float = 0.05,
    keys: Sequence[str] = (DATE,),
    max_keys: int | None = None,
    keep: Sequence[str] = (),
    materialize_as: str | None = None,
) -> DataFrame:
    """Universe filter -> score -> alpha.

    Output: date, asset_id, alpha, predicted_beta (+ ``keep`` columns).
    Rows of a single-asset date keep a NULL alpha, as in the reference.
    ``materialize_as='checkpoint'`` writes the filtered asset-stage rows
    once so the per-date consumers downstream do not recompute the windows.
    """
    extra_keys = [k for k in keys if k != DATE]
    f = universe_filter(df, signal, price_min)
    if materialize_as:
        cols = [DATE, *extra_keys, ASSET, signal, "predicted_beta", "specific_risk", *keep]
        f = materialize(f.select(*dict.fromkeys(cols)), materialize_as)
    z = add_zscore(f, signal, "score", keys=keys, max_keys=max_keys)
    a = add_alpha(z, "score", ic)
    return a.select(DATE, *extra_keys, ASSET, "alpha", "predicted_beta", *keep)


def wide_alphas(
    df: DataFrame,
    signals: Sequence[str],
    *,
    price_min: float = 5.0,
    ic: float = 0.05,
    days: int | None = None,
    keep: Sequence[str] = (),
    materialize_as: str | None = None,
) -> DataFrame:
    """C14: the alphas of several signals, a column each, one row per (date, asset).

    Every signal's mean and deviation is a column of one row per date, so the
    table that is broadcast back has as many rows as the span has ``days``
    whatever the number of signals.  A row that a signal's universe filter
    rejects is not in its ``in_<signal>``.
    """
    inside = {s: universe_condition(s, price_min) for s in signals}
    rows = df.select(
        DATE,
        ASSET,
        "predicted_beta",
        "specific_risk",
        *[k for k in keep if k not in ("predicted_beta", "specific_risk")],
        *[F.when(inside[s], F.col(s)).alias(s) for s in signals],
    ).where(F.coalesce(*signals).isNotNull())
    if materialize_as:
        rows = materialize(rows, materialize_as)
    stats = rows.groupBy(DATE).agg(
        *[F.avg(s).alias(f"__m_{s}") for s in signals], *[F.stddev_samp(s).alias(f"__s_{s}") for s in signals]
    )
    joined = join_per_key(rows, stats, on=[DATE], how="inner", max_rows=days)
    score = {s: safe_div(F.col(s) - F.col(f"__m_{s}"), F.col(f"__s_{s}")) for s in signals}
    return joined.select(
        *rows.columns[: -len(signals)],
        *[(score[s] * F.lit(float(ic)) * F.col("specific_risk")).alias(s) for s in signals],
        *[F.col(s).isNotNull().alias(f"in_{s}") for s in signals],
    )


def unpivot_alphas(wide: DataFrame, signals: Sequence[str], value: str = "alpha") -> DataFrame:
    """:func:`wide_alphas` as (date, signal, asset_id, ``value``, ...) rows; no shuffle."""
    ids = [c for c in wide.columns if c not in signals and c not in {f"in_{s}" for s in signals}]
    rows = F.array(
        *[F.struct(F.lit(s).alias("signal"), F.col(s).alias(value), F.col(f"in_{s}").alias("inside")) for s in signals]
    )
    # filtered as rows: a lambda over the array is interpreted, element by element
    return wide.select(*ids, F.inline(rows)).where("inside").drop("inside")


def forward_returns(panel: DataFrame, ret: str = "return", out: str = "fwd_return") -> DataFrame:
    """Next row's return per asset, rows without one dropped."""
    df = add_lags(panel.select(DATE, ASSET, ret), {out: (ret, -1)})
    return df.where(F.col(out).isNotNull()).select(DATE, ASSET, out)
