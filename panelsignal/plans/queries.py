"""Registered queries: each builds its result from the driver's tables.

Every query derives its panel (and factor series) from the whole
``lineitem`` table of the given scale (see :mod:`panelsignal.sources.fixtures`)
and runs the engine's operators on all of it.  Reported doubles are
rounded at the edge (6 decimals, 8 for small fractions) exactly as in the
matching SQL of :mod:`panelsignal.plans.oracle`.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelsignal.operators.alpha import (
    add_zscore,
    alphas_from_signal,
    forward_returns,
    prev_and_forward_lags,
    universe_filter,
    unpivot_alphas,
    wide_alphas,
)
from panelsignal.operators.evaluate import (
    cumulative_log_returns,
    factor_regression,
    forward_return_panel,
    performance_summary,
    portfolio_returns,
)
from panelsignal.operators.ic import add_cumulative_ic, add_rolling_ic, information_coefficient
from panelsignal.operators.ols import add_rolling_ols
from panelsignal.operators.factor_risk import ex_ante_gamma, ex_ante_risk, factor_names, factor_risk_solution
from panelsignal.operators.optimize import calibrate_gamma, mvo_status, mvo_weights, mvo_weights_factor_risk, wide_mvo_weights
from panelsignal.operators.signals import (
    CAPM,
    FF3,
    FF5,
    STUDY_SIGNALS,
    SignalSpec,
    add_excess_return,
    add_signals,
    join_factors,
)
from panelsignal.sources.fixtures import (
    FIXTURE_SPAN,
    covariances_from_lineitem,
    exposures_from_lineitem,
    factors_from_lineitem,
    panel_from_lineitem,
    read_table,
)
from panelsignal.plans.materialize import materialize
from panelsignal.session import scratch_path
from panelsignal.sources.io import read_alphas, read_weights, write_alphas, write_result, write_weights
from panelsignal.sources.schema import Span, load_assets, load_factors

QueryFn = Callable[[SparkSession, str], DataFrame]

# The derived test panel never prices below 18, so the universe filter is
# exercised with a bound near its 10 % quantile (the library default is 5).
PRICE_MIN = 500.0
IC = 0.05


def finish(df: DataFrame, digits: int = 6, fine: Mapping[str, int] | None = None) -> DataFrame:
    """Round doubles for reporting: ``fine`` overrides digits per column."""
    fine = dict(fine or {})
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            cols.append(F.round(F.col(f.name), fine.get(f.name, digits)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


class Fixture:
    """Lazily built inputs of one scale directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, span=FIXTURE_SPAN):
        self.spark = spark
        self.sf_dir = sf_dir
        self.span = span

    @cached_property
    def lineitem(self) -> DataFrame:
        return read_table(self.spark, self.sf_dir, "lineitem")

    @cached_property
    def style_risk(self) -> tuple[DataFrame, DataFrame]:
        return style_risk(self)

    @property
    def panel(self) -> DataFrame:
        return load_assets(panel_from_lineitem(self.lineitem), self.span)

    @property
    def factors(self) -> DataFrame:
        return load_factors(factors_from_lineitem(self.lineitem), self.span)

    def spec(self, name: str, **kw) -> SignalSpec:
        return STUDY_SIGNALS[name].with_(span=self.span, **kw)

    def signal_frame(self, spec: SignalSpec, *, exact: bool = False) -> DataFrame:
        """Asset stage: factors (if any), signal, previous price, forward return."""
        df = self.panel
        if spec.is_residual:
            df = add_excess_return(join_factors(df, self.factors, self.span))
        return add_signals(df, [spec], exact=exact, extra_lags=prev_and_forward_lags(df.columns))

    def alphas(self, spec: SignalSpec, keep=(), materialize_as: str | None = "checkpoint") -> DataFrame:
        return alphas_from_signal(
            self.signal_frame(spec),
            spec.name,
            price_min=PRICE_MIN,
            ic=IC,
            max_keys=self.span.days,
            keep=keep,
            materialize_as=materialize_as,
        )


REGISTRY: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn: Callable[[Fixture], DataFrame]):
        REGISTRY[name] = lambda spark, sf_dir: fn(Fixture(spark, sf_dir))
        REGISTRY[name].__doc__ = fn.__doc__
        return fn

    return deco


# Small fractions keep 8 decimals; prices are already rounded to 10 at the
# fixture level and are reported at that precision (re-rounding a value that
# ends in ...5 would expose HALF_UP vs. half-even differences between engines).
FRACTIONS = {
    "return": 8,
    "specific_return": 8,
    "specific_risk": 8,
    "fwd_return": 8,
    "alpha": 8,
    "price": 10,
    "prev_price": 10,
}


@register("panel_scan")
def _panel_scan(fx: Fixture) -> DataFrame:
    """S1 + P2: date-bounded panel scan with percent -> fraction scaling."""
    return finish(fx.panel, fine=FRACTIONS)


@register("factor_join_left")
def _factor_join_left(fx: Fixture) -> DataFrame:
    """Panel LEFT JOIN factors on date."""
    df = join_factors(fx.panel.select("date", "asset_id", "return"), fx.factors, fx.span)
    # reported at the fixture's own precision (no re-rounding of ...5 values)
    return finish(df, 10, fine={"return": 12})


@register("excess_return")
def _excess_return(fx: Fixture) -> DataFrame:
    """P3 + P4: return - rf and the constant regressor."""
    df = add_excess_return(join_factors(fx.panel, fx.factors, fx.span))
    return finish(df.select("date", "asset_id", "return_rf", "const"), 8)


def _signal_query(name: str):
    def q(fx: Fixture) -> DataFrame:
        spec = fx.spec(name)
        df = fx.signal_frame(spec).where(F.col(name).isNotNull())
        return finish(df.select("date", "asset_id", name))

    q.__doc__ = f"signal {name} for every panel row where it exists"
    return q


for _name in STUDY_SIGNALS:
    register(_name)(_signal_query(_name))


def _rolling_ols_query(xs: tuple[str, ...]):
    def q(fx: Fixture) -> DataFrame:
        df = add_excess_return(join_factors(fx.panel, fx.factors, fx.span))
        df = add_rolling_ols(df, "return_rf", xs, 252, prefix="B_")
        cols = ["B_const"] + [f"B_{x}" for x in xs]
        return finish(df.where(F.col("B_const").isNotNull()).select("date", "asset_id", *cols))

    q.__doc__ = f"W11: rolling 252-row OLS of excess return on const + {', '.join(xs)}"
    return q


register("rolling_ols_capm")(_rolling_ols_query(CAPM))
register("rolling_ols_ff3")(_rolling_ols_query(FF3))
register("rolling_ols_ff5")(_rolling_ols_query(FF5))


@register("ff3_momentum_strict")
def _ff3_strict(fx: Fixture) -> DataFrame:
    """C4 with warmup='strict': residual only where coefficients exist."""
    spec = fx.spec("ff3_momentum", warmup="strict")
    df = fx.signal_frame(spec).where(F.col("ff3_momentum").isNotNull())
    return finish(df.select("date", "asset_id", "ff3_momentum"))


@register("ff5_momentum_short")
def _ff5_short(fx: Fixture) -> DataFrame:
    """C4 FF5 with short windows (OLS 60, sum 40, skip 5): dense residual check."""
    spec = fx.spec("ff5_momentum", ols_window=60, lookback=40, skip=5)
    df = fx.signal_frame(spec).where(F.col("ff5_momentum").isNotNull())
    return finish(df.select("date", "asset_id", "ff5_momentum"))


@register("universe_filter")
def _universe_filter(fx: Fixture) -> DataFrame:
    """Lagged price bound + non-null signal, beta and risk."""
    df = universe_filter(fx.signal_frame(fx.spec("momentum")), "momentum", PRICE_MIN)
    return finish(df.select("date", "asset_id", "prev_price", "momentum"), fine=FRACTIONS)


@register("zscore")
def _zscore(fx: Fixture) -> DataFrame:
    """Per-date z-score of the filtered momentum signal."""
    f = universe_filter(fx.signal_frame(fx.spec("momentum")), "momentum", PRICE_MIN)
    df = add_zscore(f, "momentum", "score", max_keys=fx.span.days)
    return finish(df.select("date", "asset_id", "score"))


@register("alpha")
def _alpha(fx: Fixture) -> DataFrame:
    """Filter -> score -> alpha for momentum."""
    return finish(fx.alphas(fx.spec("momentum")), fine=FRACTIONS)


@register("forward_returns")
def _forward_returns(fx: Fixture) -> DataFrame:
    """Next row's return per asset."""
    return finish(forward_returns(fx.panel), fine=FRACTIONS)


def _ic(fx: Fixture, method: str) -> DataFrame:
    al = fx.alphas(fx.spec("momentum"), keep=("fwd_return",))
    return information_coefficient(al, method=method)


@register("ic_pearson")
def _ic_pearson(fx: Fixture) -> DataFrame:
    """Per-date Pearson IC of momentum alphas vs forward returns."""
    return finish(_ic(fx, "pearson"))


@register("ic_rank")
def _ic_rank(fx: Fixture) -> DataFrame:
    """Per-date rank IC (average ranks for ties)."""
    return finish(_ic(fx, "rank"))


@register("ic_rolling22")
def _ic_rolling22(fx: Fixture) -> DataFrame:
    """22-date rolling mean of the rank IC."""
    return finish(add_rolling_ic(_ic(fx, "rank"), 22).select("date", "ic", "ic_rolling"))


@register("ic_cumulative")
def _ic_cumulative(fx: Fixture) -> DataFrame:
    """Cumulative rank IC."""
    return finish(add_cumulative_ic(_ic(fx, "rank")).select("date", "ic", "ic_cumulative"))


# ------------------------------------------------------------ optimiser

GAMMA = 50.0
WEIGHT_DIGITS = {"weight": 10}
MVO_CONSTRAINTS = {
    "mvo_diag_none": (),
    "mvo_diag_zero_investment": ("ZeroInvestment",),
    "mvo_diag_zero_beta": ("ZeroBeta",),
    "mvo_diag_both": ("ZeroBeta", "ZeroInvestment"),
}


def momentum_weights(
    fx: Fixture, constraints=("ZeroBeta", "ZeroInvestment"), gamma: float = GAMMA, carry=()
) -> DataFrame:
    al = fx.alphas(fx.spec("momentum"), keep=("specific_risk", *carry))
    return mvo_weights(al, gamma, constraints, max_keys=fx.span.days, carry=carry)


def _mvo_query(constraints):
    def q(fx: Fixture) -> DataFrame:
        return finish(momentum_weights(fx, constraints), fine=WEIGHT_DIGITS)

    q.__doc__ = f"C6: diagonal-risk weights, constraints {list(constraints)}"
    return q


for _name, _cons in MVO_CONSTRAINTS.items():
    register(_name)(_mvo_query(_cons))


# ------------------------------------------------------------ evaluation


def momentum_portfolio(fx: Fixture) -> DataFrame:
    """Weights carry the forward return computed in the asset stage: no join."""
    w = momentum_weights(fx, carry=("fwd_return",))
    return portfolio_returns(w, ret="fwd_return")


@register("portfolio_returns")
def _portfolio_returns(fx: Fixture) -> DataFrame:
    """A1 + J3: daily return of the momentum MVO portfolio."""
    return finish(momentum_portfolio(fx), 10)


@register("cumulative_log_returns")
def _cumulative(fx: Fixture) -> DataFrame:
    """Cumulative log return (%) of the momentum portfolio."""
    return finish(cumulative_log_returns(momentum_portfolio(fx)), 6)


@register("summary")
def _summary(fx: Fixture) -> DataFrame:
    """A3: annualised mean, volatility, Sharpe."""
    return finish(performance_summary(momentum_portfolio(fx)), 8)


SUBSAMPLE = Span(dt.date(1999, 1, 1), dt.date(2000, 12, 31))


@register("subsample_summary")
def _subsample_summary(fx: Fixture) -> DataFrame:
    """Weights and returns both restricted to a sub-period, then A3."""
    w = momentum_weights(fx).where(SUBSAMPLE.where())
    returns = forward_return_panel(fx.panel.where(SUBSAMPLE.where()))
    return finish(performance_summary(portfolio_returns(w, returns)), 8)


@register("gamma_calibration")
def _gamma_calibration(fx: Fixture) -> DataFrame:
    """Gamma for 5 % annualised active risk from one gamma-50 run."""
    s = performance_summary(momentum_portfolio(fx))
    return finish(calibrate_gamma(s, GAMMA, 0.05), 8)


@register("factor_regression_capm")
def _reg_capm(fx: Fixture) -> DataFrame:
    """CAPM regression of the portfolio's daily % excess return."""
    return finish(factor_regression(momentum_portfolio(fx), fx.factors, CAPM, max_dates=fx.span.days))


@register("factor_regression_ff5")
def _reg_ff5(fx: Fixture) -> DataFrame:
    """FF5 regression with classical t-stats."""
    return finish(factor_regression(momentum_portfolio(fx), fx.factors, FF5, max_dates=fx.span.days))


# ------------------------------------------------------ all ten signals


def ten_alphas(fx: Fixture) -> DataFrame:
    """C14: all signals in one asset stage, a column each; written once as one row per (date, asset)."""
    specs = [fx.spec(n) for n in STUDY_SIGNALS]
    df = fx.panel
    if any(s.is_residual for s in specs):
        df = add_excess_return(join_factors(df, fx.factors, fx.span))
    df = add_signals(df, specs, extra_lags=prev_and_forward_lags(df.columns))
    return wide_alphas(
        df,
        list(STUDY_SIGNALS),
        price_min=PRICE_MIN,
        ic=IC,
        days=fx.span.days,
        keep=("fwd_return",),
        materialize_as="parquet",
    )


def long_alphas(fx: Fixture) -> DataFrame:
    return unpivot_alphas(ten_alphas(fx), list(STUDY_SIGNALS))


def long_weights(fx: Fixture, materialize_as: str | None = None) -> DataFrame:
    """Weights of all signals, each with its own gamma: (date, signal, asset_id, weight, fwd_return).

    ``materialize_as`` writes them once, a row per (date, asset), for a consumer that reads them twice."""
    gammas = {n: s.gamma for n, s in STUDY_SIGNALS.items()}
    wide = wide_mvo_weights(ten_alphas(fx), gammas, days=fx.span.days)
    # a weight exists where the multipliers and the alpha do
    wide = materialize(wide, materialize_as).withColumns({f"in_{n}": F.col(n).isNotNull() for n in gammas})
    return unpivot_alphas(wide, list(gammas), value="weight")


def long_portfolio(fx: Fixture) -> DataFrame:
    return portfolio_returns(long_weights(fx), by=("signal",), ret="fwd_return")


@register("all_signals_long")
def _all_signals_long(fx: Fixture) -> DataFrame:
    """C14: alphas of the ten study signals in long format."""
    return finish(long_alphas(fx).select("date", "signal", "asset_id", "alpha"), fine=FRACTIONS)


@register("portfolio_returns_by_signal")
def _port_by_signal(fx: Fixture) -> DataFrame:
    """A2: daily portfolio return per signal (each with its own gamma)."""
    return finish(long_portfolio(fx), 10)


@register("cumulative_by_signal")
def _cum_by_signal(fx: Fixture) -> DataFrame:
    """Cumulative log return per signal."""
    return finish(cumulative_log_returns(long_portfolio(fx), by=("signal",)), 6)


@register("summary_by_signal")
def _summary_by_signal(fx: Fixture) -> DataFrame:
    """A4/C11: annualised summary per signal."""
    return finish(performance_summary(long_portfolio(fx), by=("signal",)), 8)


# ------------------------------------------------------------------ IO


@register("weights_roundtrip_partitioned")
def _weights_roundtrip(fx: Fixture) -> DataFrame:
    """S6 + S3: weights written partitioned by signal/gamma/year, read back pruned."""
    root = scratch_path(fx.spark, "weights")
    write_weights(momentum_weights(fx), root, signal="momentum", gamma=GAMMA)
    back = read_weights(fx.spark, root, signals=["momentum"], gammas=[GAMMA])
    return finish(back.select("date", "asset_id", "weight"), fine=WEIGHT_DIGITS)


@register("portfolio_returns_stored_weights")
def _portfolio_stored(fx: Fixture) -> DataFrame:
    """S6 + S3 + J3 + A1: weights written partitioned, read back, LEFT JOIN forward returns."""
    root = scratch_path(fx.spark, "weights")
    write_weights(momentum_weights(fx), root, signal="momentum", gamma=GAMMA)
    w = read_weights(fx.spark, root, signals=["momentum"], gammas=[GAMMA])
    return finish(portfolio_returns(w, forward_return_panel(fx.panel)), 10)


@register("weights_by_pairs")
def _weights_by_pairs(fx: Fixture) -> DataFrame:
    """Weights of all ten signals, each with its own gamma, stored with one portfolio more; the ten read back."""
    root = scratch_path(fx.spark, "weights")
    gammas = [(n, s.gamma) for n, s in STUDY_SIGNALS.items()]
    # ranges are drawn from a sample, which would compute every weight once more
    w = long_weights(fx, "parquet").select("date", "signal", "asset_id", "weight")
    gamma = F.element_at(F.create_map(*[F.lit(x) for n, g in gammas for x in (n, float(g))]), F.col("signal"))
    own = (F.col("signal") == "momentum") & (gamma != 60.0)
    # the stray portfolio has a signal and a gamma that others are asked for
    stray = F.when(own, F.array(gamma, F.lit(60.0))).otherwise(F.array(gamma))
    write_weights(w.withColumn("gamma", F.explode(stray)), root)
    back = read_weights(fx.spark, root, pairs=gammas)
    return finish(back.select("date", "signal", "asset_id", "weight"), 8)


@register("panel_scan_universe")
def _panel_scan_universe(fx: Fixture) -> DataFrame:
    """The panel's rows inside the universe flag, with a column list."""
    source = panel_from_lineitem(fx.lineitem).withColumn("in_universe", F.col("price") >= PRICE_MIN)
    columns = ["date", "asset_id", "price", "return"]
    return finish(load_assets(source, fx.span, columns, in_universe="in_universe"), fine=FRACTIONS)


@register("summary_roundtrip")
def _summary_roundtrip(fx: Fixture) -> DataFrame:
    """The per-signal summary written as a result table and read back."""
    path = scratch_path(fx.spark, "summary")
    write_result(performance_summary(long_portfolio(fx), by=("signal",)), path)
    return finish(fx.spark.read.parquet(path), 8)


@register("factor_regression_ff5_by_signal")
def _reg_ff5_by_signal(fx: Fixture) -> DataFrame:
    """A5/C10 for all ten signals: FF5 regression of each portfolio with classical t-stats."""
    return finish(factor_regression(long_portfolio(fx), fx.factors, FF5, by=("signal",), max_dates=fx.span.days))


@register("distinct_years")
def _distinct_years(fx: Fixture) -> DataFrame:
    """Distinct years present in the alphas."""
    al = fx.alphas(fx.spec("momentum"))
    return al.select(F.year("date").alias("year")).distinct()


# ------------------------------------------------------ factor-risk MVO

# Fixed values of the test risk model: diagonal factor variances.
FACTOR_VARIANCE = {
    "size": 0.0004,
    "activity": 0.0001,
    "discount": 0.0001,
    "region_0": 0.0002,
    "region_1": 0.0002,
    "region_2": 0.0002,
    "region_3": 0.0002,
    "region_4": 0.0002,
}


@register("mvo_factor_risk")
def _mvo_factor_risk(fx: Fixture) -> DataFrame:
    """C6 with factor risk S = X F X' + D (Woodbury, per-date K x K solve).

    Checked against a dense per-date KKT solve in tests (no SQL oracle).
    """
    al = fx.alphas(fx.spec("momentum"), keep=("specific_risk",))
    exposures = exposures_from_lineitem(
        fx.lineitem,
        read_table(fx.spark, fx.sf_dir, "supplier"),
        read_table(fx.spark, fx.sf_dir, "nation"),
    ).where(fx.span.where())
    w = mvo_weights_factor_risk(al, exposures, FACTOR_VARIANCE, GAMMA, max_keys=fx.span.days)
    return finish(w, fine=WEIGHT_DIGITS)


STYLES = ("size", "activity", "discount")


def style_risk(fx: Fixture) -> tuple[DataFrame, DataFrame]:
    """Style exposures, and a full covariance matrix of the styles per date."""
    nation, supplier = (read_table(fx.spark, fx.sf_dir, t) for t in ("nation", "supplier"))
    exposures = exposures_from_lineitem(fx.lineitem, supplier, nation).where(F.col("factor").isin(*STYLES) & fx.span.where())
    # the solution, the weights and the risk each read them
    return materialize(exposures, "parquet"), covariances_from_lineitem(fx.lineitem).where(fx.span.where())


def style_weights(fx: Fixture, carry=()) -> DataFrame:
    al = fx.alphas(fx.spec("momentum"), keep=("specific_risk",))
    return mvo_weights_factor_risk(al, *fx.style_risk, GAMMA, max_keys=fx.span.days, carry=carry)


@register("mvo_factor_risk_full")
def _mvo_factor_risk_full(fx: Fixture) -> DataFrame:
    """C6 with S = X F X' + D, F a full matrix of its own on every date."""
    return finish(style_weights(fx), 8)


@register("mvo_factor_risk_status")
def _mvo_factor_risk_status(fx: Fixture) -> DataFrame:
    """What became of every date where a third of them has no covariance, or one that is no covariance."""
    al = fx.alphas(fx.spec("momentum"), keep=("specific_risk",))
    exposures, f = style_risk(fx)
    day = F.pmod(F.unix_date("date"), F.lit(6))
    broken = (F.col("factor_i") == "size") & (F.col("factor_j") == "size") & (day == 1)
    f = f.where(day != 0).withColumn("value", F.when(broken, -F.col("value")).otherwise(F.col("value")))
    return factor_risk_solution(al, exposures, f, factors=factor_names(f)).select("date", "n_assets", "status")


@register("mvo_status_dirty")
def _mvo_status_dirty(fx: Fixture) -> DataFrame:
    """C6, diagonal risk: rows, usable rows and status of every date of a panel with bad fields."""
    panel = load_assets(dirty(panel_from_lineitem(fx.lineitem)), fx.span)
    alphas = panel.withColumn("alpha", F.col("return") * F.col("specific_risk"))
    return mvo_status(alphas)


@register("ex_ante_risk_full")
def _ex_ante_risk_full(fx: Fixture) -> DataFrame:
    """C13 before the fact: w'(XFX' + D)w per date of the factor-risk weights, annualised."""
    risk = ex_ante_risk(style_weights(fx, carry=("specific_risk",)), *fx.style_risk)
    return finish(risk.select("date", "active_risk"), 7)


@register("gamma_ex_ante")
def _gamma_ex_ante(fx: Fixture) -> DataFrame:
    """C13 before the fact: per date the gamma for 5 % active risk under diagonal risk."""
    al = fx.alphas(fx.spec("momentum"), keep=("specific_risk",))
    w = mvo_weights(al, GAMMA, max_keys=fx.span.days, carry=("specific_risk",))
    return finish(ex_ante_gamma(ex_ante_risk(w), GAMMA), 6)


@register("gamma_ex_ante_by_signal")
def _gamma_ex_ante_by_signal(fx: Fixture) -> DataFrame:
    """C13 before the fact for all ten signals: mean active risk, and gamma for 5 % per unit of the one used."""
    risk = ex_ante_risk(long_weights(fx), by=("signal",))
    return finish(ex_ante_gamma(risk, 1.0, by=("signal",)), 6)


# ------------------------------------------------------- IC per signal


def _ic_by_signal(fx: Fixture, method: str) -> DataFrame:
    return information_coefficient(long_alphas(fx), method=method, keys=("date", "signal"))


@register("ic_rolling_by_signal")
def _ic_rolling_by_signal(fx: Fixture) -> DataFrame:
    """W12 for all ten signals: 22-date rolling mean of the rank IC."""
    ics = add_rolling_ic(_ic_by_signal(fx, "rank"), 22, by=("signal",))
    return finish(ics.select("date", "signal", "ic", "ic_rolling"))


@register("ic_cumulative_by_signal")
def _ic_cumulative_by_signal(fx: Fixture) -> DataFrame:
    """W13 for all ten signals: cumulative rank IC."""
    ics = add_cumulative_ic(_ic_by_signal(fx, "rank"), by=("signal",))
    return finish(ics.select("date", "signal", "ic", "ic_cumulative"))


@register("ic_rank_stored_alphas")
def _ic_rank_stored(fx: Fixture) -> DataFrame:
    """S4 + J5 + A7: alphas of two signals stored, one read back for a date range, joined to forward returns."""
    root = scratch_path(fx.spark, "alphas")
    for name in ("momentum", "barra_momentum"):
        write_alphas(fx.alphas(fx.spec(name)), root, signal=name)
    back = read_alphas(fx.spark, root, ["momentum"], SUBSAMPLE.start, SUBSAMPLE.end)
    return finish(information_coefficient(back, forward_returns(fx.panel)))


@register("gamma_calibration_by_signal")
def _gamma_by_signal(fx: Fixture) -> DataFrame:
    """C13 per signal: the gamma-50 equivalent for 5 % active risk, ordered by signal (O3)."""
    s = performance_summary(long_portfolio(fx), by=("signal",))
    return finish(calibrate_gamma(s, GAMMA, 0.05, by=("signal",)), 8).orderBy("signal")


@register("factor_regression_capm_by_signal")
def _reg_capm_by_signal(fx: Fixture) -> DataFrame:
    """A6/C10 for all ten signals: CAPM regression of each portfolio's daily % excess return."""
    port = long_portfolio(fx)
    return finish(factor_regression(port, fx.factors, CAPM, by=("signal",), max_dates=fx.span.days))


@register("mvo_diag_both_dirty")
def _mvo_dirty(fx: Fixture) -> DataFrame:
    """P7-P9 + C6 on a panel with NaN, infinite and NULL fields by a fixed rule on each row's date and asset."""
    panel = load_assets(dirty(panel_from_lineitem(fx.lineitem)), fx.span)
    df = add_signals(panel, [fx.spec("momentum")], extra_lags=prev_and_forward_lags(panel.columns))
    al = alphas_from_signal(
        df, "momentum", price_min=PRICE_MIN, ic=IC, max_keys=fx.span.days, keep=("specific_risk",), materialize_as="checkpoint"
    )
    w = mvo_weights(al, GAMMA, max_keys=fx.span.days)
    return finish(w, 7)


def dirty(panel: DataFrame) -> DataFrame:
    """Every 97th (date, asset) gets a bad field: NaN, infinity or NULL by turns."""
    k = F.datediff("date", F.lit("1970-01-01").cast("date")) + F.col("asset_id") * 7
    hit = lambda r: F.pmod(k, F.lit(97)) == r
    nan, inf, null = (F.lit(x).cast("double") for x in ("NaN", "Infinity", None))
    return panel.withColumns(
        {
            "price": F.when(hit(0), nan).when(hit(1), null).otherwise(F.col("price")),
            "predicted_beta": F.when(hit(2), nan).when(hit(3), null).otherwise(F.col("predicted_beta")),
            "specific_risk": F.when(hit(4), nan).when(hit(5), inf).when(hit(6), null).otherwise(F.col("specific_risk")),
            "return": F.when(F.pmod(k, F.lit(9973)) == 7, nan).otherwise(F.col("return")),
        }
    )


@register("ic_rank_by_signal")
def _ic_rank_by_signal(fx: Fixture) -> DataFrame:
    """C8 for all ten signals at once: rank IC per (date, signal)."""
    return finish(_ic_by_signal(fx, "rank"))


@register("ic_pearson_by_signal")
def _ic_pearson_by_signal(fx: Fixture) -> DataFrame:
    """C8 for all ten signals at once: Pearson IC per (date, signal)."""
    return finish(_ic_by_signal(fx, "pearson"))


@register("alphas_roundtrip_partitioned")
def _alphas_roundtrip(fx: Fixture) -> DataFrame:
    """S5 + S4: alphas of two signals written partitioned by signal, one read back pruned."""
    root = scratch_path(fx.spark, "alphas")
    write_alphas(fx.alphas(fx.spec("momentum")), root, signal="momentum")
    write_alphas(fx.alphas(fx.spec("barra_momentum")), root, signal="barra_momentum")
    back = read_alphas(fx.spark, root, ["momentum"])
    return finish(back.select("date", "asset_id", "alpha", "predicted_beta"), fine=FRACTIONS)


@register("subsample_summary_by_signal")
def _subsample_by_signal(fx: Fixture) -> DataFrame:
    """C11 + C12: per-signal summary with weights and returns restricted to a sub-period."""
    w = long_weights(fx)
    w = w.where(SUBSAMPLE.where())
    returns = forward_return_panel(fx.panel.where(SUBSAMPLE.where()))
    return finish(performance_summary(portfolio_returns(w, returns, by=("signal",)), by=("signal",)), 8)
