"""Signal definitions (C1-C4, C14, X1) as DataFrame -> DataFrame transforms.

A signal is declared by a :class:`SignalSpec`; :func:`add_signals`
stages the window columns the given signals need on the per-asset window.
Windows cannot nest inside one Spark expression, so the work is staged:
(1) the rolling cross-product sums of every distinct regression, in one
pass; (2) all regression solves, side by side in projections; (3) the
residuals; (4) every signal's rolling sums in one pass; (5) every skip-lag (plus previous price
and forward return) in one Window operator.  All stages share
``partitionBy(asset)``: one exchange, whatever the number of signals.  With a regression
among them all of it is one pass over the sorted rows in numpy (:mod:`panelsignal.operators.series`).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsignal.functions.columns import finite_or_null, log1p_or_null, safe_div
from panelsignal.operators.ols import add_residual, add_rolling_regressions, rolling_regression
from panelsignal.operators.series import add_series_signals
from panelsignal.operators.windows import (
    ASSET,
    DATE,
    _tmp,
    add_lags,
    add_rolling_std,
    add_rolling_sums,
    add_rolling_totals,
    anchor_column,
    deviation_series,
    std_from_totals,
    with_sql,
)
from panelsignal.plans.joins import bounded_broadcast
from panelsignal.sources.schema import Span


@dataclass(frozen=True)
class SignalSpec:
    name: str
    series: str = "return"  # "return", "specific_return" or "residual"
    factors: tuple[str, ...] = ()  # regressors besides the intercept
    lookback: int = 230
    skip: int = 21
    vol_window: int | None = None  # rolling std window of the simple series
    gamma: float = 50.0
    span: Span = field(default_factory=Span)
    ols_window: int = 252
    warmup: str = "raw_excess"

    @property
    def is_residual(self) -> bool:
        return self.series == "residual"

    def with_(self, **kw) -> "SignalSpec":
        return replace(self, **kw)


# The ten signals of the reference study (name, input series,
# regressors, rolling-sum window, volatility scaling, gamma, start date).
# End date 2024-12-31, price filter 5, IC 0.05, OLS window 252 for all.
_END = dt.date(2024, 12, 31)
_S96 = Span(dt.date(1996, 1, 1), _END)
_S96J = Span(dt.date(1996, 6, 1), _END)
CAPM = ("mkt_rf",)
FF3 = ("mkt_rf", "smb", "hml")
FF5 = ("mkt_rf", "smb", "hml", "rmw", "cma")
STUDY_SIGNALS: dict[str, SignalSpec] = {
    s.name: s
    for s in [
        SignalSpec("momentum", "return", (), 230, 21, None, 50, _S96),
        SignalSpec("vol_scaled_momentum", "return", (), 230, 21, 230, 50, _S96),
        SignalSpec("ff3_momentum", "residual", FF3, 230, 21, None, 60, _S96J),
        SignalSpec("ff5_momentum", "residual", FF5, 230, 21, None, 60, _S96J),
        SignalSpec("barra_momentum", "specific_return", (), 230, 21, None, 50, _S96),
        SignalSpec("vol_scaled_barra_momentum", "specific_return", (), 230, 21, 230, 43, _S96),
        SignalSpec("vol_scaled_ff3_momentum", "residual", FF3, 230, 21, 230, 60, _S96J),
        SignalSpec("vol_scaled_ff5_momentum", "residual", FF5, 230, 21, 230, 60, _S96J),
        SignalSpec("capm_momentum", "residual", CAPM, 232, 21, None, 60, _S96),
        SignalSpec("vol_scaled_capm_momentum", "residual", CAPM, 230, 21, 230, 60, _S96J),
    ]
}
PRICE_FILTER = 5.0
IC = 0.05
CONSTRAINTS = ("ZeroBeta", "ZeroInvestment")


def join_factors(panel: DataFrame, factors: DataFrame, span: Span = Span()) -> DataFrame:
    """Panel LEFT JOIN factors on date (unmatched dates keep NULL factors).

    The factor table has one row per date, so its size is bounded by the
    calendar days of ``span``; it is broadcast when that bound fits.
    """
    return panel.join(bounded_broadcast(factors, span.days), on=DATE, how="left")


def add_excess_return(df: DataFrame, ret: str = "return", rf: str = "rf", out: str = "return_rf") -> DataFrame:
    """Excess return and a constant regressor column."""
    return df.withColumns({out: F.col(ret) - F.col(rf), "const": F.lit(1.0)})


def add_momentum(
    df: DataFrame,
    series: str,
    out: str,
    *,
    lookback: int = 230,
    skip: int = 21,
    vol_window: int | None = None,
    key: str = ASSET,
    order: str = DATE,
    by: Sequence[str] = (),
    exact: bool = False,
) -> DataFrame:
    """W1 (+W3) + W4: ``lag(sum(log1p(x)) over lookback [/ std(x) over vol_window], skip)``."""
    rs = _tmp("rs")
    df = add_rolling_sums(
        df,
        {rs: log1p_or_null(finite_or_null(series))},
        lookback,
        key=key,
        order=order,
        by=by,
        exact=exact,
        finite=True,
    )
    value = F.col(rs)
    temps = [rs]
    if vol_window:
        sd = _tmp("sd")
        df = add_rolling_std(df, series, vol_window, sd, key=key, order=order, by=by, exact=exact)
        value = safe_div(value, F.col(sd))
        temps.append(sd)
    df = add_lags(df, {out: (value, skip)}, key=key, order=order, by=by)
    return df.drop(*temps)


def add_signals(
    df: DataFrame,
    specs: Sequence[SignalSpec],
    *,
    exact: bool = False,
    keep_intermediate: bool = False,
    extra_lags: dict | None = None,
) -> DataFrame:
    """Add one column per spec (named ``spec.name``) in a single asset stage.

    ``extra_lags`` (``out -> (column, k)``, see :func:`add_lags`) are added
    in the same Window operator as the signals' skip-lags.

    Residual signals that share a regression (same regressors, window and
    warm-up) share its rolling sums and solve: e.g. ``ff3_momentum`` and
    ``vol_scaled_ff3_momentum`` run one FF3 regression.  Residual signals
    need ``return_rf`` and the factor columns (:func:`join_factors`,
    :func:`add_excess_return`).

    With a residual signal among them the stage runs in numpy over rows dealt and sorted by asset
    (:mod:`panelsignal.operators.series`); ``exact`` and ``keep_intermediate`` keep the window operators,
    as do signals without a regression.
    """
    if any(s.is_residual for s in specs) and not exact and not (keep_intermediate and len(specs) == 1):
        return add_series_signals(df, specs, lags=extra_lags)
    residuals: dict[tuple, str] = {}
    drop: list[str] = []
    regressions, made = [], []
    for spec in specs:
        if not spec.is_residual:
            continue
        key = (tuple(spec.factors), spec.ols_window, spec.warmup)
        if key in residuals:
            continue
        # keep_intermediate exposes B_* and residual for a single spec
        single = keep_intermediate and len(specs) == 1
        prefix = "B_" if single else f"__B{len(residuals)}_"
        name = "residual" if single else _tmp(f"res{len(residuals)}")
        residuals[key] = name
        regressions.append(rolling_regression("return_rf", spec.factors, spec.ols_window, prefix=prefix))
        made.append((spec, prefix, name))
    if regressions:
        df = add_rolling_regressions(df, regressions, exact=exact)
    for spec, prefix, name in made:
        df = add_residual(df, "return_rf", spec.factors, name, prefix=prefix, warmup=spec.warmup)
        if not (keep_intermediate and len(specs) == 1):
            drop += [f"{prefix}const"] + [f"{prefix}{x}" for x in spec.factors] + [name]
    # every signal's rolling sum and deviation in one pass, then every skip-lag in one Window operator
    source = {}
    for spec in specs:
        source[spec.name] = residuals[(tuple(spec.factors), spec.ols_window, spec.warmup)] if spec.is_residual else spec.series
    clean = {c: _tmp("v") for c in dict.fromkeys(source.values())}
    df = df.withColumns({v: finite_or_null(c) for c, v in clean.items()})
    scaled = dict.fromkeys(clean[source[s.name]] for s in specs if s.vol_window)
    anchor = {v: _tmp("anchor") for v in scaled}
    if anchor and not exact:
        df = df.withColumns({a: anchor_column(v) for v, a in anchor.items()})
    logs = {v: _tmp("log") for v in clean.values()}
    df = df.withColumns({c: log1p_or_null(F.col(v)) for v, c in logs.items()})
    series, wanted, value, temps = {}, {}, {}, []
    for spec in specs:
        v = clean[source[spec.name]]
        series |= {f"l {v}": f"coalesce({logs[v]}, 0D)", f"ln {v}": f"CASE WHEN {logs[v]} IS NULL THEN 0 ELSE 1 END"}
        total, count = _tmp("sum"), _tmp("n")
        wanted |= {total: (f"l {v}", spec.lookback), count: (f"ln {v}", spec.lookback)}
        value[spec.name] = f"CASE WHEN {count} = {spec.lookback} THEN {total} END"
        if not spec.vol_window:
            continue
        if exact:
            sd = _tmp("sd")
            df = add_rolling_std(df, v, spec.vol_window, sd, exact=True)
            temps.append(sd)
        else:
            parts = deviation_series(v, anchor[v])
            series |= parts
            names = {x: _tmp("dev") for x in parts}
            wanted |= {names[x]: (x, spec.vol_window) for x in parts}
            sd = std_from_totals(spec.vol_window, *names.values())
        value[spec.name] = f"try_divide({value[spec.name]}, {sd})"
    if specs:
        df = add_rolling_totals(df, series, wanted, exact=exact)
    ready = {n: _tmp("ready") for n in value}
    df = with_sql(df, {ready[n]: v for n, v in value.items()})
    df = df.drop(*wanted, *temps, *clean.values(), *logs.values(), *anchor.values(), *drop)
    lags = {spec.name: (ready[spec.name], spec.skip) for spec in specs}
    return add_lags(df, lags | (extra_lags or {})).drop(*ready.values())


def add_signal(
    df: DataFrame,
    spec: SignalSpec,
    *,
    out: str | None = None,
    exact: bool = False,
    keep_intermediate: bool = False,
) -> DataFrame:
    """Add the signal column ``out`` (default ``spec.name``)."""
    if out and out != spec.name:
        spec = spec.with_(name=out)
    return add_signals(df, [spec], exact=exact, keep_intermediate=keep_intermediate)


def to_long(
    df: DataFrame,
    signals: Sequence[str],
    ids: Sequence[str],
    *,
    name: str = "signal",
    value: str = "value",
) -> DataFrame:
    """Unpivot signal columns into (ids..., signal, value) rows (no shuffle)."""
    return df.unpivot(list(ids), list(signals), name, value)
