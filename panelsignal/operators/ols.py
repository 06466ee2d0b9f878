"""Regressions: rolling multivariate OLS per series (W11), residuals (P13),
and full-sample OLS with classical t-statistics (A5, A6).

Rolling OLS is built from rolling cross-product sums with one shared count
guard.  The centred, standardised k x k normal equations are then solved by
Gauss-Jordan elimination written out as Column expressions, one projection a
pivot (:func:`solve_rolling_ols`): nothing leaves the JVM, and the asset
partitioning of the windows before holds for the windows after.  The steps of several
regressions share projections.  A constant regressor or a pivot within
rounding of zero yields NULL coefficients instead of failing the task.  Only
the full-sample regressions' small solves run in Python; their functions are shipped to the workers
by value: executors need numpy and pandas only.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelsignal.functions.columns import finite_or_null, safe_div, sum_skip_nulls
from panelsignal.operators.windows import ASSET, DATE, _tmp, add_rolling_totals, quoted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CONST = "const"
# centred sum of squares below this fraction of the raw one = constant regressor
REL_VAR_TOL = 1e-10


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _coef_fields(xs: Sequence[str], prefix: str) -> list[str]:
    return [f"{prefix}{CONST}"] + [f"{prefix}{x}" for x in xs]


@dataclass(frozen=True)
class RollingRegression:
    """One rolling regression: its cleaned inputs, its series to be summed, and the names of the sums."""

    xs: tuple[str, ...]
    window: int
    prefix: str
    clean: dict[str, Column]
    series: dict[str, str]
    wanted: dict[str, tuple[str, int]]
    names: dict[str, str]
    cond_max: float

    @property
    def fields(self) -> list[str]:
        return _coef_fields(self.xs, self.prefix)


def rolling_regression(
    y: str, xs: Sequence[str], window: int, *, prefix: str = "B_", cond_max: float = 1e10
) -> RollingRegression:
    """The expressions of one regression.  A row counts only if y and every x are present and finite."""
    k = len(xs)
    if k < 1:
        raise ValueError("need at least one regressor")
    y_, x_, ok = _tmp("y"), [_tmp(f"x{i}") for i in range(k)], _tmp("ok")
    clean = {y_: finite_or_null(y), **{c: finite_or_null(x) for c, x in zip(x_, xs)}}
    exprs = {"sy": y_}
    for i in range(k):
        exprs[f"sx{i}"], exprs[f"sxy{i}"] = x_[i], f"{x_[i]} * {y_}"
    exprs |= {f"sxx{i}_{j}": f"{x_[i]} * {x_[j]}" for i, j in _pairs(k)}
    tag = _tmp("r")
    names = {e: f"{tag}_{e}" for e in ("n", *exprs)}
    valid = " AND ".join(f"{c} IS NOT NULL" for c in (y_, *x_))
    series = {names["n"]: f"CASE WHEN {valid} THEN 1 ELSE 0 END"}
    series |= {names[e]: f"CASE WHEN {valid} THEN {x} ELSE 0D END" for e, x in exprs.items()}
    wanted = {f"{s}_sum": (s, window) for s in series}
    return RollingRegression(tuple(xs), window, prefix, clean, series, wanted, names, cond_max)


def _elimination(r: RollingRegression) -> list[dict[str, str]]:
    """The projections (SQL) that lead from the sums to the coefficients; each uses columns of the ones before."""
    k, n = len(r.xs), f"{r.window}D"
    total = lambda e: f"{r.names[e]}_sum"
    name = lambda e: f"{r.names['n']}_{e}"
    entry = lambda i, j: name(f"a{i}_{j}")
    # centred; a regressor that is constant in the window leaves only rounding noise there: no variance
    first = {name(f"g{i}"): f"{total(f'sxy{i}')} - {total(f'sx{i}')} * {total('sy')} / {n}" for i in range(k)}
    for i, j in _pairs(k):
        c = f"{total(f'sxx{i}_{j}')} - {total(f'sx{i}')} * {total(f'sx{j}')} / {n}"
        if i == j:
            c = f"CASE WHEN {total('n')} = {r.window} AND {c} > {REL_VAR_TOL}D * {total(f'sxx{i}_{i}')} THEN sqrt({c}) END"
        first[name(f"d{i}" if i == j else f"c{i}_{j}")] = c
    # standardised: ones on the diagonal; a[i][k] is the right-hand side
    d = [name(f"d{i}") for i in range(k)]
    there = " AND ".join(f"{x} IS NOT NULL" for x in d)
    second = {}
    for i in range(k):
        second[entry(i, i)] = f"CASE WHEN {there} THEN 1D END"
        second[entry(i, k)] = f"CASE WHEN {there} THEN {name(f'g{i}')} / {d[i]} END"
        for j in range(i + 1, k):
            x = f"CASE WHEN {there} THEN {name(f'c{i}_{j}')} / ({d[i]} * {d[j]}) END"
            second[entry(i, j)] = second[entry(j, i)] = x
    steps = [first, second]
    # the matrix's condition is at most k over its least pivot
    least = f"{k / r.cond_max}D"
    for p in range(k):
        pivot = f"CASE WHEN {entry(p, p)} > {least} THEN {entry(p, p)} END"
        now = {name(f"p{p}"): pivot}
        for i in range(k):
            for j in range(p + 1, k + 1):
                if i != p:
                    now[f"{entry(i, j)}"] = f"{entry(i, j)} - {entry(i, p)} * {entry(p, j)} / ({pivot})"
        steps.append(now)
    steps.append({name(f"b{i}"): f"{entry(i, k)} / ({name(f'p{i}')} * {d[i]})" for i in range(k)})
    b = [name(f"b{i}") for i in range(k)]
    # a task's number is never negative; but a filter on a coefficient isn't pushed below a projection that
    # reads it, where it would become the whole elimination, written out again at every use of an entry
    ok = " AND ".join([*(f"{x} IS NOT NULL" for x in b), "spark_partition_id() >= 0"])
    const = f"({total('sy')} - " + " - ".join(f"{x} * {total(f'sx{i}')}" for i, x in enumerate(b)) + f") / {n}"
    steps.append({f: f"CASE WHEN {ok} THEN {x} END" for f, x in zip(r.fields, [const, *b])})
    return steps


def solve_rolling_ols(df: DataFrame, regressions: Sequence[RollingRegression]) -> DataFrame:
    """Coefficients of all regressions from their rolling sums; drops the sums and the cleaned inputs."""
    kept = [c for c in df.columns if not any(c in r.wanted or c in r.clean for r in regressions)]
    steps = [_elimination(r) for r in regressions]
    columns = df.columns
    # the last projection of each belongs with the last of all
    most = max(len(s) for s in steps)
    for i in range(most):
        now = {}
        for s in steps:
            if i >= most - len(s):
                now |= s[i - (most - len(s))]
        df = df.selectExpr(*[quoted(c) for c in columns if c not in now], *[f"{e} AS {quoted(c)}" for c, e in now.items()])
        columns = [*[c for c in columns if c not in now], *now]
    return df.select(*map(quoted, [*kept, *[f for r in regressions for f in r.fields]]))


def add_rolling_regressions(
    df: DataFrame,
    regressions: Sequence[RollingRegression],
    *,
    key: str = ASSET,
    order: str = DATE,
    by: Sequence[str] = (),
    exact: bool = False,
) -> DataFrame:
    """The coefficients of several regressions: their sums in one pass, their solves side by side."""
    df = df.withColumns({c: e for r in regressions for c, e in r.clean.items()})
    series = {s: e for r in regressions for s, e in r.series.items()}
    wanted = {o: w for r in regressions for o, w in r.wanted.items()}
    df = add_rolling_totals(df, series, wanted, key=key, order=order, by=by, exact=exact)
    return solve_rolling_ols(df, regressions)


def add_rolling_ols(
    df: DataFrame,
    y: str,
    xs: Sequence[str],
    window: int,
    *,
    prefix: str = "B_",
    key: str = ASSET,
    order: str = DATE,
    by: Sequence[str] = (),
    exact: bool = False,
    cond_max: float = 1e10,
) -> DataFrame:
    """Add ``{prefix}const`` and ``{prefix}<x>`` rolling OLS coefficients.

    Window and minimum periods are both ``window`` rows: a coefficient
    exists only where all rows of the window have y and every x.  ``cond_max`` bounds
    the condition of the standardised regressors' matrix, by its least pivot.
    """
    regression = rolling_regression(y, xs, window, prefix=prefix, cond_max=cond_max)
    return add_rolling_regressions(df, [regression], key=key, order=order, by=by, exact=exact)


def check_warmup(modes: Sequence[str]) -> None:
    """Raise for a warm-up mode that doesn't exist."""
    for warmup in modes:
        if warmup not in ("raw_excess", "strict"):
            raise ValueError(f"unknown warmup mode {warmup!r}")


def add_residual(
    df: DataFrame,
    y: str,
    xs: Sequence[str],
    out: str = "residual",
    *,
    prefix: str = "B_",
    warmup: str = "raw_excess",
) -> DataFrame:
    """``y - (B_const + sum B_x * x)`` with NULL terms skipped.

    ``warmup='raw_excess'`` keeps that null-skipping sum where the rolling
    coefficients do not exist yet, so the residual equals ``y`` there;
    ``'strict'`` makes the residual NULL until coefficients exist.
    """
    check_warmup([warmup])
    fields = _coef_fields(xs, prefix)
    terms = [F.col(fields[0])] + [F.col(f) * F.col(x) for f, x in zip(fields[1:], xs)]
    resid = F.col(y) - sum_skip_nulls(terms)
    if warmup == "strict":
        have = F.lit(True)
        for f in fields:
            have = have & F.col(f).isNotNull()
        resid = F.when(have, resid)
    return df.withColumn(out, resid)


# ---------------------------------------------------------------- full sample


def ols_sums(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One pass: count, means and centred moments per group (merged pairwise by partial aggregation, so
    values far from zero cost no digits)."""
    valid = F.col(y).isNotNull()
    for x in xs:
        valid = valid & F.col(x).isNotNull()
    v = [F.when(valid, F.col(c)) for c in (*xs, y)]
    names = [*(str(i) for i in range(len(xs))), "y"]
    aggs = [F.count(F.when(valid, 1)).cast("double").alias("n")]
    aggs += [F.avg(c).alias(f"m_{i}") for i, c in zip(names, v)]
    aggs += [F.covar_pop(v[i], v[j]).alias(f"c_{names[i]}_{names[j]}") for i, j in _pairs(len(v))]
    g = df.groupBy(*keys) if keys else df.groupBy()
    return g.agg(*aggs)


def ols_table_from_sums(sums: pd.DataFrame, xs: Sequence[str], intercept: str = "Intercept") -> pd.DataFrame:
    """Coefficients and classical t-stats from the moments of one group.

    s^2 = RSS / (n - k - 1), t_j = b_j / sqrt(s^2 (X'X)^-1_jj), intercept
    included (statsmodels formula defaults).  Degenerate fits -> NaN.
    """
    k = len(xs)
    r = sums.iloc[0]
    n = float(r["n"])
    names = [intercept, *xs]
    nan = pd.DataFrame({"variable": names, "coefficient": np.nan, "tstat": np.nan})
    if not np.isfinite(n) or n <= k + 1:
        return nan
    mean = np.array([r[f"m_{i}"] for i in range(k)], dtype=float)
    c = np.empty((k, k))
    for i, j in _pairs(k):
        c[i, j] = c[j, i] = n * float(r[f"c_{i}_{j}"])
    cy = n * np.array([r[f"c_{i}_y"] for i in range(k)], dtype=float)
    try:
        inv = np.linalg.inv(c)
    except np.linalg.LinAlgError:
        return nan
    slopes = inv @ cy
    s2 = (n * float(r["c_y_y"]) - float(slopes @ cy)) / (n - k - 1)
    spread = np.concatenate(([1.0 / n + mean @ inv @ mean], np.diag(inv)))
    se = np.sqrt(np.clip(s2 * spread, 0.0, None))
    b = np.concatenate(([float(r["m_y"]) - float(slopes @ mean)], slopes))
    with np.errstate(all="ignore"):
        t = np.where(se > 0, b / se, np.nan)
    return pd.DataFrame({"variable": names, "coefficient": b, "tstat": t})


def grouped_ols(
    df: DataFrame,
    y: str,
    xs: Sequence[str],
    keys: Sequence[str] = (),
    intercept: str = "Intercept",
) -> DataFrame:
    """A5: full-sample OLS with t-stats, one result table per group.

    The data is reduced to one row of sums per group by a partial
    aggregation; the small (k+1)^2 solve runs per group in
    ``applyInPandas`` on that single row.
    """
    sums = ols_sums(df, y, xs, keys)
    keys = list(keys)
    key_fields = [f for f in sums.schema.fields if f.name in keys]
    out_schema = T.StructType(
        key_fields
        + [
            T.StructField("variable", T.StringType()),
            T.StructField("coefficient", T.DoubleType()),
            T.StructField("tstat", T.DoubleType()),
        ]
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        res = ols_table_from_sums(pdf, xs, intercept)
        for kname in keys:
            res.insert(0, kname, pdf[kname].iloc[0])
        return res[[f.name for f in out_schema.fields]]

    if not keys:
        sums = sums.withColumn("__g", F.lit(0))
        res = sums.groupBy("__g").applyInPandas(fit, out_schema)
    else:
        res = sums.groupBy(*keys).applyInPandas(fit, out_schema)
    return res.withColumns(
        {c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in ("coefficient", "tstat")}
    )


def simple_regression(
    df: DataFrame, y: str, x: str, keys: Sequence[str] = (), intercept: str = "Intercept"
) -> DataFrame:
    """Y ~ 1 + x with classical t-stats, pure SQL aggregates (no Python)."""
    g = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    g = g.groupBy(*keys) if keys else g.groupBy()
    s = g.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.regr_slope(y, x).alias("b"),
        F.regr_intercept(y, x).alias("a"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"),
        F.regr_sxy(y, x).alias("sxy"),
        F.avg(x).alias("mx"),
    )
    s2 = safe_div(F.col("syy") - F.col("b") * F.col("sxy"), F.col("n") - F.lit(2.0))
    se_b = F.sqrt(safe_div(s2, F.col("sxx")))
    se_a = F.sqrt(s2 * (safe_div(F.lit(1.0), F.col("n")) + safe_div(F.col("mx") * F.col("mx"), F.col("sxx"))))
    s = s.select(
        *keys,
        F.col("a"),
        F.col("b"),
        safe_div(F.col("a"), se_a).alias("ta"),
        safe_div(F.col("b"), se_b).alias("tb"),
    )
    return s.select(
        *keys,
        F.expr(
            f"stack(2, '{intercept}', a, ta, '{x}', b, tb) as (variable, coefficient, tstat)"
        ),
    )
