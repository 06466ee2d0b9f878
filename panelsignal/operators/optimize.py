"""Mean-variance weights per date under linear equality constraints.

Objective per date: maximise  w'a - (gamma/2) w'Sw  subject to  A w = 0,
where the rows of A are the constraint coefficient vectors (``ZeroInvestment``:
all ones, ``ZeroBeta``: the predicted betas).  With equality constraints
only the optimum is closed form:

    w = (1/gamma) S^-1 (a - A' l),   l = (A S^-1 A')^-1 A S^-1 a

so no iterative solver is needed.  Everything reduces to per-date sums:

* diagonal risk S = diag(specific_risk^2): the sums  sum(a_j a_k / d) and
  sum(a_j alpha / d)  over each date, a 2x2 (at most) solve in Column
  arithmetic, and a broadcast join of the one-row-per-date result back to
  the rows;
* factor risk S = X F X' + D with a full F per date: :mod:`panelsignal.operators.factor_risk`.

Dates are independent, so Spark parallelises over dates and over the
rows of each date; no date is ever funnelled through a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsignal.functions.columns import finite_or_null, safe_div
from panelsignal.operators.windows import ASSET, DATE
from panelsignal.plans.joins import join_per_key

# Constraint names of the reference and their coefficient rows.
CONSTRAINTS: dict[str, str | None] = {
    "ZeroInvestment": None,  # coefficient 1 for every asset
    "ZeroBeta": "predicted_beta",
}


def constraint_coefficient(name: str, beta: str = "predicted_beta") -> Column:
    if name not in CONSTRAINTS:
        raise ValueError(f"unknown constraint {name!r}; known: {sorted(CONSTRAINTS)}")
    return F.lit(1.0) if CONSTRAINTS[name] is None else F.col(beta)


def _usable_column(constraints: Sequence[str], alpha: str, risk: str, beta: str) -> Column:
    # NaN passes isNotNull and > 0: one such row would turn a whole date's sums into NaN
    cond = finite_or_null(alpha).isNotNull() & (finite_or_null(risk) > 0)
    if "ZeroBeta" in constraints:
        cond = cond & finite_or_null(beta).isNotNull()
    return cond


def _usable(alphas: DataFrame, constraints: Sequence[str], alpha: str, risk: str, beta: str) -> DataFrame:
    return alphas.where(_usable_column(constraints, alpha, risk, beta))


def _lambda_columns(m: list[list[Column]], b: list[Column], det_tol: float) -> tuple[list[Column], Column]:
    """Solve the (<= 2) x (<= 2) system M l = b in Column arithmetic."""
    if len(b) == 0:
        return [], F.lit(True)
    if len(b) == 1:
        ok = m[0][0] > 0
        return [safe_div(b[0], m[0][0])], ok
    det = m[0][0] * m[1][1] - m[0][1] * m[0][1]
    ok = det > F.lit(det_tol) * m[0][0] * m[1][1]
    l1 = safe_div(m[1][1] * b[0] - m[0][1] * b[1], det)
    l2 = safe_div(m[0][0] * b[1] - m[0][1] * b[0], det)
    return [l1, l2], ok


def _gamma(gamma: float | str | Column) -> Column:
    if isinstance(gamma, Column):
        return gamma
    if isinstance(gamma, str):
        return F.col(gamma)
    return F.lit(float(gamma))


def mvo_weights(
    alphas: DataFrame,
    gamma: float | str | Column,
    constraints: Sequence[str] = ("ZeroBeta", "ZeroInvestment"),
    *,
    alpha: str = "alpha",
    risk: str = "specific_risk",
    beta: str = "predicted_beta",
    keys: Sequence[str] = (DATE,),
    max_keys: int | None = None,
    det_tol: float = 1e-9,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Diagonal-risk closed-form weights: keys..., asset_id, weight, carry...

    ``carry`` passes row columns through (e.g. the forward return already
    computed in the asset stage, which spares a (date, asset) join later).

    ``gamma`` is a number or a column (e.g. one gamma per signal in long
    format).  Rows without alpha or risk are left out.  A date whose constraint
    system is degenerate (e.g. all betas equal, or a single asset under
    two constraints) yields no rows.
    """
    keys = list(keys)
    constraints = list(dict.fromkeys(constraints))
    df = _usable(alphas, constraints, alpha, risk, beta)
    d = F.col(risk) * F.col(risk)
    coef = {c: constraint_coefficient(c, beta) for c in constraints}
    if not constraints:
        w = F.col(alpha) / (_gamma(gamma) * d)
        return df.select(*keys, ASSET, w.alias("weight"), *carry)

    names = [f"__a{j}" for j in range(len(constraints))]
    df = df.withColumns({n: coef[c] for n, c in zip(names, constraints)})
    aggs = []
    for j, nj in enumerate(names):
        aggs.append(F.sum(F.col(nj) * F.col(alpha) / d).alias(f"__b{j}"))
        for k in range(j, len(names)):
            aggs.append(F.sum(F.col(nj) * F.col(names[k]) / d).alias(f"__m{j}{k}"))
    sums = df.groupBy(*keys).agg(*aggs)
    m = [[F.col(f"__m{min(j, k)}{max(j, k)}") for k in range(len(names))] for j in range(len(names))]
    b = [F.col(f"__b{j}") for j in range(len(names))]
    lams, ok = _lambda_columns(m, b, det_tol)
    lam = sums.where(ok).select(*keys, *[lv.alias(f"__l{j}") for j, lv in enumerate(lams)])
    joined = join_per_key(df, lam, on=keys, how="inner", max_rows=max_keys)
    adj = F.col(alpha)
    for j, nj in enumerate(names):
        adj = adj - F.col(f"__l{j}") * F.col(nj)
    w = adj / (_gamma(gamma) * d)
    return joined.select(*keys, ASSET, w.alias("weight"), *carry)


def wide_mvo_weights(
    alphas: DataFrame,
    gammas: dict[str, float],
    constraints: Sequence[str] = ("ZeroBeta", "ZeroInvestment"),
    *,
    risk: str = "specific_risk",
    beta: str = "predicted_beta",
    days: int | None = None,
    det_tol: float = 1e-9,
) -> DataFrame:
    """C6 for several signals: alpha columns become weight columns, NULL where a
    signal has no weight (unusable row, or a degenerate date).

    Every signal's sums and multipliers are columns of one row per date, so what is
    broadcast back is bounded by the span's ``days`` for any number of signals.
    """
    signals, constraints = list(gammas), list(dict.fromkeys(constraints))
    others = [c for c in alphas.columns if c not in signals]
    d = F.col(risk) * F.col(risk)
    coef = [constraint_coefficient(c, beta) for c in constraints]
    usable = finite_or_null(risk) > 0
    if "ZeroBeta" in constraints:
        usable = usable & finite_or_null(beta).isNotNull()
    rows = alphas.withColumns({s: F.when(usable, finite_or_null(s)) for s in signals})
    aggs, lam = [], []
    for i, s in enumerate(signals):
        a, has = F.col(s), F.col(s).isNotNull()
        for j, cj in enumerate(coef):
            aggs.append(F.sum(F.when(has, cj * a / d)).alias(f"__b{i}_{j}"))
            for k in range(j, len(coef)):
                aggs.append(F.sum(F.when(has, cj * coef[k] / d)).alias(f"__m{i}_{j}{k}"))
        m = [[F.col(f"__m{i}_{min(j, k)}{max(j, k)}") for k in range(len(coef))] for j in range(len(coef))]
        lams, ok = _lambda_columns(m, [F.col(f"__b{i}_{j}") for j in range(len(coef))], det_tol)
        lam += [F.when(ok, lv).alias(f"__l{i}_{j}") for j, lv in enumerate(lams)]
    if coef:
        rows = join_per_key(rows, rows.groupBy(DATE).agg(*aggs).select(DATE, *lam), on=[DATE], how="inner", max_rows=days)
    weights = []
    for i, s in enumerate(signals):
        adj = F.col(s)
        for j, cj in enumerate(coef):
            adj = adj - F.col(f"__l{i}_{j}") * cj
        weights.append((adj / (F.lit(float(gammas[s])) * d)).alias(s))
    return rows.select(*others, *weights)


# ------------------------------------------------------------------ status


def mvo_status(
    alphas: DataFrame,
    constraints: Sequence[str] = ("ZeroBeta", "ZeroInvestment"),
    *,
    alpha: str = "alpha",
    risk: str = "specific_risk",
    beta: str = "predicted_beta",
    keys: Sequence[str] = (DATE,),
    det_tol: float = 1e-9,
) -> DataFrame:
    """Per key (every input date) what :func:`mvo_weights` does with it: n_rows, n_usable, status
    (``solved``, ``no usable rows`` or ``degenerate constraints``)."""
    constraints = list(dict.fromkeys(constraints))
    d = F.col(risk) * F.col(risk)
    coef = [constraint_coefficient(c, beta) for c in constraints]
    usable = F.coalesce(_usable_column(constraints, alpha, risk, beta), F.lit(False))
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count_if(usable).alias("n_usable")]
    for j, cj in enumerate(coef):
        aggs += [F.sum(F.when(usable, cj * coef[k] / d)).alias(f"__m{j}{k}") for k in range(j, len(coef))]
    sums = alphas.groupBy(*keys).agg(*aggs)
    m = [[F.col(f"__m{min(j, k)}{max(j, k)}") for k in range(len(coef))] for j in range(len(coef))]
    _, ok = _lambda_columns(m, [F.lit(0.0)] * len(coef), det_tol)
    status = F.when(F.col("n_usable") == 0, "no usable rows").when(ok, "solved").otherwise("degenerate constraints")
    return sums.select(*keys, "n_rows", "n_usable", status.alias("status"))


# ------------------------------------------------------------- factor risk


def mvo_weights_factor_risk(
    alphas: DataFrame,
    exposures: DataFrame,
    factor_covariance: dict[str, float] | DataFrame,
    gamma: float | str | Column,
    constraints: Sequence[str] = ("ZeroBeta", "ZeroInvestment"),
    *,
    alpha: str = "alpha",
    risk: str = "specific_risk",
    beta: str = "predicted_beta",
    max_keys: int | None = None,
    det_tol: float = 1e-9,
    carry: Sequence[str] = (),
    materialize_as: str | None = "checkpoint",
) -> DataFrame:
    """Closed-form weights with S = X F X' + diag(risk^2); see :mod:`panelsignal.operators.factor_risk`.

    ``exposures`` is long (date, asset_id, factor, exposure).  ``factor_covariance``:
    a table (date, factor_i, factor_j, value), or one constant variance per factor.  Exposures to a factor
    it doesn't list raise.  The per-date solutions are written once (``materialize_as``); to see the
    status of every date, call the two steps themselves.
    """
    from panelsignal.operators.factor_risk import constant_covariances, factor_names, factor_risk_solution, factor_risk_weights
    from panelsignal.plans.materialize import materialize

    if isinstance(factor_covariance, DataFrame):
        covariances, factors = factor_covariance, factor_names(factor_covariance)
    else:
        covariances, factors = constant_covariances(alphas, factor_covariance), list(factor_covariance)
    names = {"alpha": alpha, "risk": risk, "beta": beta}
    solution = factor_risk_solution(alphas, exposures, covariances, constraints, factors=factors, det_tol=det_tol, **names)
    solution = materialize(solution, materialize_as)
    return factor_risk_weights(
        alphas, exposures, solution, gamma, constraints, factors=factors, carry=carry, max_keys=max_keys, **names
    )


def calibrate_gamma(summary: DataFrame, gamma: float, target_vol: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Gamma giving the target annualised active risk.

    With equality constraints only, weights scale as 1/gamma, so the
    portfolio volatility does too: gamma* = gamma0 * vol(gamma0) / target.
    """
    return summary.select(
        *by,
        F.lit(float(gamma)).alias("gamma"),
        F.col("volatility"),
        F.lit(float(target_vol)).alias("target_volatility"),
        (F.lit(float(gamma)) * F.col("volatility") / F.lit(float(target_vol))).alias("gamma_star"),
    )
