"""Mean-variance weights with factor risk S = X F X' + D, F a full matrix per date.

Inputs are long tables: exposures (date, asset_id, factor, exposure) and
covariances (date, factor_i, factor_j, value).  With F = L L' per date,

    S^-1 v = D^-1 (v - X z),   z = L (I + L' G L)^-1 L' X'D^-1 v,   G = X'D^-1 X

so a date needs only G (K x K), X'D^-1 V and V'D^-1 V, V being the alphas and
the constraint rows.  The work is split so that no exposure matrix is ever
pivoted into columns, whatever K is:

1. alphas and exposures meet by (date, bucket of assets) in one exchange of each; a
   group of bounded size builds its rows of X and emits the date's sums as one
   packed array;
2. a date's packed arrays (one per bucket) and its rows of F meet in one
   small group: Cholesky factor, one K x K solve, the constraints' multipliers, and
   the date's *status* (:data:`STATUSES`), a row for every input date;
3. the weights need the date's multipliers and one K-vector ``zeta``: the
   per-row product x'zeta is a sum over the long exposures, all in the JVM.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsignal.functions.columns import finite_or_null
from panelsignal.operators.optimize import CONSTRAINTS, _gamma, _usable_column, constraint_coefficient
from panelsignal.operators.windows import ASSET, DATE
from panelsignal.plans.joins import bounded_broadcast

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TRADING_DAYS = 252

#: What became of a date: only ``solved`` ones have weights.
STATUSES = (
    "solved",
    "no usable rows",
    "no covariance",
    "bad covariance",  # asymmetric, or not positive semidefinite
    "ill-conditioned",
    "degenerate constraints",
)

#: F has at most this many factors: the list of names and a date's K x K matrix are small.
MAX_FACTORS = 2000
ASSETS_PER_GROUP = 4096
COND_MAX = 1e12
#: Relative difference of F's two triangles, and relative size of a negative eigenvalue, put down to rounding.
MATRIX_TOL = 1e-9

_SUMS = "date date, n long, sums array<double>"
_SOLUTION = "date date, n_assets long, status string, multipliers array<double>, zeta array<double>"


def factor_names(covariances: DataFrame) -> list[str]:
    """The factors of a covariance table, sorted (one small job)."""
    names = covariances.select(F.explode(F.array("factor_i", "factor_j")).alias("f")).distinct()
    rows = names.where(F.col("f").isNotNull()).limit(MAX_FACTORS + 1).collect()
    if len(rows) > MAX_FACTORS:
        raise ValueError(f"more than {MAX_FACTORS} factors")
    return sorted(r.f for r in rows)


def constant_covariances(dates: DataFrame, variances: Mapping[str, float]) -> DataFrame:
    """The covariance table of a constant diagonal F, for every date of ``dates``."""
    entries = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(float(v)).alias("v")) for f, v in variances.items()])
    d = dates.select(DATE).distinct().select(DATE, F.explode(entries).alias("e"))
    return d.select(DATE, F.col("e.f").alias("factor_i"), F.col("e.f").alias("factor_j"), F.col("e.v").alias("value"))


def _index(factor: str, factors: Sequence[str]) -> Column:
    """Position of a factor's name; an unlisted name is an error, not a row that vanishes."""
    at = F.array_position(F.array(*[F.lit(f) for f in factors]), F.col(factor))
    unknown = F.concat(F.lit("factor without a covariance: "), F.coalesce(F.col(factor), F.lit("NULL")))
    return F.when(at > 0, (at - 1).cast("int")).otherwise(F.raise_error(unknown).cast("int"))


def _partial_sums(k: int, nv: int):
    upper = np.triu_indices(k)

    def partial(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The sums of one date's bucket of assets: G's upper triangle, X'D^-1V, V'D^-1V."""
        none = pa.table({"date": pa.array([], pa.date32()), "n": pa.array([], pa.int64()), "sums": pa.array([], pa.list_(pa.float64()))})
        if not left.num_rows:
            return none
        used = left.filter(left.column("ok"))
        assets = used.column("asset_id").to_numpy()
        order = np.argsort(assets, kind="stable")
        assets, m = assets[order], len(assets)
        v = np.column_stack([used.column(f"v{i}").to_numpy()[order] for i in range(nv)]) if m else np.zeros((0, nv))
        d = used.column("d").to_numpy()[order]
        x = np.zeros((m, k))
        if m and right.num_rows:
            who = right.column("asset_id").to_numpy()
            # rows of a repeated (date, asset) each have the asset's exposures
            first, last = np.searchsorted(assets, who), np.searchsorted(assets, who, side="right")
            many = last - first
            row = np.repeat(first - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            at = np.repeat(right.column("idx").to_numpy(), many)
            np.add.at(x, (row, at), np.repeat(right.column("exposure").to_numpy(), many))
        xd = x / d[:, None]
        sums = np.concatenate(((xd.T @ x)[upper], (xd.T @ v).ravel(), ((v / d[:, None]).T @ v).ravel()))
        return pa.table(
            {
                "date": pa.array([key[0].as_py()], pa.date32()),
                "n": pa.array([m], pa.int64()),
                "sums": pa.array([sums.tolist()], pa.list_(pa.float64())),
            }
        )

    return partial


def covariance_matrix(k: int, i: np.ndarray, j: np.ndarray, value: np.ndarray) -> np.ndarray | None:
    """F from its entries: one triangle is mirrored, absent entries are 0; None if the two triangles disagree."""
    f = np.full((k, k), np.nan)
    f[i, j] = value
    both = np.where(np.isnan(f), f.T, f)
    other = np.where(np.isnan(f.T), f, f.T)
    both, other = np.nan_to_num(both), np.nan_to_num(other)
    scale = float(np.abs(both).max(initial=0.0))
    if np.abs(both - other).max(initial=0.0) > MATRIX_TOL * scale:
        return None
    return (both + other) / 2


def matrix_root(f: np.ndarray) -> np.ndarray | None:
    """L with L L' = F: Cholesky, or from the eigenvalues where F is only semidefinite; None for any other F."""
    try:
        return np.linalg.cholesky(f)
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(f)
        if len(values) and values[0] < -MATRIX_TOL * max(float(values[-1]), 0.0):
            return None
        return vectors * np.sqrt(np.clip(values, 0.0, None))


def solve_date(k: int, nv: int, sums: np.ndarray, f: np.ndarray, cond_max: float, det_tol: float):
    """(status, multipliers, zeta) of one date from its summed array and F."""
    root = matrix_root(f)
    if root is None:
        return "bad covariance", None, None
    size = k * (k + 1) // 2
    g = np.zeros((k, k))
    g[np.triu_indices(k)] = sums[:size]
    g = g + np.triu(g, 1).T
    u = sums[size : size + k * nv].reshape(k, nv)
    vv = sums[size + k * nv :].reshape(nv, nv)
    m = np.eye(k) + root.T @ g @ root
    if not np.isfinite(m).all() or (k and np.linalg.cond(m) > cond_max):
        return "ill-conditioned", None, None
    z = root @ np.linalg.solve(m, root.T @ u)
    inner = vv - u.T @ z  # V'S^-1V
    a, b = inner[1:, 1:], inner[1:, 0]
    if nv > 1:
        scale = np.sqrt(np.clip(np.diag(a), 0.0, None))
        if not (scale > 0).all() or not np.linalg.det(a / np.outer(scale, scale)) > det_tol:
            return "degenerate constraints", None, None
        multipliers = np.linalg.solve(a, b)
    else:
        multipliers = np.zeros(0)
    return "solved", multipliers, z[:, 0] - z[:, 1:] @ multipliers


def _solver(k: int, nv: int, cond_max: float, det_tol: float):
    def solve(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        n = int(sum(left.column("n").to_pylist()))
        status, multipliers, zeta = "no usable rows", None, None
        if n:
            i, j, value = (right.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "value"))
            if not len(value) and k:
                status = "no covariance"
            else:
                f = covariance_matrix(k, i, j, value)
                sums = np.sum([np.asarray(s.values) for s in left.column("sums")], axis=0)
                status, multipliers, zeta = (
                    ("bad covariance", None, None) if f is None else solve_date(k, nv, sums, f, cond_max, det_tol)
                )
        rows = 1 if left.num_rows else 0  # a date with covariances only is no input date
        lists = [None if x is None else x.tolist() for x in (multipliers, zeta)]
        return pa.table(
            {
                "date": pa.array([key[0].as_py()] * rows, pa.date32()),
                "n_assets": pa.array([n] * rows, pa.int64()),
                "status": pa.array([status] * rows, pa.string()),
                "multipliers": pa.array([lists[0]] * rows, pa.list_(pa.float64())),
                "zeta": pa.array([lists[1]] * rows, pa.list_(pa.float64())),
            }
        )

    return solve


def _indexed(exposures: DataFrame, factors: Sequence[str]) -> DataFrame:
    x = exposures.select(DATE, ASSET, _index("factor", factors).alias("idx"), finite_or_null("exposure").alias("exposure"))
    return x.where(F.col("exposure").isNotNull())


def factor_risk_solution(
    alphas: DataFrame,
    exposures: DataFrame,
    covariances: DataFrame,
    constraints: Sequence[str] = ("ZeroBeta", "ZeroInvestment"),
    *,
    factors: Sequence[str] | None = None,
    alpha: str = "alpha",
    risk: str = "specific_risk",
    beta: str = "predicted_beta",
    cond_max: float = COND_MAX,
    det_tol: float = 1e-9,
    assets_per_group: int = ASSETS_PER_GROUP,
) -> DataFrame:
    """One row per date of ``alphas``: n_assets (usable rows), status, multipliers, zeta.

    ``factors`` names F's rows (read from ``covariances`` if not given).  An exposure or
    covariance of any other factor raises when the plan runs.  Absent exposures and
    covariances are 0; exposures of one (date, asset, factor) given in parts add up.  The plan reads
    ``alphas`` twice (once for the largest date): hand in a written or checkpointed frame.
    """
    if unknown := set(constraints) - set(CONSTRAINTS):
        raise ValueError(f"unknown constraints {sorted(unknown)}")
    constraints = list(dict.fromkeys(constraints))
    factors = list(factors) if factors is not None else factor_names(covariances)
    k, nv = len(factors), 1 + len(constraints)
    largest = alphas.groupBy(DATE).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    bucket = F.pmod(F.xxhash64(ASSET), F.lit(max(1, -(-largest // assets_per_group)))).alias("bucket")
    vectors = [F.col(alpha), *[constraint_coefficient(c, beta) for c in constraints]]
    left = alphas.select(
        DATE,
        bucket,
        ASSET,
        F.coalesce(_usable_column(constraints, alpha, risk, beta), F.lit(False)).alias("ok"),
        (F.col(risk) * F.col(risk)).alias("d"),
        *[v.cast("double").alias(f"v{i}") for i, v in enumerate(vectors)],
    )
    right = _indexed(exposures, factors).select(DATE, bucket, ASSET, "idx", "exposure")
    sums = left.groupBy(DATE, "bucket").cogroup(right.groupBy(DATE, "bucket")).applyInArrow(_partial_sums(k, nv), _SUMS)
    f = covariances.select(
        DATE, _index("factor_i", factors).alias("i"), _index("factor_j", factors).alias("j"), finite_or_null("value").alias("value")
    ).where(F.col("value").isNotNull())
    return sums.groupBy(DATE).cogroup(f.groupBy(DATE)).applyInArrow(_solver(k, nv, cond_max, det_tol), _SOLUTION)


def factor_risk_weights(
    alphas: DataFrame,
    exposures: DataFrame,
    solution: DataFrame,
    gamma: float | str | Column,
    constraints: Sequence[str] = ("ZeroBeta", "ZeroInvestment"),
    *,
    factors: Sequence[str],
    alpha: str = "alpha",
    risk: str = "specific_risk",
    beta: str = "predicted_beta",
    carry: Sequence[str] = (),
    max_keys: int | None = None,
) -> DataFrame:
    """(date, asset_id, weight, carry...) of the solved dates; ``solution`` as :func:`factor_risk_solution` gives it
    (read twice: hand in a written or checkpointed one)."""
    constraints = list(dict.fromkeys(constraints))
    solved = solution.where(F.col("status") == "solved")
    width = 64 + 8 * (len(factors) + len(constraints))
    zeta = bounded_broadcast(solved.select(DATE, "zeta"), max_keys, width)
    part = F.sum(F.col("exposure") * F.element_at("zeta", F.col("idx") + 1)).alias("__xz")
    products = _indexed(exposures, factors).join(zeta, DATE).groupBy(DATE, ASSET).agg(part)
    rows = alphas.where(_usable_column(constraints, alpha, risk, beta))
    rows = rows.join(bounded_broadcast(solved.select(DATE, "multipliers"), max_keys, width), DATE)
    rows = rows.join(products, [DATE, ASSET], "left")
    value = F.col(alpha) - F.coalesce(F.col("__xz"), F.lit(0.0))
    for j, c in enumerate(constraints):
        value = value - F.col("multipliers")[j] * constraint_coefficient(c, beta)
    return rows.select(DATE, ASSET, (value / (_gamma(gamma) * F.col(risk) * F.col(risk))).alias("weight"), *carry)


def full_covariances(covariances: DataFrame) -> DataFrame:
    """Both triangles of every date's F, each entry once (one given triangle is mirrored)."""
    mirrored = covariances.select(DATE, F.col("factor_j").alias("factor_i"), F.col("factor_i").alias("factor_j"), "value")
    both = covariances.select(DATE, "factor_i", "factor_j", "value").unionByName(mirrored)
    return both.groupBy(DATE, "factor_i", "factor_j").agg(F.avg("value").alias("value"))


def ex_ante_risk(
    weights: DataFrame,
    exposures: DataFrame | None = None,
    covariances: DataFrame | None = None,
    *,
    by: Sequence[str] = (),
    weight: str = "weight",
    risk: str = "specific_risk",
) -> DataFrame:
    """C13 before the fact: per date (and ``by``) factor_variance e'Fe, specific_variance w'Dw, and the annualised
    ``active_risk``, with e = X'w.

    ``weights`` carries each row's specific risk.  Without exposures the risk is diagonal.  Only the K-vectors e
    are joined to F, K rows per date and portfolio against K per factor; a date without covariances
    has a NULL active risk rather than a too small one.
    """
    keys = [DATE, *by]
    w = F.col(weight)
    specific = weights.groupBy(*keys).agg(F.sum(w * w * F.col(risk) * F.col(risk)).alias("specific_variance"))
    if exposures is None:
        out = specific.withColumn("factor_variance", F.lit(0.0))
    else:
        if covariances is None:
            raise ValueError("exposures need covariances")
        x = exposures.select(DATE, ASSET, "factor", finite_or_null("exposure").alias("exposure"))
        e = weights.select(*keys, ASSET, weight).join(x, [DATE, ASSET]).groupBy(*keys, "factor")
        e = e.agg(F.sum(w * F.col("exposure")).alias("e"))
        full = full_covariances(covariances)
        left = e.select(*keys, F.col("factor").alias("factor_i"), F.col("e").alias("e_i"))
        right = e.select(*keys, F.col("factor").alias("factor_j"), F.col("e").alias("e_j"))
        half = left.join(full, [DATE, "factor_i"]).groupBy(*keys, "factor_j").agg(F.sum(F.col("e_i") * F.col("value")).alias("f"))
        quadratic = right.join(half, [*keys, "factor_j"]).groupBy(*keys).agg(F.sum(F.col("e_j") * F.col("f")).alias("factor_variance"))
        out = specific.join(quadratic, keys, "left")
    total = F.col("specific_variance") + F.col("factor_variance")
    return out.select(
        *keys, "factor_variance", "specific_variance", F.sqrt(total * F.lit(float(TRADING_DAYS))).alias("active_risk")
    )


def ex_ante_gamma(risk: DataFrame, gamma: float | str | Column, target: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Per ``by`` (or date) the gamma whose mean active risk is ``target``; weights scale as 1/gamma."""
    g = _gamma(gamma)
    if not by:
        return risk.select(DATE, "active_risk", (g * F.col("active_risk") / F.lit(float(target))).alias("gamma_star"))
    mean = risk.groupBy(*by).agg(F.avg("active_risk").alias("active_risk"))
    return mean.select(*by, "active_risk", (g * F.col("active_risk") / F.lit(float(target))).alias("gamma_star"))
