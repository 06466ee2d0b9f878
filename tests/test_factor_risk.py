"""Dated full factor covariances: weights against a dense KKT solve, statuses, ex-ante risk."""

import numpy as np
import pytest
from conftest import day
from pyspark.sql import functions as F

from panelsignal.operators import factor_risk as fr
from panelsignal.operators.optimize import mvo_status, mvo_weights_factor_risk

GAMMA = 7.0
CONS = ("ZeroBeta", "ZeroInvestment")


def made(seed, k, n, dates=3, rank=None):
    rng = np.random.default_rng(seed)
    names = [f"f{i}" for i in range(k)]
    rows, expo, cov, dense = [], [], [], {}
    for t in range(dates):
        x = rng.normal(size=(n, k)) * (rng.random((n, k)) < 0.7)
        a = rng.normal(size=(k, rank or k))
        f = a @ a.T * 1e-3
        alpha, risk, beta = rng.normal(size=n), rng.uniform(0.1, 0.4, n), rng.uniform(0.5, 1.5, n)
        rows += [(day(t), i, float(alpha[i]), float(risk[i]), float(beta[i])) for i in range(n)]
        expo += [(day(t), i, names[j], float(x[i, j])) for i in range(n) for j in range(k) if x[i, j]]
        cov += [(day(t), names[i], names[j], float(f[i, j])) for i in range(k) for j in range(i, k)]
        dense[day(t)] = (x, f, alpha, risk, beta)
    return rows, expo, cov, dense


def frames(spark, rows, expo, cov):
    return (
        spark.createDataFrame(rows, "date date, asset_id long, alpha double, specific_risk double, predicted_beta double"),
        spark.createDataFrame(expo, "date date, asset_id long, factor string, exposure double"),
        spark.createDataFrame(cov, "date date, factor_i string, factor_j string, value double"),
    )


def kkt(x, f, alpha, risk, beta, constraints):
    s = x @ f @ x.T + np.diag(risk**2)
    a = np.vstack([{"ZeroBeta": beta, "ZeroInvestment": np.ones(len(beta))}[c] for c in constraints]) if constraints else np.zeros((0, len(beta)))
    m = len(a)
    k = np.block([[GAMMA * s, a.T], [a, np.zeros((m, m))]])
    return np.linalg.solve(k, np.concatenate([alpha, np.zeros(m)]))[: len(alpha)], s


@pytest.mark.parametrize("constraints", [(), ("ZeroInvestment",), CONS])
@pytest.mark.parametrize("k,rank,per_group", [(3, None, 4096), (12, 5, 7)])
def test_weights_match_dense_solve(spark, constraints, k, rank, per_group):
    rows, expo, cov, dense = made(k, k, 40, rank=rank)
    # an exposure given in two parts counts once with their sum
    d, i, f, v = expo[0]
    al, ex, co = frames(spark, rows, [(d, i, f, v - 2.0), (d, i, f, 2.0), *expo[1:], (d, 999, f, 1.0)], cov)
    factors = fr.factor_names(co)
    solution = fr.factor_risk_solution(al, ex, co, constraints, assets_per_group=per_group).persist()
    assert {r.status for r in solution.collect()} == {"solved"}
    w = fr.factor_risk_weights(al, ex, solution, GAMMA, constraints, factors=factors, carry=("specific_risk",)).persist()
    got = w.toPandas().sort_values(["date", "asset_id"])
    risks = {r.date: r.active_risk for r in fr.ex_ante_risk(w, ex, co).collect()}
    for d, (*_, beta) in dense.items():
        want, s = kkt(*dense[d], constraints)
        np.testing.assert_allclose(got[got.date == d].weight.to_numpy(), want, rtol=1e-7, atol=1e-9)
        assert abs(risks[d] - np.sqrt(252 * want @ s @ want)) < 1e-8
    w.unpersist()
    solution.unpersist()


def test_every_date_has_a_status(spark):
    rows, expo, cov, _ = made(1, 3, 6, dates=6)
    bad = {day(1): None, day(2): "negative", day(3): "asymmetric"}
    cov = [c for c in cov if bad.get(c[0], 1) is not None]
    cov = [(d, i, j, -v if bad.get(d) == "negative" and i == j == "f0" else v) for d, i, j, v in cov]
    cov += [(day(3), "f1", "f0", 5.0), (day(9), "f0", "f0", 1.0)]
    rows = [(d, i, None if d == day(4) else a, r, 1.0 if d == day(5) else b) for d, i, a, r, b in rows]
    al, ex, co = frames(spark, rows, expo, cov)
    got = {r.date: (r.status, r.n_assets) for r in fr.factor_risk_solution(al, ex, co).collect()}
    assert got == {
        day(0): ("solved", 6),
        day(1): ("no covariance", 6),
        day(2): ("bad covariance", 6),
        day(3): ("bad covariance", 6),
        day(4): ("no usable rows", 0),
        day(5): ("degenerate constraints", 6),
    }
    assert {s for s, _ in got.values()} <= set(fr.STATUSES)
    w = mvo_weights_factor_risk(al, ex, co, GAMMA)
    assert {r.date for r in w.select("date").distinct().collect()} == {day(0)}
    # diagonal risk has no covariance to miss
    got = {r.date: r.status for r in mvo_status(al).collect()}
    assert got == {day(i): "solved" for i in range(4)} | {day(4): "no usable rows", day(5): "degenerate constraints"}


def test_unlisted_factors_raise(spark):
    rows, expo, cov, _ = made(2, 2, 5, dates=1)
    al, ex, co = frames(spark, rows, [*expo, (day(0), 0, "other", 1.0)], cov)
    with pytest.raises(Exception, match="factor without a covariance: other"):
        fr.factor_risk_solution(al, ex, co).collect()
    with pytest.raises(ValueError):
        fr.factor_risk_solution(al, ex, co, ("NoSuchThing",))


def test_empty_tables(spark):
    rows, expo, cov, dense = made(3, 2, 5, dates=1)
    al, ex, co = frames(spark, rows, expo, cov)
    assert fr.factor_risk_solution(al.limit(0), ex, co).collect() == []
    w = mvo_weights_factor_risk(al, ex.limit(0), co, GAMMA, ()).toPandas().sort_values("asset_id")
    x, f, alpha, risk, _ = dense[day(0)]
    np.testing.assert_allclose(w.weight.to_numpy(), alpha / (GAMMA * risk**2), rtol=1e-9)


def test_plan_does_not_grow_with_the_factors(spark):
    """K = 60 and K = 3 have the same operators and columns: no pivot, no column per pair."""
    plans = []
    for k in (3, 60):
        al, ex, co = frames(spark, *made(4, k, 8, dates=1)[:3])
        solution = fr.factor_risk_solution(al, ex, co)
        plans.append([line.strip(" +-:*()0123456789").split("(")[0].split()[0] for line in
                      solution._jdf.queryExecution().executedPlan().toString().splitlines() if line.strip()])
        assert solution.columns == ["date", "n_assets", "status", "multipliers", "zeta"]
        if k == 60:
            assert solution.where(F.col("status") == "solved").count() == 1
    assert plans[0] == plans[1]
