import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import day, panel_df
from panelsignal.operators.evaluate import (
    cumulative_log_returns,
    factor_regression,
    performance_summary,
    portfolio_returns,
    shift_factors,
)
from panelsignal.operators.optimize import calibrate_gamma, mvo_weights, mvo_weights_factor_risk

COLS = ("date", "asset_id", "alpha", "predicted_beta", "specific_risk")


def _alphas(spark, dates=3, assets=12, seed=0):
    rng = np.random.default_rng(seed)
    rows = [
        (d, a, float(rng.normal(0, 0.01)), float(rng.uniform(0.5, 1.5)), float(rng.uniform(0.1, 0.4)))
        for d in range(dates)
        for a in range(assets)
    ]
    return panel_df(spark, rows, COLS), pd.DataFrame(rows, columns=["d", "a", "alpha", "beta", "risk"])


def _kkt(alpha, beta, risk, gamma, cons):
    n = len(alpha)
    S = np.diag(risk**2)
    A = [np.ones(n) if c == "ZeroInvestment" else beta for c in cons]
    m = len(A)
    K = np.zeros((n + m, n + m))
    K[:n, :n] = gamma * S
    for j, a in enumerate(A):
        K[:n, n + j] = a
        K[n + j, :n] = a
    rhs = np.concatenate([alpha, np.zeros(m)])
    return np.linalg.solve(K, rhs)[:n]


@pytest.mark.parametrize(
    "cons", [(), ("ZeroInvestment",), ("ZeroBeta",), ("ZeroBeta", "ZeroInvestment")]
)
def test_mvo_matches_kkt_and_constraints(spark, cons):
    df, pdf = _alphas(spark)
    w = mvo_weights(df, 50.0, cons).toPandas().merge(
        pdf.assign(date=pdf.d.map(day)), left_on=["date", "asset_id"], right_on=["date", "a"]
    )
    for d, g in w.groupby("date"):
        g = g.sort_values("asset_id")
        exp = _kkt(g.alpha.to_numpy(), g.beta.to_numpy(), g.risk.to_numpy(), 50.0, cons)
        np.testing.assert_allclose(g.weight.to_numpy(), exp, rtol=1e-9, atol=1e-12)
        if "ZeroInvestment" in cons:
            assert abs(g.weight.sum()) < 1e-12
        if "ZeroBeta" in cons:
            assert abs((g.weight * g.beta).sum()) < 1e-12


def test_mvo_scales_with_one_over_gamma(spark):
    df, _ = _alphas(spark, seed=4)
    a = mvo_weights(df, 10.0).toPandas().sort_values(["date", "asset_id"]).weight.to_numpy()
    b = mvo_weights(df, 40.0).toPandas().sort_values(["date", "asset_id"]).weight.to_numpy()
    np.testing.assert_allclose(a * 10.0, b * 40.0, rtol=1e-12)


def test_degenerate_dates_are_skipped(spark):
    rows = [
        (0, 1, 0.01, 1.0, 0.2),  # single asset under two constraints
        (1, 1, 0.01, 1.2, 0.2),  # all betas equal: beta collinear with 1
        (1, 2, -0.02, 1.2, 0.3),
        (2, 1, None, 1.0, 0.2),  # null alpha left out
        (2, 2, 0.01, 0.8, 0.2),
        (2, 3, -0.01, 1.1, 0.2),
        (2, 4, 0.02, 1.3, 0.25),
    ]
    w = mvo_weights(panel_df(spark, rows, COLS), 50.0).collect()
    assert {r["date"] for r in w} == {day(2)}
    assert sorted(r["asset_id"] for r in w) == [2, 3, 4]


def test_factor_risk_matches_full_solve(spark):
    df, pdf = _alphas(spark, dates=2, assets=15, seed=7)
    rng = np.random.default_rng(8)
    fv = {"size": 0.04, "value": 0.01, "region_1": 0.02}
    exp_rows = []
    for d in range(2):
        for a in range(15):
            for f in fv:
                if f == "region_1" and a % 2:
                    continue  # missing exposure counts as 0
                exp_rows.append((day(d), a, f, float(rng.normal()) if f != "region_1" else 1.0))
    exposures = spark.createDataFrame(exp_rows, "date date, asset_id bigint, factor string, exposure double")
    for cons in [(), ("ZeroBeta", "ZeroInvestment")]:
        w = mvo_weights_factor_risk(df, exposures, fv, 50.0, cons).toPandas()
        ex = pd.DataFrame(exp_rows, columns=["date", "asset_id", "factor", "exposure"])
        for d in range(2):
            g = pdf[pdf.d == d].sort_values("a")
            X = (
                ex[ex.date == day(d)]
                .pivot(index="asset_id", columns="factor", values="exposure")
                .reindex(index=g.a, columns=list(fv))
                .fillna(0.0)
                .to_numpy()
            )
            S = X @ np.diag(list(fv.values())) @ X.T + np.diag(g.risk.to_numpy() ** 2)
            n = len(g)
            A = [np.ones(n) if c == "ZeroInvestment" else g.beta.to_numpy() for c in cons]
            m = len(A)
            K = np.zeros((n + m, n + m))
            K[:n, :n] = 50.0 * S
            for j, a in enumerate(A):
                K[:n, n + j] = a
                K[n + j, :n] = a
            exp = np.linalg.solve(K, np.concatenate([g.alpha.to_numpy(), np.zeros(m)]))[:n]
            got = w[w.date == day(d)].sort_values("asset_id").weight.to_numpy()
            np.testing.assert_allclose(got, exp, rtol=1e-8, atol=1e-12)


def test_orphan_weight_and_empty_sum(spark):
    weights = panel_df(
        spark,
        [(0, 1, 0.5), (0, 2, -0.5), (1, 3, 1.0)],  # asset 3 has no return on date 1
        ("date", "asset_id", "weight"),
    )
    rets = panel_df(spark, [(0, 1, 0.02), (0, 2, 0.01)], ("date", "asset_id", "forward_return"))
    got = {r["date"]: r["return"] for r in portfolio_returns(weights, rets).collect()}
    assert got[day(0)] == pytest.approx(0.005)
    assert got[day(1)] == 0.0


def test_cumulative_summary_and_gamma(spark):
    r = [0.01, -0.02, 0.015, 0.0, 0.005]
    port = spark.createDataFrame([(day(i), v) for i, v in enumerate(r)], "date date, return double")
    cum = [x["cumulative_return"] for x in cumulative_log_returns(port).orderBy("date").collect()]
    np.testing.assert_allclose(cum, np.cumsum(np.log1p(r)) * 100)
    s = performance_summary(port).collect()[0]
    assert s["mean_return"] == pytest.approx(np.mean(r) * 252)
    assert s["volatility"] == pytest.approx(np.std(r, ddof=1) * math.sqrt(252))
    assert s["sharpe"] == pytest.approx(s["mean_return"] / s["volatility"])
    g = calibrate_gamma(performance_summary(port), 50.0, 0.05).collect()[0]
    assert g["gamma_star"] == pytest.approx(50.0 * s["volatility"] / 0.05)


def test_factor_shift_and_regression(spark):
    rng = np.random.default_rng(11)
    n = 60
    f = rng.normal(0, 0.01, n + 1)
    rf = np.full(n + 1, 0.0001)
    factors = spark.createDataFrame(
        [(day(i), float(f[i]), float(rf[i])) for i in range(n + 1)], "date date, mkt_rf double, rf double"
    )
    sh = shift_factors(factors, ["mkt_rf", "rf"]).orderBy("date").collect()
    assert sh[0]["mkt_rf"] == pytest.approx(f[1]) and sh[-1]["mkt_rf"] is None
    ret = 0.0002 + 0.8 * f[1 : n + 1] + rf[1:] + rng.normal(0, 0.002, n)
    port = spark.createDataFrame([(day(i), float(ret[i])) for i in range(n)], "date date, return double")
    reg = factor_regression(port, factors, ["mkt_rf"]).toPandas().set_index("variable")
    y = (ret - rf[1:]) * 100
    x = f[1 : n + 1] * 100
    A = np.column_stack([np.ones(n), x])
    b = np.linalg.lstsq(A, y, rcond=None)[0]
    np.testing.assert_allclose(reg.loc[["Intercept", "mkt_rf"], "coefficient"], b, rtol=1e-9)


def test_last_date_is_dropped_from_regression(spark):
    # portfolio returns on every factor date: the last one has no shifted
    # factor (lead -> NULL) and must not enter the fit
    rng = np.random.default_rng(13)
    n = 40
    f = rng.normal(0, 0.01, n)
    factors = spark.createDataFrame(
        [(day(i), float(f[i]), 0.0001) for i in range(n)], "date date, mkt_rf double, rf double"
    )
    ret = 0.5 * np.roll(f, -1) + rng.normal(0, 0.001, n)
    ret[-1] = 123.0  # would wreck the fit if it were used
    port = spark.createDataFrame([(day(i), float(ret[i])) for i in range(n)], "date date, return double")
    reg = factor_regression(port, factors, ["mkt_rf"]).toPandas().set_index("variable")
    y = (ret[:-1] - 0.0001) * 100
    x = f[1:] * 100
    A = np.column_stack([np.ones(n - 1), x])
    b = np.linalg.lstsq(A, y, rcond=None)[0]
    np.testing.assert_allclose(reg.loc[["Intercept", "mkt_rf"], "coefficient"], b, rtol=1e-9)
