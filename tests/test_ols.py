import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import panel_df
from panelsignal.operators.ols import add_residual, add_rolling_ols, grouped_ols, simple_regression


def _panel(spark, n=40, assets=3, seed=0, k=3):
    rng = np.random.default_rng(seed)
    rows = []
    for a in range(assets):
        for i in range(n):
            x = rng.normal(0, 0.01, k)
            y = 0.001 + x @ np.arange(1, k + 1) * 0.5 + rng.normal(0, 0.005)
            rows.append((i, a, float(y), *map(float, x)))
    cols = ("date", "asset_id", "return_rf", *[f"f{j}" for j in range(k)])
    return panel_df(spark, rows, cols), rows


@pytest.mark.parametrize("k", [1, 3, 5])
@pytest.mark.parametrize("exact", [False, True])
def test_rolling_ols_matches_lstsq(spark, k, exact):
    df, rows = _panel(spark, k=k, seed=k)
    xs = [f"f{j}" for j in range(k)]
    w = 12
    out = add_rolling_ols(df, "return_rf", xs, w, exact=exact).toPandas()
    pdf = pd.DataFrame(rows, columns=["d", "a", "y", *xs])
    out = out.sort_values(["asset_id", "date"])
    for a, g in pdf.groupby("a"):
        o = out[out.asset_id == a].reset_index(drop=True)
        for t in range(len(g)):
            row = o.iloc[t]
            if t < w - 1:
                assert pd.isna(row["B_const"])
                continue
            win = g.iloc[t - w + 1 : t + 1]
            X = np.column_stack([np.ones(w), win[xs].to_numpy()])
            b = np.linalg.lstsq(X, win["y"].to_numpy(), rcond=None)[0]
            got = [row["B_const"], *[row[f"B_{x}"] for x in xs]]
            np.testing.assert_allclose(got, b, rtol=1e-8, atol=1e-10)


def test_collinear_window_gives_null(spark):
    rows = [(i, 1, 0.01 * i, 0.02, float(i)) for i in range(8)]  # f0 constant
    df = panel_df(spark, rows, ("date", "asset_id", "return_rf", "f0", "f1"))
    out = add_rolling_ols(df, "return_rf", ["f0", "f1"], 4).collect()
    assert all(r["B_f0"] is None and r["B_const"] is None for r in out)
    out1 = add_rolling_ols(df, "return_rf", ["f0"], 4).collect()
    assert all(r["B_f0"] is None for r in out1)
    # exactly collinear pair (f1 = 2 f0)
    rows = [(i, 1, 0.01 * i, float(i % 3), 2.0 * (i % 3)) for i in range(8)]
    df = panel_df(spark, rows, ("date", "asset_id", "return_rf", "f0", "f1"))
    out = add_rolling_ols(df, "return_rf", ["f0", "f1"], 4).collect()
    assert all(r["B_f0"] is None for r in out)


def test_filter_on_coefficients_plans_quickly(spark):
    # a filter on a coefficient must not be inlined into a huge expression
    df, _ = _panel(spark, n=30, assets=2, k=5)
    out = add_rolling_ols(df, "return_rf", [f"f{j}" for j in range(5)], 10)
    from panelsignal.plans.inspect import plan_summary

    kept = out.where(F.col("B_const").isNotNull())
    assert kept.count() == 2 * 21
    assert plan_summary(kept)["python_nodes"] == 0
    assert len(kept._jdf.queryExecution().optimizedPlan().toString()) < 100_000


def test_warmup_modes(spark):
    df, _ = _panel(spark, n=10, assets=1, k=1)
    df = add_rolling_ols(df, "return_rf", ["f0"], 4)
    raw = add_residual(df, "return_rf", ["f0"], "res", warmup="raw_excess").orderBy("date").collect()
    strict = add_residual(df, "return_rf", ["f0"], "res", warmup="strict").orderBy("date").collect()
    for i in range(3):
        assert raw[i]["res"] == pytest.approx(raw[i]["return_rf"])  # raw excess leaks in warm-up
        assert strict[i]["res"] is None
    assert raw[5]["res"] == pytest.approx(strict[5]["res"])


def test_residual_orthogonal_in_window(spark):
    df, _ = _panel(spark, n=30, assets=1, k=2)
    df = add_rolling_ols(df, "return_rf", ["f0", "f1"], 30)
    r = add_residual(df, "return_rf", ["f0", "f1"], "res", warmup="strict").toPandas()
    # the last row's coefficients fit all 30 rows: residuals orthogonal to regressors
    b = r.sort_values("date").iloc[-1]
    res = r["return_rf"] - (b["B_const"] + b["B_f0"] * r["f0"] + b["B_f1"] * r["f1"])
    assert abs(res.sum()) < 1e-12
    assert abs((res * r["f0"]).sum()) < 1e-14


def test_grouped_ols_tstats(spark):
    rng = np.random.default_rng(9)
    n = 200
    X = rng.normal(size=(n, 3))
    y = 0.2 + X @ [0.5, -0.3, 0.1] + rng.normal(size=n)
    rows = [(float(a), float(b), float(c), float(d)) for a, (b, c, d) in zip(y, X)]
    rows.append((None, 1.0, 1.0, 1.0))  # dropped
    df = spark.createDataFrame(rows, "y double, x0 double, x1 double, x2 double")
    got = grouped_ols(df, "y", ["x0", "x1", "x2"]).toPandas().set_index("variable")
    A = np.column_stack([np.ones(n), X])
    b = np.linalg.solve(A.T @ A, A.T @ y)
    res = y - A @ b
    s2 = res @ res / (n - 4)
    se = np.sqrt(s2 * np.diag(np.linalg.inv(A.T @ A)))
    np.testing.assert_allclose(got.loc[["Intercept", "x0", "x1", "x2"], "coefficient"], b, rtol=1e-9)
    np.testing.assert_allclose(got.loc[["Intercept", "x0", "x1", "x2"], "tstat"], b / se, rtol=1e-8)
    one = simple_regression(df, "y", "x0").toPandas().set_index("variable")
    A1 = np.column_stack([np.ones(n), X[:, 0]])
    b1 = np.linalg.solve(A1.T @ A1, A1.T @ y)
    r1 = y - A1 @ b1
    se1 = np.sqrt(r1 @ r1 / (n - 2) * np.diag(np.linalg.inv(A1.T @ A1)))
    np.testing.assert_allclose(one.loc[["Intercept", "x0"], "tstat"], b1 / se1, rtol=1e-8)


def test_grouped_ols_matches_pyspark_ml(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(21)
    n = 300
    X = rng.normal(size=(n, 2))
    y = 0.1 + X @ [0.7, -0.2] + rng.normal(size=n)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, (b, c) in zip(y, X)], "y double, x0 double, x1 double")
    ours = grouped_ols(df, "y", ["x0", "x1"]).toPandas().set_index("variable")
    feats = VectorAssembler(inputCols=["x0", "x1"], outputCol="f").transform(df)
    model = LinearRegression(featuresCol="f", labelCol="y", solver="normal").fit(feats)
    t = model.summary.tValues  # slopes first, intercept last
    np.testing.assert_allclose(ours.loc[["x0", "x1"], "coefficient"], model.coefficients.toArray(), rtol=1e-9)
    np.testing.assert_allclose(ours.loc["Intercept", "coefficient"], model.intercept, rtol=1e-9)
    np.testing.assert_allclose(ours.loc[["x0", "x1", "Intercept"], "tstat"], t, rtol=1e-7)
