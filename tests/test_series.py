"""The numpy asset stage against the window operators (sliding frames), over chunks of a few rows."""

import datetime as dt
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from panelsignal.operators.alpha import prev_and_forward_lags
from panelsignal.operators.series import add_series_signals
from panelsignal.operators.signals import FF3, SignalSpec, add_signals
from panelsignal.plans.inspect import plan_summary

SPECS = [
    SignalSpec("plain", "return", (), 4, 2),
    SignalSpec("scaled", "return", (), 4, 2, 5),
    SignalSpec("one", "residual", ("mkt_rf",), 3, 1, None, ols_window=6),
    SignalSpec("three", "residual", FF3, 5, 2, 4, ols_window=8),
    SignalSpec("strict", "residual", FF3, 3, 0, None, ols_window=8, warmup="strict"),
]


def series_frame(spark, assets=(1, 2, 3, 4, None), longest=60):
    rnd, rows = random.Random(5), []
    for n, a in enumerate(assets):
        for d in range((longest, 5, 1, 23, 17)[n]):
            x = [rnd.gauss(0, 0.02) for _ in range(7)]
            if rnd.random() < 0.06:
                x[rnd.randrange(6)] = rnd.choice([None, math.nan, math.inf, -1.0])
            if a == 4 and d < 12:
                x[2] = 0.01  # a constant regressor
            rows.append((dt.date(2020, 1, 1) + dt.timedelta(days=3 * d), a, *x))
    rnd.shuffle(rows)
    cols = "price double, return double, mkt_rf double, smb double, hml double, rf double, other double"
    df = spark.createDataFrame(rows, f"date date, asset_id long, {cols}")
    return df.withColumn("return_rf", F.col("return") - F.col("rf"))


def table(df):
    return {(r["asset_id"], r["date"]): r.asDict() for r in df.collect()}


@pytest.mark.parametrize("chunk", [1, 7, 40, 1 << 16])
def test_series_signals_equal_sliding_windows(spark, chunk):
    df = series_frame(spark)
    lags = prev_and_forward_lags(df.columns) | {"twice": (F.col("other") * 2, 3)}
    want = add_signals(df, SPECS, exact=True, extra_lags=lags)
    got = add_series_signals(df, SPECS, lags=lags, chunk=chunk)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    want, got = table(want), table(got)
    assert want.keys() == got.keys()
    for k, w in want.items():
        for c, x in w.items():
            y = got[k][c]
            assert (x is None) == (y is None), (k, c, x, y)
            if isinstance(x, float) and math.isfinite(x):
                assert y == pytest.approx(x, rel=1e-7, abs=1e-10), (k, c)
            elif isinstance(x, float):
                assert repr(x) == repr(y)
    for s in SPECS:
        assert sum(w[s.name] is not None for w in want.values()) > 5


def test_another_assets_values_cost_no_digits(spark):
    df = series_frame(spark).withColumn("return", F.when(F.col("asset_id") == 1, 1e9).otherwise(F.col("return")))
    df = df.withColumn("return_rf", F.col("return") - F.col("rf"))
    want, got = table(add_signals(df, SPECS, exact=True)), table(add_signals(df, SPECS))
    for k, w in want.items():
        if k[0] in (4, None):
            for s in SPECS:
                assert got[k][s.name] == (None if w[s.name] is None else pytest.approx(w[s.name], rel=1e-7, abs=1e-10))


def test_regressions_need_no_window_operator(spark):
    df = series_frame(spark)
    out = add_signals(df, SPECS, extra_lags=prev_and_forward_lags(df.columns))
    out.collect()
    s = plan_summary(out)
    assert s["asset_exchanges"] == 1 and s["sorts"] == 1 and s["windows"] == 0, s


def test_empty_panel_and_unknown_warmup(spark):
    df = series_frame(spark)
    assert add_signals(df.where("false"), SPECS).count() == 0
    with pytest.raises(ValueError, match="warmup"):
        add_signals(df, [SPECS[2].with_(warmup="none")])


def test_tasks_need_no_package(spark):
    # executors have numpy and pyarrow, not this package
    from pyspark import cloudpickle

    from panelsignal.operators import series

    made = {}

    class Frame:
        def __init__(self, df):
            self.df = df

        def mapInArrow(self, run, schema):
            made["run"] = run
            return self.df

    df = series_frame(spark)
    sort = type(df).sortWithinPartitions
    try:
        type(df).sortWithinPartitions = lambda self, *c: Frame(sort(self, *c))
        series.add_series_signals(df, SPECS)
    finally:
        type(df).sortWithinPartitions = sort
    assert b"panelsignal.operators.signals" not in cloudpickle.dumps(made["run"])


def test_what_is_read_twice_is_written_once(spark):
    from panelsignal.plans.queries import Fixture, long_weights

    path = "/root/testdata/sf0.001"
    if not os.path.exists(path):
        pytest.skip("driver test data not present")
    fx = Fixture(spark, path)
    assert fx.style_risk is fx.style_risk
    for df in (fx.style_risk[0], long_weights(fx, "parquet")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Scan parquet" in plan and "Aggregate" not in plan and "Exchange" not in plan, plan


def test_unpivot_keeps_null_alphas_inside_and_runs_compiled(spark):
    from panelsignal.operators.alpha import unpivot_alphas

    rows = [(1, 0.5, None, True, True), (2, None, 2.0, False, True), (3, None, None, False, False)]
    wide = spark.createDataFrame(rows, "asset_id long, a double, b double, in_a boolean, in_b boolean")
    long = unpivot_alphas(wide, ["a", "b"])
    assert sorted(map(tuple, long.collect()), key=str) == [(1, "a", 0.5), (1, "b", None), (2, "b", 2.0)]
    assert "lambda" not in long._jdf.queryExecution().executedPlan().toString()
