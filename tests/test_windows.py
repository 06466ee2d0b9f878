import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import panel_df
from panelsignal.operators.signals import add_momentum
from panelsignal.operators.windows import add_lags, add_rolling_std, add_rolling_sums


def collect(df, *cols):
    return {(r["asset_id"], r["date"]): tuple(r[c] for c in cols) for r in df.collect()}


def test_gap_rows_are_row_based(spark):
    # asset 1 misses dates 2 and 3: lag/lead count rows, not days
    rows = [(0, 1, 0.01), (1, 1, 0.02), (4, 1, 0.03), (5, 1, 0.04)]
    df = add_lags(panel_df(spark, rows), {"prev": ("return", 1), "nxt": ("return", -1)})
    got = sorted((r["date"].day, r["prev"], r["nxt"]) for r in df.collect())
    assert got == [(1, None, 0.02), (2, 0.01, 0.03), (5, 0.02, 0.04), (6, 0.03, None)]


@pytest.mark.parametrize("exact", [False, True])
def test_rolling_sum_needs_full_window(spark, exact):
    rows = [(i, 1, float(i)) for i in range(6)]
    rows[3] = (3, 1, None)  # null inside the window
    df = add_rolling_sums(panel_df(spark, rows), {"s": F.col("return")}, 3, exact=exact)
    got = [r["s"] for r in df.orderBy("date").collect()]
    # windows: [0..2]=3, [1..3] has null, [2..4] has null, [3..5] has null
    assert got == [None, None, 3.0, None, None, None]


@pytest.mark.parametrize("exact", [False, True])
def test_prefix_equals_sliding_random(spark, exact):
    rng = np.random.default_rng(1)
    rows = []
    for a in range(4):
        for i in range(60):
            v = None if rng.random() < 0.05 else float(rng.normal(0, 0.02))
            rows.append((i, a, v))
    base = panel_df(spark, rows)
    df = add_rolling_sums(base, {"s": F.col("return")}, 7, exact=exact)
    df = add_rolling_std(df, "return", 7, "sd", exact=exact)
    pdf = df.toPandas().sort_values(["asset_id", "date"])
    for a, g in pdf.groupby("asset_id"):
        r = g["return"].rolling(7, min_periods=7)
        exp_s = r.sum().where(g["return"].rolling(7, min_periods=1).count() == 7)
        exp_sd = r.std().where(g["return"].rolling(7, min_periods=1).count() == 7)
        np.testing.assert_allclose(g["s"].astype(float), exp_s.astype(float), atol=1e-12, equal_nan=True)
        np.testing.assert_allclose(g["sd"].astype(float), exp_sd.astype(float), atol=1e-12, equal_nan=True)


def test_constant_window_std_is_null(spark):
    rows = [(i, 1, 0.02) for i in range(8)]
    for exact in (False, True):
        df = add_rolling_std(panel_df(spark, rows), "return", 4, "sd", exact=exact)
        assert all(r["sd"] is None for r in df.collect())


def test_ruin_return_log_is_null(spark):
    # return -100 % and below has no log return: every window holding it is NULL
    rows = [(0, 1, 0.1), (1, 1, -1.0), (2, 1, 0.1), (3, 1, 0.1), (4, 1, -1.5), (5, 1, 0.2), (6, 1, 0.2), (7, 1, 0.2)]
    df = add_momentum(panel_df(spark, rows), "return", "m", lookback=2, skip=1)
    got = [r["m"] for r in df.orderBy("date").collect()]
    lp = math.log1p
    # 2-row sums valid at rows 3, 6, 7; shifted one row later
    assert got[:4] == [None, None, None, None]
    assert got[4] == pytest.approx(lp(0.1) + lp(0.1))
    assert got[5:7] == [None, None]
    assert got[7] == pytest.approx(lp(0.2) * 2)


def test_momentum_micro_window_3_skip_1(spark):
    r = [0.01, 0.02, -0.01, 0.03, 0.00, 0.05]
    rows = [(i, 7, v) for i, v in enumerate(r)]
    df = add_momentum(panel_df(spark, rows), "return", "m", lookback=3, skip=1)
    got = [x["m"] for x in df.orderBy("date").collect()]
    lp = np.log1p(r)
    assert got[:3] == [None, None, None]
    assert got[3] == pytest.approx(lp[0:3].sum())
    assert got[4] == pytest.approx(lp[1:4].sum())
    assert got[5] == pytest.approx(lp[2:5].sum())


def test_vol_scaled_momentum_matches_pandas(spark):
    rng = np.random.default_rng(3)
    r = rng.normal(0.001, 0.02, 40)
    rows = [(i, 2, float(v)) for i, v in enumerate(r)]
    df = add_momentum(panel_df(spark, rows), "return", "m", lookback=10, skip=2, vol_window=10)
    got = pd.Series([x["m"] for x in df.orderBy("date").collect()], dtype=float)
    s = pd.Series(r)
    exp = (np.log1p(s).rolling(10).sum() / s.rolling(10).std()).shift(2)
    np.testing.assert_allclose(got, exp, atol=1e-12, equal_nan=True)


def test_price_levels_over_a_long_series_are_as_exact_as_sliding_frames(spark):
    """Errors don't grow with the series, and a level far from zero costs no digits of the deviation."""
    rng = np.random.default_rng(8)
    level = 1000.0 + np.cumsum(rng.normal(0, 0.5, 7000))
    df = panel_df(spark, [(i, 1, float(v)) for i, v in enumerate(level)])
    out = {}
    for exact in (False, True):
        d = add_rolling_sums(df, {"s": F.col("return")}, 230, exact=exact)
        d = add_rolling_std(d, "return", 230, "sd", exact=exact)
        out[exact] = d.orderBy("date").toPandas()[["s", "sd"]].astype(float)
    np.testing.assert_allclose(out[False], out[True], rtol=1e-9, equal_nan=True)
    exp = pd.Series(level).rolling(230).std()
    np.testing.assert_allclose(out[False]["sd"], exp, rtol=1e-9, equal_nan=True)


def test_windows_of_several_lengths_share_one_pass(spark):
    from panelsignal.operators.windows import add_rolling_totals

    rng = np.random.default_rng(9)
    values = rng.normal(size=(3, 50))
    df = panel_df(spark, [(i, a, float(values[a, i])) for a in range(3) for i in range(50)])
    wanted = {"a": ("x", 1), "b": ("x", 4), "c": ("x", 13), "d": ("y", 7), "e": ("y", 13)}
    got = add_rolling_totals(df, {"x": "`return`", "y": "`return` * 2"}, wanted)
    assert got.columns == [*df.columns, *wanted]
    got = got.toPandas().sort_values(["asset_id", "date"])
    for a, g in got.groupby("asset_id"):
        for out, (s, n) in wanted.items():
            exp = pd.Series(values[a] * (2 if s == "y" else 1)).rolling(n, min_periods=1).sum()
            np.testing.assert_allclose(g[out], exp, atol=1e-12)
