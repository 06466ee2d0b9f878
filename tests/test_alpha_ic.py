import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import day, panel_df
from panelsignal.operators.alpha import add_zscore, alphas_from_signal, forward_returns, universe_filter
from panelsignal.operators.ic import add_cumulative_ic, add_rolling_ic, information_coefficient

COLS = ("date", "asset_id", "sig", "prev_price", "predicted_beta", "specific_risk")


def test_single_asset_date_has_null_score(spark):
    rows = [(0, 1, 0.5, 10.0, 1.0, 0.2), (1, 1, 0.4, 10.0, 1.0, 0.2), (1, 2, 0.1, 10.0, 1.0, 0.3)]
    al = alphas_from_signal(panel_df(spark, rows, COLS), "sig", price_min=5, ic=0.05)
    got = {(r["date"], r["asset_id"]): r["alpha"] for r in al.collect()}
    assert got[(day(0), 1)] is None  # kept, alpha NULL
    # two assets: z = +-1/sqrt(2)
    assert got[(day(1), 1)] == pytest.approx(1 / np.sqrt(2) * 0.05 * 0.2)
    assert got[(day(1), 2)] == pytest.approx(-1 / np.sqrt(2) * 0.05 * 0.3)


def test_constant_signal_date_has_null_score(spark):
    rows = [(0, a, 0.3, 10.0, 1.0, 0.2) for a in range(4)]
    z = add_zscore(panel_df(spark, rows, COLS), "sig")
    assert all(r["score"] is None for r in z.collect())


def test_zscore_properties(spark):
    rng = np.random.default_rng(5)
    rows = [(d, a, float(rng.normal()), 10.0, 1.0, 0.2) for d in range(5) for a in range(30)]
    z = add_zscore(panel_df(spark, rows, COLS), "sig").toPandas()
    g = z.groupby("date")["score"]
    np.testing.assert_allclose(g.mean(), 0, atol=1e-12)
    np.testing.assert_allclose(g.std(ddof=1), 1, atol=1e-12)


def test_universe_filter_is_strict_and_requires_fields(spark):
    rows = [
        (0, 1, 0.1, 5.0, 1.0, 0.2),  # price exactly at the bound: out
        (0, 2, 0.1, 5.01, 1.0, 0.2),  # in
        (0, 3, None, 9.0, 1.0, 0.2),  # no signal: out
        (0, 4, 0.1, 9.0, None, 0.2),  # no beta: out
        (0, 5, 0.1, 9.0, 1.0, None),  # no risk: out
        (0, 6, 0.1, None, 1.0, 0.2),  # first row of an asset (no previous price): out
    ]
    f = universe_filter(panel_df(spark, rows, COLS), "sig", 5.0)
    assert sorted(r["asset_id"] for r in f.collect()) == [2]


def test_forward_returns_drop_last_row(spark):
    rows = [(0, 1, 0.01), (1, 1, 0.02), (2, 1, 0.03), (0, 2, 0.05)]
    fw = forward_returns(panel_df(spark, rows))
    got = sorted((r["asset_id"], r["date"].day, r["fwd_return"]) for r in fw.collect())
    assert got == [(1, 1, 0.02), (1, 2, 0.03)]


def _ic_frame(spark, rows):
    return panel_df(spark, rows, ("date", "asset_id", "alpha", "fwd_return"))


def test_rank_ic_average_ties_matches_pandas(spark):
    rows = [(0, 1, 0.3, 0.01), (0, 2, 0.3, 0.03), (0, 3, 0.1, -0.02), (0, 4, 0.5, 0.03), (0, 5, 0.2, 0.00)]
    ic = information_coefficient(_ic_frame(spark, rows), method="rank").collect()[0]
    pdf = pd.DataFrame(rows, columns=["d", "a", "alpha", "r"])
    exp = pdf["alpha"].rank().corr(pdf["r"].rank())
    assert ic["ic"] == pytest.approx(exp, abs=1e-12)
    assert ic["n"] == 5


def test_ic_guards_and_invariance(spark):
    rng = np.random.default_rng(2)
    rows = []
    for d in range(4):
        for a in range(20):
            rows.append((d, a, float(rng.normal()), float(rng.normal())))
    rows.append((9, 1, 0.2, 0.1))  # single row -> NULL
    rows += [(10, a, 0.7, float(a)) for a in range(5)]  # constant alpha -> NULL
    rows += [(11, 1, None, 0.1), (11, 2, 0.3, None)]  # no complete pair -> no row
    df = _ic_frame(spark, rows)
    for method in ("rank", "pearson"):
        got = {r["date"].day: r["ic"] for r in information_coefficient(df, method=method).collect()}
        assert got[10] is None and got[11] is None
        assert 12 not in got
        assert all(-1 <= v <= 1 for k, v in got.items() if v is not None)
    # rank IC is invariant under a monotone transform of alpha
    t = df.withColumn("alpha", F.exp(F.col("alpha") * 3))
    a = {r["date"]: r["ic"] for r in information_coefficient(df, method="rank").collect()}
    b = {r["date"]: r["ic"] for r in information_coefficient(t, method="rank").collect()}
    for k in a:
        if a[k] is not None:
            assert a[k] == pytest.approx(b[k], abs=1e-12)


def test_rank_of_a_hot_date_with_a_hot_value_matches_pandas(spark):
    rng = np.random.default_rng(6)
    rows = [(0, a, float(rng.normal()) if a % 3 else 0.0, float(rng.normal() * 10.0 ** int(rng.integers(-8, 8)))) for a in range(3000)]
    rows += [(1, a, float(a), -float(a)) for a in range(5)]
    got = {r["date"]: r["ic"] for r in information_coefficient(_ic_frame(spark, rows)).collect()}
    pdf = pd.DataFrame(rows, columns=["d", "a", "alpha", "r"])
    for d, g in pdf.groupby("d"):
        # values are rounded before ranking, which ties the tiniest of them
        exp = g["alpha"].round(10).rank().corr(g["r"].round(10).rank())
        assert got[day(d)] == pytest.approx(exp, abs=1e-12)


def test_ic_of_two_frames(spark):
    rows = [(0, a, 0.1 * a, 0.01 * (a % 3)) for a in range(6)]
    both = _ic_frame(spark, rows)
    alphas, returns = both.select("date", "asset_id", "alpha"), both.where("asset_id < 5").select("date", "asset_id", "fwd_return")
    (split,), (merged,) = information_coefficient(alphas, returns).collect(), information_coefficient(both.where("asset_id < 5")).collect()
    assert split == merged and split["n"] == 5


def test_split_rank_matches_pandas_with_hot_date_and_hot_value(spark):
    from panelsignal.operators.ic import add_average_rank

    rng = np.random.default_rng(4)
    rows = []
    for a in range(3000):  # one wide date, a third of it a single repeated value
        v = 0.5 if a % 3 == 0 else float(np.round(rng.normal(), 3))
        rows.append((0, a, v))
    for d in range(1, 4):
        rows += [(d, a, float(rng.normal())) for a in range(20)]
    rows.append((1, 99, None))
    df = panel_df(spark, rows, ("date", "asset_id", "v"))
    got = add_average_rank(df, "v", "r").toPandas()
    pdf = pd.DataFrame(rows, columns=["d", "asset_id", "v"])
    pdf["exp"] = pdf.groupby("d")["v"].rank(method="average")
    m = got.merge(pdf.assign(date=pdf.d.map(day)), on=["date", "asset_id"])
    assert len(m) == len(rows)
    np.testing.assert_allclose(m["r"].astype(float), m["exp"].astype(float), equal_nan=True)


def test_rank_spreads_a_hot_key_and_a_hot_value(spark):
    """One date holds most rows and one value a third of all: no partition gets more than a few times its share."""
    from panelsignal.operators import ic

    rng = np.random.default_rng(6)
    rows = [(0, a, 0.25 if a % 3 == 0 else float(np.round(rng.normal(), 2))) for a in range(12_000)]
    rows += [(d, a, None if a == 3 else float(a % 4)) for d in range(1, 30) for a in range(40)]
    df = panel_df(spark, rows, ("date", "asset_id", "v"))
    kept, plain = [], ic.materialize

    def keep(frame, how):
        kept.append(plain(frame, how))
        return kept[-1]

    ic.materialize = keep
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few bytes are one partition
    try:
        got = ic.add_average_rank(df, "v", "r").toPandas()
    finally:
        ic.materialize = plain
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in kept[0].groupBy("__rk_part").count().collect()]
    hot = [r["count"] for r in kept[0].where("v = 0.25").groupBy("__rk_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * len(rows) / 8 and len(hot) > 1
    pdf = pd.DataFrame(rows, columns=["d", "asset_id", "v"])
    pdf["exp"] = pdf.groupby("d")["v"].rank(method="average")
    m = got.merge(pdf.assign(date=pdf.d.map(day)), on=["date", "asset_id"])
    assert len(m) == len(rows)
    np.testing.assert_allclose(m["r"].astype(float), m["exp"].astype(float), equal_nan=True)


def test_rolling_and_cumulative_ic(spark):
    rows = [(d, float(d) / 10) for d in range(6)]
    ics = spark.createDataFrame([(day(d), v) for d, v in rows], "date date, ic double")
    r = add_cumulative_ic(add_rolling_ic(ics, 3)).orderBy("date").collect()
    assert [x["ic_rolling"] for x in r][:2] == [None, None]
    assert r[2]["ic_rolling"] == pytest.approx(0.1)
    assert r[5]["ic_cumulative"] == pytest.approx(1.5)
