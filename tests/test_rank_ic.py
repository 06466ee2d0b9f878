"""Rank ICs from packed values: against pandas, whatever the chunk, and keys too wide for one group."""

import math
import random

import pytest
from conftest import day
from pyspark.sql import functions as F

from panelsignal.operators.ic import information_coefficient, ranked_correlation


def pairs(spark):
    rnd = random.Random(3)
    rows = [(day(d), s, float(rnd.randrange(6)), rnd.gauss(0, 1)) for d in range(4) for s in "xy" for _ in range(40 if d else 9)]
    rows += [(day(7), "x", 1.0, 2.0), (day(8), "x", 1.0, 2.0), (day(8), "x", 1.0, 3.0), (day(9), "y", -0.0, 1.0)]
    rows += [(day(9), "y", 0.0, 2.0), (day(9), "y", 3.0, 3.0)]
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "date date, signal string, __a double, __r double")


def expected(rows):
    import pandas as pd

    out = {}
    for k, g in pd.DataFrame(rows, columns=["date", "signal", "a", "r"]).groupby(["date", "signal"]):
        ic = g["a"].rank().corr(g["r"].rank()) if len(g) > 1 else math.nan
        out[k] = (len(g), None if math.isnan(ic) else ic)
    return out


@pytest.mark.parametrize("key_rows,pack_rows", [(1 << 21, 1 << 19), (1 << 21, 1), (20, 5), (0, 100)])
def test_rank_correlations_equal_pandas(spark, key_rows, pack_rows):
    rows, df = pairs(spark)
    got = ranked_correlation(df.repartition(3), ["date", "signal"], key_rows=key_rows, pack_rows=pack_rows)
    got = {(r.date, r.signal): (r.n, r.ic) for r in got.collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    for k, (n, ic) in want.items():
        assert got[k][0] == n
        assert got[k][1] == (None if ic is None else pytest.approx(ic, abs=1e-12)), k


def test_rank_ic_moves_packs_not_rows(spark):
    _, df = pairs(spark)
    df = df.select("date", "signal", F.col("__a").alias("alpha"), F.col("__r").alias("fwd_return"))
    out = information_coefficient(df, keys=("date", "signal"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Window" not in plan and "SortMergeJoin" not in plan
    assert information_coefficient(df.where("false"), keys=("date", "signal")).count() == 0
