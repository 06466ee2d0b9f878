"""Test panels derived from the driver's TPC-H-like ``lineitem`` table.

The reference reads a vendor asset panel and a factor-return table that
are not public.  For tests and benchmarks we derive a panel with the
same shape from ``lineitem``: one row per (ship day, supplier).  The
formulas are fixed so that DuckDB can compute the identical panel.
Averages are rounded to 10 decimals right after the group-by so that
different summation orders cannot split ties between engines.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsignal.sources.schema import Span

# Fixed values of the derived fixture (shared with the SQL oracle).
FIXTURE_SPAN = Span(dt.date(1995, 1, 1), dt.date(2001, 12, 31))
RISK_FREE = 0.0001
ROUND = 10
#: Covariances of three style factors, upper triangle; every date scales them by 1 + 0.1 * (day number mod 7).
STYLE_COVARIANCE = {
    ("size", "size"): 0.0004,
    ("size", "activity"): 0.00006,
    ("size", "discount"): -0.00004,
    ("activity", "activity"): 0.0001,
    ("activity", "discount"): 0.00003,
    ("discount", "discount"): 0.0002,
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """(date, asset_id) panel; return/specific_return/specific_risk in percent."""
    li = lineitem.select(
        F.to_date("l_shipdate").alias("date"),
        F.col("l_suppkey").cast("long").alias("asset_id"),
        "l_extendedprice",
        "l_quantity",
        "l_discount",
        "l_tax",
        "l_linenumber",
    )
    r = lambda c: F.round(c, ROUND)
    # Grouped by (date, asset) with map-side partial aggregation: a supplier
    # holding a large share of lineitem is spread over its dates, and only
    # the aggregated panel (at most one row per date per asset) is shuffled
    # by asset for the windows downstream.
    return li.groupBy("date", "asset_id").agg(
        r(F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"),
        r(F.lit(100.0) * (F.avg("l_discount") - F.lit(0.05))).alias("return"),
        r(F.lit(100.0) * (F.avg("l_tax") - F.lit(0.04))).alias("specific_return"),
        r(F.avg("l_quantity")).alias("specific_risk"),
        r(F.lit(0.5) + F.avg("l_linenumber") / F.lit(4.0)).alias("predicted_beta"),
    )


def factors_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """One row per date: mkt_rf, smb, hml, rmw, cma, rf (fractions)."""
    li = lineitem.select(
        F.to_date("l_shipdate").alias("date"),
        "l_quantity",
        "l_discount",
        "l_tax",
        "l_returnflag",
        "l_linestatus",
        "l_linenumber",
    )

    def spread(value: str, cond_a, cond_b):
        a = F.avg(F.when(cond_a, F.col(value)))
        b = F.avg(F.when(cond_b, F.col(value)))
        return F.round(F.coalesce(a - b, F.lit(0.0)), ROUND)

    return li.groupBy("date").agg(
        F.round(F.avg("l_discount") - F.lit(0.05), ROUND).alias("mkt_rf"),
        spread("l_discount", F.col("l_quantity") <= 25, F.col("l_quantity") > 25).alias("smb"),
        spread("l_discount", F.col("l_returnflag") == "A", F.col("l_returnflag") == "N").alias("hml"),
        spread("l_tax", F.col("l_linestatus") == "O", F.col("l_linestatus") == "F").alias("rmw"),
        spread("l_tax", F.col("l_linenumber") <= 3, F.col("l_linenumber") > 3).alias("cma"),
        F.lit(RISK_FREE).alias("rf"),
    )


def exposures_from_lineitem(lineitem: DataFrame, supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """Long exposures (date, asset_id, factor, exposure) for factor-risk tests.

    Style factors from the same (date, supplier) group; plus a one-hot
    region of the supplier's nation.
    """
    li = lineitem.select(
        F.to_date("l_shipdate").alias("date"),
        F.col("l_suppkey").cast("long").alias("asset_id"),
        "l_extendedprice",
        "l_quantity",
        "l_discount",
    )
    r = lambda c: F.round(c, ROUND)
    style = li.groupBy("date", "asset_id").agg(
        r(F.log(F.sum("l_extendedprice") / F.sum("l_quantity"))).alias("size"),
        r(F.avg("l_quantity") / F.lit(50.0)).alias("activity"),
        r(F.avg("l_discount") * F.lit(20.0)).alias("discount"),
    )
    region = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        F.col("s_suppkey").cast("long").alias("asset_id"),
        F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")).alias("region"),
    )
    long_style = style.select(
        "date",
        "asset_id",
        F.expr("stack(3, 'size', size, 'activity', activity, 'discount', discount) as (factor, exposure)"),
    )
    one_hot = style.select("date", "asset_id").join(region, "asset_id").select(
        "date", "asset_id", F.col("region").alias("factor"), F.lit(1.0).alias("exposure")
    )
    return long_style.unionByName(one_hot)


def covariances_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """A full style covariance matrix per ship date: (date, factor_i, factor_j, value), upper triangle."""
    entries = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(v).alias("v")) for (i, j), v in STYLE_COVARIANCE.items()]
    )
    dates = lineitem.select(F.to_date("l_shipdate").alias("date")).distinct()
    scale = F.lit(1.0) + F.lit(0.1) * F.pmod(F.unix_date("date"), F.lit(7))
    e = dates.select("date", scale.alias("scale"), F.explode(entries).alias("e"))
    return e.select("date", F.col("e.i").alias("factor_i"), F.col("e.j").alias("factor_j"), (F.col("e.v") * F.col("scale")).alias("value"))
