"""Parquet hand-off tables.

Alphas and weights are partitioned tables under one root, keyed by
``signal`` (and ``gamma``, ``year`` for weights), so a reader's filter on
those keys prunes whole directories and concurrent signals never
overwrite one another (dynamic partition overwrite).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsignal.sources.schema import DATE


def write_alphas(alphas: DataFrame, path: str, signal: str | None = None) -> None:
    """Alphas partitioned by signal / year, in files of date ranges as :func:`write_weights` has them."""
    df = alphas if signal is None else alphas.withColumn("signal", F.lit(signal))
    (
        df.withColumn("year", F.year(DATE))
        .repartitionByRange("signal", DATE, "asset_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("signal", "year")
        .parquet(path)
    )


def write_weights(weights: DataFrame, path: str, signal: str | None = None, gamma: float | None = None) -> None:
    """Weights partitioned by signal / gamma / year (dynamic overwrite).

    Rows are range-partitioned by (signal, gamma, date, asset) before the
    write: tasks are balanced and each holds a contiguous date range, so it
    writes into one or two year directories (few files); no (signal, gamma,
    year) group, and thanks to the asset tie-breaker not even a single wide
    date, is funnelled through one task.
    """
    df = weights
    if signal is not None:
        df = df.withColumn("signal", F.lit(signal))
    if gamma is not None:
        df = df.withColumn("gamma", F.lit(float(gamma)))
    df = df.withColumn("year", F.year(DATE))
    (
        df.repartitionByRange("signal", "gamma", DATE, "asset_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("signal", "gamma", "year")
        .parquet(path)
    )


def read_weights(
    spark: SparkSession,
    path: str,
    signals: Sequence[str] | None = None,
    gammas: Sequence[float] | None = None,
    start=None,
    end=None,
    *,
    pairs: Sequence[tuple[str, float]] | None = None,
    ordered: bool = False,
) -> DataFrame:
    """One partitioned read; signal/gamma/date filters prune partitions.

    ``pairs``: the (signal, gamma) portfolios wanted, each with its own gamma (``signals`` and ``gammas`` filter
    independently of one another, so they'd also return a signal stored with another one's gamma).
    ``ordered`` (O2): rows come by (date, asset); a range sort, so no task holds a whole date.
    """
    df = spark.read.parquet(path)
    if pairs is not None:
        wanted = [(F.col("signal") == s) & (F.col("gamma") == F.lit(float(g))) for s, g in pairs]
        df = df.where(reduce(or_, wanted, F.lit(False)))
    if signals is not None:
        df = df.where(F.col("signal").isin(list(signals)))
    if gammas is not None:
        df = df.where(F.col("gamma").isin([float(g) for g in gammas]))
    if start is not None:
        df = df.where((F.col(DATE) >= F.lit(start)) & (F.col("year") >= F.lit(start.year)))
    if end is not None:
        df = df.where((F.col(DATE) <= F.lit(end)) & (F.col("year") <= F.lit(end.year)))
    return df.orderBy(DATE, "asset_id") if ordered else df


def read_alphas(spark: SparkSession, path: str, signals: Sequence[str] | None = None, start=None, end=None) -> DataFrame:
    """Stored alphas of some or all signals; signals and years prune folders, the dates row groups."""
    df = spark.read.parquet(path)
    if signals is not None:
        df = df.where(F.col("signal").isin(list(signals)))
    if start is not None:
        df = df.where((F.col(DATE) >= F.lit(start)) & (F.col("year") >= F.lit(start.year)))
    if end is not None:
        df = df.where((F.col(DATE) <= F.lit(end)) & (F.col("year") <= F.lit(end.year)))
    return df.drop("year")


def write_result(df: DataFrame, path: str) -> None:
    """A result table (summary, regression, cumulative series)."""
    df.write.mode("overwrite").parquet(path)
