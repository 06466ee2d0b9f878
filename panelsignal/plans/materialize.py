"""Materialising a frame that several consumers read.

The per-date statistics pattern (partial aggregate, broadcast back) reads
its input twice; Spark reuses the shuffle below it but recomputes the
window operators above it for every consumer.  When that input is the
expensive asset stage (rolling sums, regressions, many signals) we write
it once with a *reliable* checkpoint into the cluster's shared
``spark.checkpoint.dir``: it cuts the lineage, survives executor loss,
and keeps the asset partitioning for later joins.  Wide rows of which each
consumer reads some columns are written as Parquet there instead (``parquet``).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from panelsignal.session import scratch_path, shared_dir


def materialize(df: DataFrame, how: str | None = "checkpoint") -> DataFrame:
    if how is None or how == "none":
        return df
    if how == "checkpoint":
        shared_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    if how == "parquet":
        path = scratch_path(df.sparkSession, "rows")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    if how == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    raise ValueError(f"unknown materialisation {how!r}")
