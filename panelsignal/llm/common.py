"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsignal.session import scratch_path, shared_dir

#: ASCII white space, as a Java/RE2 character class body.
WS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the cluster's shared folder and read it back: cuts
    lineage, survives lost executors, and gives joins plain exchanges on both
    sides, so that adaptive execution may split skewed partitions."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own(prefix: str) -> str:
    """A column name that no caller's column clashes with."""
    return f"__{prefix}_{uuid.uuid4().hex[:8]}"


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` that ``names`` would not replace (in any case of letters, as withColumn has it)."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def split_count(n_rows: int, per_group: int) -> int:
    """How many groups of about ``per_group`` rows ``n_rows`` rows make."""
    return max(1, -(-int(n_rows) // per_group))


__all__ = ["WS", "others", "own", "scratch_path", "shared_dir", "split_count", "table", "text_or_empty", "written"]
