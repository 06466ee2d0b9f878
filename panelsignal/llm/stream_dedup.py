"""Exact deduplication with streaming, disk-backed keyed state.

A digest feed of the documents (digest, stable id, content locator) is landed
in the shared folder and consumed by Structured Streaming.  The keyed state
lives in RocksDB under the query's checkpoint and has no watermark, hence no
expiry: per digest it holds the largest (id, locator) and the number of rows
seen.  Rows are partially aggregated before the shuffle, so a text that a
third of all rows share reaches its state partition as one row per map task.
The state table is read back from the checkpoint when the stream has drained.

Hits (digests seen more than once) are then checked on their full bytes: their
texts are grouped by (digest, text) and any digest under which two different
texts sit is decided by the texts themselves.  Results are therefore exact for
any digest function, however weak.

Defined results: null texts count as empty; of equal texts the row with the
largest id stays (null ids are smallest; of rows equal in id and text, exactly
one stays); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelsignal.llm.common import own, scratch_path, text_or_empty, written

_STORE = "spark.sql.streaming.stateStore."
#: State on disk; without preallocated files, which would cost some MB for each of many small partitions.
STATE_CONF = {
    _STORE + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    _STORE + "rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def land_feed(docs: DataFrame, digest: Callable[[Column], Column], id_col: str, text: str) -> DataFrame:
    """(doc_id, locator, digest, sha) of every row, written to the shared folder.

    The locator is the row's number in the feed; it is fixed once written.
    """
    t = text_or_empty(text)
    return written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.monotonically_increasing_id().alias("locator"),
            digest(t).alias("digest"),
            sha256(t).alias("sha"),
        ),
        "dedup-feed",
    )


def drain(feed_path: str, feed: DataFrame, files_per_batch: int = 1000) -> DataFrame:
    """Run the feed through the keyed state; the final state as (digest, doc_id, locator, n)."""
    spark = feed.sparkSession
    checkpoint = scratch_path(spark, "dedup-state")
    stream = (
        spark.readStream.schema(feed.schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(feed_path)
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count("*").alias("n"))
    )
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        query = (
            stream.writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return written(_state(spark, checkpoint), "dedup-groups")
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _state(spark: SparkSession, checkpoint: str) -> DataFrame:
    state = spark.read.format("statestore").load(checkpoint)
    keep, n = [f.name for f in state.schema["value"].dataType.fields]
    return state.select(
        F.col("key")["digest"].alias("digest"),
        F.col("value")[keep]["doc_id"].alias("keep_id"),
        F.col("value")[keep]["locator"].alias("keep_locator"),
        F.col("value")[n].alias("group_size"),
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int = 1000,
) -> DataFrame:
    """One row per document: doc_id, locator, sha (binary SHA-256), keep_id, group_size, kept."""
    feed = land_feed(docs, digest, id_col, text)
    if not feed.inputFiles():  # nothing was written: a stream over an empty folder has no state to read
        return feed.select("doc_id", "locator", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    path = feed.inputFiles()[0].rsplit("/", 1)[0]
    state = drain(path, feed, files_per_batch)

    # full bytes of the hits; grouping by the text compares every byte
    hits = written(
        docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text).alias("text"))
        .withColumn("digest", digest(F.col("text")))
        .join(state.where("group_size > 1").select("digest"), "digest", "left_semi"),
        "dedup-hits",
    )
    clashing = written(
        hits.groupBy("digest", "text").agg(F.lit(1).alias("one")).groupBy("digest").count().where("count > 1").select("digest"),
        "dedup-clashes",
    )

    plain = (
        feed.join(clashing, "digest", "left_anti")
        .join(state, "digest")
        .select(
            "doc_id",
            "locator",
            "sha",
            "keep_id",
            "group_size",
            (F.col("locator") == F.col("keep_locator")).alias("kept"),
        )
    )
    # digests shared by different texts: the text itself is the key
    odd = written(
        hits.join(clashing, "digest", "left_semi").select(
            "doc_id", "text", F.monotonically_increasing_id().alias("locator")
        ),
        "dedup-by-text",
    )
    by_text = odd.groupBy("text").agg(F.max(F.struct("doc_id", "locator")).alias("k"), F.count("*").alias("group_size"))
    clashed = odd.join(by_text, "text").select(
        "doc_id",
        (-F.col("locator") - 1).alias("locator"),  # apart from the feed's numbers
        sha256(F.col("text")).alias("sha"),
        F.col("k.doc_id").alias("keep_id"),
        "group_size",
        (F.col("locator") == F.col("k.locator")).alias("kept"),
    )
    return plain.unionByName(clashed)


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with exactly the columns they came with.

    Decisions are joined back on (id, SHA-256); of rows equal in both, one is
    taken by a row number within that pair.
    """
    kid, ksha, one = own("id"), own("sha"), own("n")
    verdict = exact_dedup(docs, id_col, text).where("kept").select(F.col("doc_id").alias(kid), F.col("sha").alias(own_sha := own("vsha")))
    rows = docs.withColumn(ksha, sha256(text_or_empty(text)))
    same = F.col(ksha).eqNullSafe(F.col(own_sha)) & F.col(id_col).eqNullSafe(F.col(kid))
    first = Window.partitionBy(id_col, ksha).orderBy(F.lit(1))
    stay = rows.join(verdict, same, "left_semi").withColumn(one, F.row_number().over(first)).where(F.col(one) == 1)
    return stay.drop(one, ksha)
