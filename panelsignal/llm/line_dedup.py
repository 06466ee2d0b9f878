"""Line deduplication by counted line hashes.

Lines are exploded with their position, normalised to a key (ASCII blanks
stripped at both ends, A-Z lower-cased) and hashed to 128 bits; distinct
documents are counted per hash with map-side partial aggregation, so a line
that sits in a third of all documents reaches the shuffle as one row per map
task.  Keys over the threshold lose all lines except those of the largest
document id that holds them; the positions to drop are gathered per document
(bounded by the document's own lines) and the text is put together again from
the positions that stay.

The counts are written to the shared folder before the skewed join, so both
join sides are plain exchanges that adaptive execution can split.

Defined results: a null or empty text is one empty line; a key counts once per
row of the table (rows are documents, a repeated id included; all rows of the
largest id keep a line); a null id is smaller than any other; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsignal.llm.common import WS, own, text_or_empty, written

MIN_CHARS = 40
MIN_DOCS = 5


def line_key(line: Column) -> Column:
    # translate lowers A-Z only; lower() would also fold other letters
    bare = F.regexp_replace(line, f"^[{WS}]+|[{WS}]+$", "")
    return F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _row_key(id_col: str) -> Column:
    """128 bits of (id, text): equal rows share it, which is harmless as they drop the same lines."""
    return F.unhex(F.md5(F.concat_ws("\x01", F.coalesce(F.col(id_col).cast("string"), F.lit("\x02")), "text")))


def repeated_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(docs with their lines' hashes exploded, hashes over the threshold with the id that keeps them)."""
    base = docs.select(F.col(id_col), text_or_empty(text).alias("text"))
    keyed = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.struct(i.alias("pos"), line_key(x).alias("key")),
    )
    long_lines = F.filter(keyed, lambda x: F.length(x["key"]) >= min_chars)
    lines = base.select(id_col, _row_key(id_col).alias("row_key"), F.explode(long_lines).alias("l")).select(
        id_col, "row_key", F.col("l.pos").alias("pos"), F.unhex(F.md5("l.key")).alias("h")
    )
    # one row per (document, hash) before counting: made inside the row, not by a shuffle
    hashes = F.array_distinct(F.transform(long_lines, lambda x: F.unhex(F.md5(x["key"]))))
    counts = (
        base.select(id_col, F.explode(hashes).alias("h"))
        .groupBy("h")
        .agg(F.count("*").alias("n_docs"), F.max(id_col).alias("keep_id"))
        .where(F.col("n_docs") >= min_docs)
        .select("h", "keep_id")
    )
    return lines, written(counts, "line-hashes")


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """id, ``text`` without its dropped lines, ``n_lines`` before and ``n_dropped``."""
    lines, over = repeated_lines(docs, min_chars, min_docs, id_col, text)
    drops = (
        lines.join(over, "h")
        .where(~F.col(id_col).eqNullSafe(F.col("keep_id")))
        .groupBy("row_key")
        .agg(F.collect_set("pos").alias("drop"))
    )
    parts = own("lines")
    base = docs.select(F.col(id_col), text_or_empty(text).alias("text"))
    base = base.withColumn("row_key", _row_key(id_col)).join(drops, "row_key", "left")
    base = base.withColumn(parts, F.split("text", "\n"))
    ln = F.col(parts)
    stay = F.array_except(F.sequence(F.lit(0), F.size(ln) - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(ln, i)), "\n")
    )
    return base.select(
        id_col,
        kept.alias("text"),
        F.size(ln).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
