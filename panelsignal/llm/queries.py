"""Registered queries of the training-data operators: thin wrappers that derive
the digest columns of their contracts from the operators' real outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers

from panelsignal.llm import (
    align,
    arc_convert,
    bitmap_bpe,
    decontaminate,
    lfbf_lm,
    line_dedup,
    packing,
    periodic,
    quality,
    rans,
    stream_dedup,
    tgm_join,
    wrapper_html,
)
from panelsignal.llm.common import WS, scratch_path, table, text_or_empty


def op1_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, split = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    out = packing.pack_documents(table(spark, sf_dir, "documents"), path, split)
    return out.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_to"
    )


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    arc_convert.write_arc(table(spark, sf_dir, "pages"), f"{path}/arc")
    arc_convert.arc_to_warc(spark, f"{path}/arc", f"{path}/warc")
    return arc_convert.with_responses(arc_convert.read_warc(spark, f"{path}/warc")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op3_wrapper_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wrapper_html.extract_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_bitmap_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, split = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bitmap_bpe.round_trip(table(spark, sf_dir, "documents"), path, split).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_lfbf_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return lfbf_lm.score_documents(table(spark, sf_dir, "documents"), held_out)


def op6_stream_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stream_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op7_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "rans")
    rans.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return rans.read_ids(spark, path).select(
        "doc_id", "start", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality.quality_report(table(spark, sf_dir, "documents"))
    return report.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_tgm_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tgm_join.jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)
    return out.select("doc_id", "n_shingles", "component_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op11_fragment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    docs, split = table(spark, sf_dir, "documents"), public_tokenizers.PATTERN
    out = align.align_tokenizers(docs, path("byte_bpe_50k.json"), split, path("piece_bpe_32k.model"), columns=["doc_id"])
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.encode("groups", "UTF-8"), 256))
    figures = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return out.select("doc_id", *figures, digest.alias("groups_sha256"))


def op12_prefix_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; of documents whose crc32(doc_id) is a multiple of ten, the words from some word on repeat with some period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    d = docs.select("doc_id", text_or_empty().alias("text"), h.alias("h"), F.floor(h / 10).alias("g"))
    d = d.withColumn("words", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", f"[{WS}]+"), lambda w: w != "")))
    d = d.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    d = d.withColumn("p", F.floor((F.col("n") - F.col("a")) / (F.col("g") % 8 + 3)) + 1)
    tail = F.expr(
        """concat_ws(' ', slice(words, 1, int(a)),
        slice(flatten(array_repeat(slice(words, int(a + 1), int(p)), int(ceil((n - a) / p)))), 1, int(n - a)))"""
    )
    return d.select("doc_id", F.when(F.col("a").isNotNull(), tail).otherwise(F.col("text")).alias("text"))


def op13_block_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.find_runs(periodic_tails(table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("l"), r.start.alias("s"), r.period.alias("p"))))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r.start, r.length, r.period))
    out = out.withColumn("longest", longest)
    length = -F.col("longest.l")
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.s").alias("start"),
        length.alias("length"),
        F.col("longest.p").alias("period"),
        F.floor(length * 1000 / F.col("longest.p")).alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_ffd_packing,
        op2_arc_to_warc,
        op3_wrapper_html,
        op4_bitmap_bpe,
        op5_lfbf_lm,
        op6_stream_exact_dedup,
        op7_rans_ids,
        op8_quality_rules,
        op9_tgm_jaccard,
        op10_line_dedup,
        op11_fragment_alignment,
        op12_prefix_contamination,
        op13_block_runs,
        pipeline,
    )
}
