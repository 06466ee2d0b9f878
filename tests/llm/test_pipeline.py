"""The corpus pipeline's stages, each on its own input, against brute force."""

import collections
import os

import corpus_pipeline
import public_tokenizers as P
from test_operators import SF, brute_components, check_packing, needs_data

from panelsignal.llm import quality


@needs_data
def test_pipeline(spark):
    from panelsignal.session import scratch_path

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, inputs, outputs = docs.columns, {}, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs.collect()
        path = scratch_path(spark, f"test-{name}")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        outputs[name] = docs.collect()
        assert name == "packing" or docs.columns == columns

    ids = lambda rows: sorted(r.doc_id for r in rows)
    passed = quality.quality_report(spark.read.parquet(f"{SF}/documents.parquet")).where("kept")
    assert ids(outputs["quality_rules"]) == ids(passed.collect())

    best = {}
    for r in inputs["exact_dedup"]:
        best[r.text] = max(best.get(r.text, r.doc_id), r.doc_id)
    assert ids(outputs["exact_dedup"]) == sorted(best.values())

    rows = [(r.doc_id, r.text) for r in inputs["near_dedup"]]
    want, _ = brute_components(rows, 5, 80)
    assert ids(outputs["near_dedup"]) == sorted({c for _, _, c in want})

    rows = [(r.doc_id, r.text) for r in inputs["packing"]]
    assert check_packing(rows, outputs["packing"]) < 0.01

    run = corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "sequence_id", "offset").collect()
    again = [(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in outputs["packing"]]
    assert collections.Counter(map(tuple, run)) == collections.Counter(again)


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "packing"]
    assert os.path.exists(P.path("byte_bpe_50k.json"))
