"""Benchmark decontamination against brute force."""

import hashlib
import random
import re

import pytest

from panelsignal.llm import decontaminate
from panelsignal.llm.queries import op12_prefix_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width=10):
    out = []
    for text in docs:
        words, hit, ids = split(text), set(), set()
        for item, body in items:
            w = split(body)
            n = min(width, len(w))
            for i in range(len(w) - n + 1) if n else ():
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == w[i : i + n]:
                        hit.update(range(p, p + n))
                        ids |= {str(item)} - {"None"}
        out.append((len(words), sorted(hit), sorted(ids)))
    return out


def made(rng):
    words = [f"w{i}" for i in range(30)] + ["É", "日本", "x1"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 3, 9, 10, 11, 40]))) for i in range(25)]
    items += [(7, text(15)), (None, text(12)), (99, None), (98, ""), (97, ". , !"), (96, "the the the " * 5)]
    items.append((95, items[-1][1]))
    docs = [text(rng.randint(0, 60)) for _ in range(40)] + [None, "", " .\n", "the " * 40]
    for _ in range(60):
        body = split(rng.choice(items)[1])
        a = rng.randrange(max(1, len(body)))
        cut = body[a : a + rng.randint(1, 30)]
        docs.append(text(rng.randint(0, 20)) + rng.choice(["\n", ", ", "\x00"]) + "-".join(cut).upper() + ". " + text(5))
    docs.append(" ".join(text(2000) + " " + (i[1] or "") for i in items))
    return docs + docs[40:44], items


@pytest.mark.parametrize("block_windows", [17, 200_000])
def test_against_brute_force(spark, block_windows):
    docs, items = made(random.Random(12))
    df = spark.createDataFrame([(i, t, "e", "e") for i, t in enumerate(docs)], "doc_id long, text string, window string, Items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.find_contamination(df, bench, block_windows=block_windows)
    assert out.columns == ["doc_id", "text", "window", "n_words", "spans", "items"]
    got = {r.doc_id: (r.n_words, [i for s in r.spans for i in range(s.start, s.end)], list(r["items"])) for r in out.collect()}
    want = brute(docs, items)
    assert len(got) == len(docs)
    assert any(ids for _, _, ids in want)
    for i, w in enumerate(want):
        assert got[i] == w, docs[i]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[2:] for r in decontaminate.find_contamination(docs, none).collect()] == [(3, [], []), (0, [], [])]
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert decontaminate.find_contamination(docs.limit(0), bench).collect() == []


def test_bounds_at_both_ends():
    block = decontaminate.Block(["a b c d e f g h i rare"], ["1"])
    block.choose({k: [1] * 99 if not len(t) else __import__("numpy").arange(len(t), 0, -1) for k, t in block.table.items()})
    sizes, spans, items = block.search(["a b c d e f g h i rare", "b c d e f g h i rare", "a b c d e f g h i", "h i rare a b"])
    assert spans == [[(0, 10)], [], [], []] and items[0] == {"1"}


def test_query_columns(spark, tmp_path):
    docs, items = made(random.Random(3))
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(tuple(r) for r in op12_prefix_contamination(spark, str(tmp_path)).collect())
    sha = lambda ids: hashlib.sha256(",".join(ids).encode()).hexdigest()
    want = [(i, n, len(hit), len(ids), sha(ids), bool(hit)) for i, (n, hit, ids) in enumerate(brute(docs, items))]
    assert got == want
