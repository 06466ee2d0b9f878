"""Maximal periodic runs of words against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from panelsignal.llm import periodic
from panelsignal.llm.queries import op13_block_runs

LETTERS = "abcdefghij"


def brute_runs(words):
    """(start, length, period) by comparing every distance."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def brute_kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(rng, most=150):
    n, k = rng.randint(0, most), rng.randint(1, 5)
    words = [rng.choice(LETTERS[:k]) for _ in range(n)]
    if n > 3 and rng.random() < 0.6:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // rng.randint(3, 6)))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


@pytest.mark.parametrize("size", [1, 2, 8, 64])
def test_squared_differences_are_exact(size):
    rng = np.random.default_rng(size)
    blocks = rng.integers(0, 9, (5, size)).astype(np.uint64)
    windows = rng.integers(0, 9, (5, 2 * size)).astype(np.uint64)
    got = periodic.squared_differences(blocks, windows)
    for b, w, g in zip(blocks.astype(int), windows.astype(int), got):
        assert g.tolist() == [int(((b - w[k : k + size]) ** 2).sum()) for k in range(size + 1)]


def test_runs_of_random_documents():
    rng = random.Random(13)
    for _ in range(400):
        docs = [random_words(rng) for _ in range(rng.randint(1, 5))]
        words, runs = periodic.runs_of_texts([" ".join(d) for d in docs])
        for d, w, r in zip(docs, words, runs):
            assert r == brute_runs(d)
            assert periodic.collapsed(w, r).decode() == brute_kept(d, r)


@pytest.mark.parametrize("period", [1, 3, 700, 25_000])
def test_one_long_run(period):
    x = np.arange(100_000) % period
    assert periodic.periodic_runs(x, len(x)) == [(0, len(x), period)]


def test_a_chance_zero_of_the_prime_is_no_run():
    # two blocks whose squared difference is a multiple of the prime but not zero
    side = next(a for a in range(1, 45_000) if ((b := int((periodic.PRIME - a * a) ** 0.5)) ** 2 + a * a == periodic.PRIME))
    other = int((periodic.PRIME - side * side) ** 0.5)
    block, window = np.array([[0, 0]], np.uint64), np.array([[side, other, 1, 1]], np.uint64)
    assert periodic.squared_differences(block, window)[0, 0] == 0
    x = np.array([0, 1, side, other, 0, 1, side, other + 1], np.int64)
    assert periodic.stretch(x, 0, 2) == (0, 2)
    assert periodic.periodic_runs(x, len(x)) == []


EDGE = [
    (1, None),
    (2, ""),
    (3, " \t\n\r\x0b\x0c "),
    (None, "x " * 9),
    (None, None),
    (4, "a b a b a b a b"),
    (4, "a b a b a b a b"),
    (5, "a b a b a b a b a b a b"),
    (6, "no run here " * 3),
    (7, "z z z z z"),
    (8, " ".join(str(i % 977) for i in range(60_000))),
]


def test_awkward_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(*r, "e") for r in EDGE], "doc_id long, text string, words string")
    rows = periodic.find_runs(df).collect()
    assert len(rows) == len(EDGE)
    by_text = {t: [] for _, t in EDGE}
    for r in rows:
        assert r.words == "e"
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        got = [tuple(x) for x in r.runs]
        want = brute_runs(words) if len(words) < 1000 else [(0, 60_000, 977)]
        assert got == want and r.collapsed == brute_kept(words, want)
        by_text[r.text].append(got)
    assert all(len(set(map(tuple, v))) == 1 for v in by_text.values())
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.find_runs(empty).collect() == []
    replaced = periodic.find_runs(df.withColumnRenamed("words", "Runs"))
    assert replaced.columns == ["doc_id", "text", "runs", "collapsed"] and replaced.count() == len(EDGE)


def test_query_columns(spark, tmp_path):
    """The registered query on a small table, its planted tails included."""
    rng = random.Random(5)
    rows = [(i, " ".join(random_words(rng, 80))) for i in range(120)] + [(500, None), (501, ""), (3, "a a a a a a a")]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = sorted(tuple(r) for r in op13_block_runs(spark, str(tmp_path)).collect())
    want = []
    for doc_id, text in rows:
        words = (text or "").split()
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        milli = 1000 * best[1] // best[2] if runs else None
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((doc_id, len(runs), *best, milli, sha(lines), sha(brute_kept(words, runs))))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
