"""The training-data operators on a small table with every awkward row, and on
the driver's smallest table, against brute force."""

import collections
import hashlib
import math
import os
import random
import re
import zlib
from array import array

import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelsignal.llm import arc_convert, bitmap_bpe, lfbf_lm, line_dedup, packing, quality, rans, stream_dedup, tgm_join, tokens, wrapper_html
from panelsignal.session import scratch_path

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
WORDS = "the of and to in is that it for was on with as are be by this at from an".split()


def prose(n, seed=0):
    return " ".join(WORDS[(i * i + seed * i + seed) % len(WORDS)] + str((i * 7 + seed) % 13) for i in range(n))


LONG = prose(30_000)
ROWS = [
    (1, "One short text."),
    (2, None),
    (3, ""),
    (None, prose(80, 1)),
    (None, None),
    (4, prose(80, 1)),
    (5, prose(80, 2)),
    (5, prose(80, 2)),
    (6, prose(80, 2) + " more"),
    (7, LONG),
    (8, " \n\t\n  x  \r\n"),
    (9, "a\x1fb\u00a0c\u2003d\ud7ffe <|endoftext|> 日本語 ÄÖ"),
    (10, "z" * 3000),
]
#: Extra columns with names that the operators use themselves.
EXTRA = {c: "extra" for c in ("ids", "group", "n", "digest", "label", "key", "row_key", "kept", "tokens", "h", "html_", "words", "lines", "part")}


def table(spark, rows=ROWS, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    return df.select("*", *[F.lit(v).alias(k) for k, v in EXTRA.items()])


def key(r):
    return tuple((v is None, v) for v in r)


def text_of(t):
    return t or ""


def real(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# --- tokenising, packing, token files ------------------------------------------


def library_ids(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    return lambda text: t.encode(text_of(text), add_special_tokens=False).ids


def check_packing(rows, out):
    ids = library_ids("byte_bpe_50k.json")
    want = collections.Counter((d, tuple(ids(t) + [0])) for d, t in rows)
    by_sequence = collections.defaultdict(list)
    for r in out:
        assert len(r.ids) == 4 * r.length and r.length > 0
        by_sequence[r.sequence_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and all(r.padded_to == (at if at & (at - 1) == 0 else 1024) for r in pieces)
    # every document's ids, once for each of its rows
    for (d, x), n in want.items():
        places = collections.Counter()
        for r in out:
            if r.doc_id == d and r.doc_tokens == len(x):
                got = array("I", r.ids).tolist()
                for k in range(r.length):
                    places[r.start + k, got[k]] += 1
        same = sum(m for (e, y), m in want.items() if e == d and len(y) == len(x))
        assert all(places[k, v] >= n for k, v in enumerate(x)) and sum(places.values()) == same * len(x)
    total = sum(r.length for r in out)
    padded = sum(p[0].padded_to for p in by_sequence.values())
    return (padded - total) / total


def test_packing(spark):
    out = packing.pack_documents(table(spark), P.path("byte_bpe_50k.json"), P.PATTERN, docs_per_group=4).collect()
    check_packing(ROWS, out)
    assert packing.pack_documents(table(spark, []), P.path("byte_bpe_50k.json"), P.PATTERN).collect() == []


@needs_data
def test_packing_leaves_little_padding(spark):
    rows = real(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    assert check_packing(rows, out) < 0.01


#: Strings of added tokens in every company, and words whose case or composition is not settled letter by letter.
HARD = [
    "a  <|endoftext|>b <|endoftext|>  <|startoftext|>\n\n<|ENDOFTEXT|> <|endoftext|",
    "<|endoftext|>",
    "ΑΣ Σ İI ǅ ẞ ﬁ ½ ² \u0378 e\u0301 \u0301x \u212b Å a\x1cb \x85z \ufeffq 中文 '\u00b7'",
    "don't DON'T I'LL 'S1 x'' (word). a-b it's'",
]


@pytest.mark.parametrize("name, encoder", [("byte_bpe_50k.json", "spaced"), ("word_bpe_49k.json", "bare")])
def test_ids_are_the_librarys(name, encoder):
    enc = tokens.spaced_encoder(P.path(name), P.PATTERN) if encoder == "spaced" else tokens.bare_encoder(P.path(name))
    ids, texts = library_ids(name), [t or "" for _, t in ROWS] + HARD + ["".join(HARD), " ".join(HARD)]
    assert [array("I", x).tolist() for x in enc.encode(texts)] == [ids(t) for t in texts]


def test_plain_words_are_learnt_without_the_pattern():
    ids, words = library_ids("byte_bpe_50k.json"), tokens.SpacedWords(P.path("byte_bpe_50k.json"), P.PATTERN)
    plain = ["word", "word.", "Wort$$$", "été", "naïveté),", "ΑΒ", "don'", "it''", "Ж!?", "ª", "x" * 70]
    hard = ["ΑΣ", "don't", "'ll", "a-b", "x1", "²", "e\u0301", "中文", "中.", "\u0378", "ﬁ", "\nword.", "\n'", "...", "a\tb", ("word.",), ("  ",)]
    asked, split = [], words.split
    words.split = lambda text: asked.append(text) or split(text)
    expected = [ids(tokens.spaced_text(k)) for k in plain + hard]
    assert [array("I", x).tolist() for x in words(plain + hard)] == expected
    assert asked == [tokens.spaced_text(k) for k in hard]
    other = tokens.SpacedWords(P.path("byte_bpe_50k.json"), P.PATTERN.replace(r" ?\p{L}+", r" ?\p{L}"))
    assert not other.settles


def test_a_task_drops_tables_of_earlier_tasks_only(monkeypatch):
    from types import SimpleNamespace

    task = lambda i: monkeypatch.setattr(tokens.TaskContext, "get", lambda: SimpleNamespace(taskAttemptId=lambda: i))
    monkeypatch.setattr(tokens, "_KEPT", {})
    task(1)
    first = tokens.kept(("a",), list)
    tokens.kept(("b",), list)
    assert tokens.kept(("a",), list) is first
    task(2)
    assert tokens.kept(("a",), list) is first
    tokens.kept(("c",), list)
    assert set(tokens._KEPT) == {("a",), ("c",)}


def test_packing_holds_few_words_and_sends_few_pieces(monkeypatch):
    monkeypatch.setattr(tokens, "_KEPT", {})
    assert tokens.spaced_encoder(P.path("byte_bpe_50k.json"), P.PATTERN).limit < tokens.MEMO
    rows = pa.table({"n": list(range(2 * packing.SEND + 1))})
    sent = packing.small_batches(rows)
    assert [b.num_rows for b in sent.to_batches()] == [packing.SEND, packing.SEND, 1] and sent.equals(rows)


def test_first_fit_decreasing_is_first_fit():
    sizes = sorted(((i * 37) % 100 + 1 for i in range(200)), reverse=True)
    bins, plain = packing.first_fit_decreasing(sizes, 100), []
    for i, s in enumerate(sizes):
        for b in plain:
            if sum(sizes[k] for k in b) + s <= 100:
                b.append(i)
                break
        else:
            plain.append([i])
    assert bins == plain


def reference_bpe():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bitmap_bpe.read_ranks(path), special_tokens={})
    return path, e.encode_ordinary


def test_bitmap_bpe(spark):
    path, plain = reference_bpe()
    enc = bitmap_bpe.encode_documents(table(spark), path, P.PATTERN)
    out = bitmap_bpe.decode_documents(enc, path).collect()
    both = bitmap_bpe.round_trip(table(spark), path, P.PATTERN).collect()
    assert sorted(map(str, both)) == sorted(map(str, out))
    got = sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in out), key=key)
    want = sorted(((d, array("I", plain(text_of(t))).tobytes(), text_of(t).encode()) for d, t in ROWS), key=key)
    assert got == want
    assert bitmap_bpe.encode_documents(table(spark, []), path, P.PATTERN).collect() == []


def test_both_queues_merge_like_the_library():
    import random

    path, plain = reference_bpe()
    bpe, rnd = bitmap_bpe.BitmapBPE(path, P.PATTERN), random.Random(3)
    pieces = ["".join(rnd.choice("abeint") for _ in range(rnd.randint(1, 40))) for _ in range(500)] + ["a" * 700, "ab" * 900]
    many = bpe.merge_many([p.encode() for p in pieces])
    for p, ids in zip(pieces, many):
        want = plain(p)
        assert bpe.merge(p.encode()) == want
        assert array("I", ids).tolist() == want or p.encode() in bpe.ranks


def check_files(spark, rows, docs, monkeypatch):
    monkeypatch.setattr(rans, "TOKENS_PER_PART", 20_000)
    path, ids = scratch_path(spark, "rans-test"), library_ids("word_bpe_49k.json")
    rans.write_ids(docs, path, P.path("word_bpe_49k.json"))
    got = sorted((r.start, (r.doc_id is not None, r.doc_id), bytes(r.ids)) for r in rans.read_ids(spark, path).collect())
    want, at = [], 0
    coded = [((d is not None, d), array("H", ids(t) + [1]).tobytes(), ids(t) + [1]) for d, t in rows]
    for d, _, x in sorted(coded, key=lambda r: ((r[0][0], r[0][1] or 0), r[1])):
        want.append((at, d, array("I", x).tobytes()))
        at += len(x)
    assert got == want


def test_rans_files(spark, monkeypatch):
    check_files(spark, ROWS, table(spark), monkeypatch)
    check_files(spark, [], table(spark, []), monkeypatch)


@needs_data
def test_rans_files_of_the_table(spark, monkeypatch):
    check_files(spark, real(spark), spark.read.parquet(f"{SF}/documents.parquet"), monkeypatch)


def test_cuts_below(spark):
    ids = [None, -5, 0, 3, 7, 10**15]
    for cuts in ([], [3], [-5, 0, 7], list(range(-3, 9)), [10**15]):
        rows = spark.createDataFrame([(i,) for i in ids], "d long").select("d", rans.cuts_below("d", cuts).alias("p")).collect()
        assert {r.d: r.p for r in rows if r.d is not None} == {i: sum(c <= i for c in cuts) for i in ids if i is not None}


def test_rans_finds_a_changed_byte():
    import numpy as np

    ids = np.arange(2000) % 77
    t = rans.Table(rans.Table.scaled(np.bincount(ids)))
    block = rans.make_block([5, None], np.array([700, 1300]), ids, 40, t)
    rows = list(rans.read_blocks(block + b"\n", t))
    assert [(d, s) for d, s, _ in rows] == [(5, 40), (None, 740)]
    broken = bytearray(block)
    broken[-3] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(rans.read_blocks(bytes(broken) + b"\n", t))


# --- quality, lines, exact copies ------------------------------------------------

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words_of(t):
    return [w for w in SPACE.split(text_of(t)) if w]


def brute_quality(t):
    t = text_of(t)
    w = words_of(t)
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(wins)
    cover = {i + k for i, x in enumerate(wins) if n[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if SPACE.sub("", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def check_quality(rows, out):
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out), key=key)
    assert got == sorted(((d, *brute_quality(t)) for d, t in rows), key=key)
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality(spark):
    check_quality(ROWS, quality.quality_report(table(spark)).collect())
    assert quality.quality_report(table(spark, [])).collect() == []
    kept = quality.filter_documents(table(spark))
    assert kept.columns == ["doc_id", "text", *EXTRA]
    marked = quality.quality_report(table(spark)).where("kept")
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in marked.collect())


def test_quality_keeps_clean_texts_of_any_length(spark):
    docs = table(spark, [(1, " ".join(f"the item{i}" for i in range(50_001))), (2, "the item " * 50_001)])
    assert [(r.doc_id, r.n_words, r.kept) for r in quality.quality_report(docs).sort("doc_id").collect()] == [(1, 100_002, True), (2, 100_002, False)]
    assert [r.doc_id for r in quality.filter_documents(docs).collect()] == [1]


@needs_data
def test_quality_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_quality(real(spark), quality.quality_report(docs).collect())
    assert "Python" not in quality.filter_documents(docs)._jdf.queryExecution().toString()


def test_quality_filter_computes_metrics_once(spark):
    plan = quality.filter_documents(table(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") <= 4


def brute_lines(rows, min_chars=40, min_docs=5):
    def norm(x):
        return x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})

    holders = collections.defaultdict(list)
    for i, (_, t) in enumerate(rows):
        for k in {norm(x) for x in text_of(t).split("\n")}:
            holders[k].append(i)
    out = []
    for d, t in rows:
        lines, kept = text_of(t).split("\n"), []
        for x in lines:
            k = norm(x)
            ids = [rows[i][0] for i in holders[k]]
            top = max((v for v in ids if v is not None), default=None)
            if len(k) < min_chars or len(ids) < min_docs or d == top:
                kept.append(x)
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=key)


def test_lines(spark):
    common = "This line stands in more than one document of these."
    rows = ROWS + [(20 + i, f"first {i}\n {common.upper()}\t\nmid\n{common}") for i in range(4)] + [(None, common), (23, common)]
    got = line_dedup.dedup_lines(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got), key=key) == brute_lines(rows)
    assert line_dedup.dedup_lines(table(spark, [])).collect() == []


def brute_copies(rows):
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[text_of(t)].append(d)
    out = []
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        out += [(d, top, len(ids), hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    return sorted(out, key=key), len(groups)


@pytest.mark.parametrize("digest", [stream_dedup.sha256, lambda t: F.substring(F.unhex(F.md5(t)), 1, 1) == F.lit(b"\x00")])
def test_exact_copies_whatever_the_digest(spark, digest):
    rows = ROWS + [(30 + i, "copied") for i in range(5)] + [(40, prose(60, 9)), (41, prose(61, 9))]
    out = stream_dedup.exact_dedup(table(spark, rows), digest=digest).collect()
    want, n_groups = brute_copies(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, bytes(r.sha).hex()) for r in out), key=key) == want
    assert sum(r.kept for r in out) == n_groups
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_exact_copies_over_several_batches(spark):
    rows = [(i, f"text {i % 7}") for i in range(100)]
    out = stream_dedup.exact_dedup(table(spark, rows).repartition(8), files_per_batch=2).collect()
    assert {(r.doc_id % 7, r.keep_id, r.group_size) for r in out} == {(i % 7, i, 15 if i % 7 < 2 else 14) for i in range(93, 100)}


def test_exact_copies_removed(spark):
    kept = stream_dedup.dedup_documents(table(spark))
    assert kept.columns == ["doc_id", "text", *EXTRA]
    _, n_groups = brute_copies(ROWS)
    assert kept.count() == n_groups
    assert stream_dedup.exact_dedup(table(spark, [])).collect() == []
    assert stream_dedup.dedup_documents(table(spark, [])).collect() == []


# --- near copies -----------------------------------------------------------------


def brute_components(rows, words, percent):
    sets = []
    for _, t in rows:
        w = text_of(t).encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = root(i)
            least[r] = min(least.get(r, d), d)
    return [(rows[i][0], len(sets[i]), least.get(root(i))) for i in range(len(rows))], len({root(i) for i in range(len(rows))})


def near_rows():
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(90):  # a chain of near copies, each a few words from the next
        w = list(base)
        for i in range(k % 30):
            w[4 * i % 120] = f"x{k % 30}_{i}" if i > (k % 30) - 2 else f"y{i}"
        rows.append((1000 - k, " ".join(w)))
    tail = " ".join(f"t{i}" for i in range(40))
    rows += [(2000 + k, " ".join(f"u{k}_{i}" for i in range(5)) + " " + tail) for k in range(60)]
    return rows


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_components(spark, words, percent, monkeypatch):
    monkeypatch.setattr(tgm_join, "GROUP", 8)
    monkeypatch.setattr(tgm_join, "QUERIES", 4)
    rows = ROWS + near_rows()
    out = tgm_join.jaccard_components(table(spark, rows), words, percent).collect()
    want, n = brute_components(rows, words, percent)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=key) == sorted(want, key=key)
    # rows without a shingle link with nothing, so each is kept
    assert sum(r.kept for r in out) == n


def test_few_groups_are_opened_in_a_crowd_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(tgm_join, "GROUP", 8)
    rng, rows = random.Random(3), []
    for k in range(240):  # copies of one text, two thirds of them too far from the others to link
        w = [f"w{i}" for i in range(150)]
        for i in rng.sample(range(150), 1 + 2 * (k % 3)):
            w[i] = f"x{rng.randrange(60)}"
        rows.append((k, " ".join(w)))
    made = {}

    def counted(df, name):
        made[name] = (out := written(df, name)).count()
        return out

    written = tgm_join.written
    monkeypatch.setattr(tgm_join, "written", counted)
    out = tgm_join.jaccard_components(table(spark, rows), 4, 85).collect()
    want, n = brute_components(rows, 4, 85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == sorted(want)
    assert 40 < n < 200
    assert made["tgm-candidates"] <= 2 * len(rows)


def test_near_copies_removed(spark):
    kept = tgm_join.dedup_near(table(spark))
    assert kept.columns == ["doc_id", "text", *EXTRA]
    assert kept.count() <= brute_components(ROWS, 5, 80)[1]
    assert tgm_join.jaccard_components(table(spark, [])).collect() == []


@needs_data
def test_components_of_the_table(spark):
    rows = real(spark)
    out = tgm_join.jaccard_components(spark.read.parquet(f"{SF}/documents.parquet"), 4, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == sorted(brute_components(rows, 4, 85)[0])


# --- scoring -----------------------------------------------------------------------


def check_scores(rows, out, tolerance):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    docs = [(d, text_of(t).encode().lower().split() + [b" end"]) for d, t in rows]
    count, pairs, texts = collections.Counter(), collections.Counter(), 0
    for d, w in docs:
        if not held(d):
            count.update(w)
            pairs.update(zip([b" start", *w], w))
            texts += 1
    n, v, left = sum(count.values()), len(count), {**count, b" start": texts}
    want = []
    for d, w in docs:
        base = [(count[x] + 1) / (n + v + 1) for x in w]
        score = 0.0
        for h, x, p in zip([b" start", *w], w, base):
            q = 2 ** (pairs[h, x].bit_length() - 1) if pairs[h, x] else 0
            score += math.log10((q + lfbf_lm.MU * p) / (left.get(h, 0) + lfbf_lm.MU))
        want.append((d, held(d), len(w), sum(count[x] > 0 for x in w), n, sum(map(math.log10, base)), score))
    got = sorted(out, key=lambda r: key((r.doc_id, r.n_tokens, r.base_score)))
    off = 0
    for r, x in zip(got, sorted(want, key=lambda x: key((x[0], x[2], x[5]))), strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == x[:5]
        assert math.isclose(r.base_score, x[5], rel_tol=1e-9, abs_tol=1e-9)
        off += not math.isclose(r.score, x[6], rel_tol=0.02)
    assert off <= tolerance * len(got)
    return [(r.held_out, r.base_score, r.score) for r in got]


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


def test_scores(spark):
    check_scores(ROWS, lfbf_lm.score_documents(table(spark), held_out()).collect(), 0.1)
    assert lfbf_lm.score_documents(table(spark, []), held_out()).collect() == []


def test_scores_whatever_the_bound_of_a_slice(spark):
    check_scores(ROWS, lfbf_lm.score_documents(table(spark), held_out(), max_filter_bytes=256).collect(), 0.1)


def test_hashes_grow_with_the_corpus():
    assert [lfbf_lm.hash_bits(n) for n in (0, 1 << 29, 5 << 30, 1 << 60)] == [40, 40, 43, 64]


@needs_data
def test_scores_of_the_table_beat_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = check_scores(real(spark), lfbf_lm.score_documents(docs, held_out()).collect(), 0.05)
    assert sum(s for h, _, s in rows if h) > sum(b for h, b, _ in rows if h)


# --- pages -------------------------------------------------------------------------

PAGES = [
    (1, "http://a.example/x y", "<p>" + "long " * 300),
    (2, None, "<p>" + "long " * 300),
    (9, "http://a.example/é", "<p>" + "long " * 300),
    (9, "http://a.example/again", "<p>" + "long " * 300),
    (None, "http://a.example/null", "<p>" + "long " * 300),
    (3, "", None),
    (4, "http://b.example/", ""),
    (5, "http://b.example/1", "short"),
    (6, "http://b.example/2", "short"),
    (7, "http://b.example/3", "WARC/1.0\r\n\r\n\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\né\n\nhttp://x 1 2 3 4\n" * 50),
    (8, "http://b.example/4", "x" * 400_000),
]


def page_table(spark, rows=PAGES):
    return table(spark, rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("region", F.lit(1))


def test_archives(spark):
    path = scratch_path(spark, "arc-test")
    arc_convert.write_arc(page_table(spark).repartition(3), f"{path}/arc")
    assert arc_convert.read_arc(spark, f"{path}/arc").count() == len(PAGES)
    arc_convert.arc_to_warc(spark, f"{path}/arc", f"{path}/warc")
    out = arc_convert.with_responses(arc_convert.read_warc(spark, f"{path}/warc")).collect()
    payloads = [(p, text_of(h).encode()) for p, _, h in PAGES]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest) for r in out), key=key) == sorted(
        ((p, len(b), hashlib.sha1(b).hexdigest()) for p, b in payloads), key=key
    )
    copies = [r for r in out if r.payload_bytes == 1503]
    assert [r.page_id for r in copies if r.record_type == "response"] == [9]
    assert all(r.refers_to == 9 for r in copies if r.record_type == "revisit") and len(copies) == 5
    assert all(r.refers_to is None and r.record_type == "response" for r in out if r.payload_bytes != 1503)
    full = arc_convert.read_warc(spark, f"{path}/warc", payload=True).where("record_type = 'response'").collect()
    assert {bytes(r.payload) for r in full} == {b for _, b in payloads}
    assert all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", r.date) for r in out)


def test_no_pages(spark):
    path = scratch_path(spark, "arc-none")
    arc_convert.write_arc(page_table(spark, []), f"{path}/arc")
    arc_convert.arc_to_warc(spark, f"{path}/arc", f"{path}/warc")
    assert arc_convert.read_warc(spark, f"{path}/warc").collect() == []
    assert wrapper_html.extract_pages(page_table(spark, [])).collect() == []


def test_both_arc_versions_parse():
    import io

    for version in (1, 2):
        body = arc_convert.http_response(7, b"pay\n\nload")
        raw = arc_convert.arc_file_header("f.arc", version, "20010203040506") + b"\n"
        raw += arc_convert.arc_record("http://x/", "20010203040506", body, version, "f.arc", len(raw)) + b"\n"
        ((offset, fields, got),) = arc_convert.parse_arc(io.BytesIO(raw))
        assert got == body and fields["URL"] == "http://x/" and raw[offset:].startswith(b"http://x/")
        assert ("Checksum" in fields) == (version == 2)
        with pytest.raises(ValueError, match="cut short"):
            list(arc_convert.parse_arc(io.BytesIO(raw[:-8])))


PAGE = (
    "<html><head><title>t</title><script>var a='</p>'</script></head><body><header>top</header><nav><ul><li><a href=1>menu</a></ul></nav>"
    "<div class='cookie-notice'>we use cookies</div><div id=content><h1>Title {n}</h1>{body}<form><input>mail</form></div>"
    "<aside>beside</aside><div class=comments><p>first!</p></div><footer>&copy; x</footer>{end}"
)


def test_main_text(spark):
    rows, want = [], {}
    for n in range(12):
        paragraphs = [f"Text {n} {k} &amp; <b>bold</b>\n  more&nbsp;words " + "word " * 20 for k in range(1 + n % 4)]
        rows.append((n, f"http://h{n % 2}.example/{n}", PAGE.format(n=n, body="".join(f"<p>{p}" for p in paragraphs), end="</body></html>" * (n % 3 > 0))))
        want[n] = "\n".join([f"Title {n}"] + [f"Text {n} {k} & bold more words " + " ".join(["word"] * 20) for k in range(1 + n % 4)])
    odd = [(100, None, None), (101, "", ""), (None, "no host", "plain text"), (102, "http://h1.example/q", "<div>" * 2000 + "deep"), (102, "http://h1.example/q", "<p>twice</p>")]
    out = {(r.page_id, r.text) for r in wrapper_html.extract_pages(page_table(spark, rows + odd)).collect()}
    assert {(p, t) for p, t in out if p is not None and p < 100} == set(want.items())
    assert {(100, ""), (101, ""), (None, "plain text"), (102, "deep"), (102, "twice")} <= out


def text_of_page(source):
    return wrapper_html.main_text(source, None)


@pytest.mark.parametrize(
    "source, text",
    [
        ("<html><head><meta charset=utf-8><title>t</title><body><p>one<p>two", "one\ntwo"),
        ("<head><title>t</title><noscript><style>x</style></noscript><p>one</p>", "one"),
        ("<head><script>var a</script></head><body>one", "one"),
        ("<body><p>one <svg class='i'/>two</p><p>three</p>", "one two\nthree"),
        ("<body><p>one <svg><title/><g><text>x</text></g></svg>two</p>", "one two"),
        ("<body><div><p>one <svg><path d=1></p></div><p>two</p>", "one\ntwo"),
        ("<body><div>one<svg><path><p>two</p></div>", "one\ntwo"),
        ("<body><div>one<math><mi>x</mi></math></div><div>two</div>", "one\ntwo"),
        ("<body><svg-icon></svg-icon><template-x><p>one</p></template-x><p>two", "one\ntwo"),
        ("<body><div><select><option>x<option>y</div><p>one</p>", "one"),
        ("<body><object data=x><p>other</p></object><template><p>x</p></template><p>one", "one"),
        ("<body><p>one</p><script>'<p>x</p>'</script ><p>two</p><style>p{", "one\ntwo"),
    ],
)
def test_elements_that_are_left_out_end(source, text):
    assert text_of_page(source) == text


def cut_pages(sources):
    """Each page's main text by the wrapper of all."""
    w = None
    for x in sources:
        page = wrapper_html.generalise(wrapper_html.parse(x))
        w = page if w is None else wrapper_html.merge(w, page)
    path = wrapper_html.region(w)
    constant = frozenset(map(tuple, wrapper_html.constants(w, path)))
    return [wrapper_html.main_text(x, path, constant) for x in sources]


def test_articles_stay_whole():
    body = "word " * 200
    inner = [f"<h1>T{n}</h1><p>lead {n}</p><div class=entry-content><p>{n} {body}</p></div><p>end {n}</p>" for n in range(4)]
    want = [f"T{n}\nlead {n}\n{n} {body.strip()}\nend {n}" for n in range(4)]
    assert cut_pages([f"<body><nav>menu</nav><article>{x}</article>" for x in inner]) == want
    # without an article or main element; a short page keeps what little it has
    inner.append("<h1>T</h1><p>lead</p><div class=box><p>x</p></div>")
    boxes = [x.replace("entry-content", "box") for x in inner]
    assert cut_pages([f"<body><nav>menu</nav><div class=page>{x}</div>" for x in boxes]) == [*want, "T\nlead\nx"]


def test_regions_leave_out_what_is_shown_to_be_boilerplate():
    pages = [f"<body><div>same line</div><div class=l><a href=1>a{n}</a></div><div class=t><h1>T{n}</h1><p>text {n}</p></div>" for n in range(4)]
    assert cut_pages(pages) == [f"T{n}\ntext {n}" for n in range(4)]


@pytest.mark.parametrize(
    "source, text",
    [
        ("<body class='single no-sidebar'><p>one</p></body>", "one"),
        ("<body class=sidebar><main class='main-content has-sidebar'><p>one</p></main><aside>x</aside>", "one"),
        ("<div class='content has-sidebar'><p>one</p><div class=sidebar>x</div></div>", "one"),
        ("<article class='post comment-open'><p>one</p><div class=post-comments><article class=comment>x</article></div></article>", "one"),
        ("<body><form id=aspnetForm><h1>T</h1><p>one</p><form class=search-form><input>x</form></form>", "T\none"),
        ("<form><nav>menu</nav><div><p>one</p></div><footer>x</footer></form>", "one"),
        ("<body><header>site</header><article><header><h1>T</h1></header><p>one</p><footer>x</footer></article>", "T\none"),
        ("<article><h2 class='section-header'>S</h2><p class='notice-board'>one</p></article>", "S\none"),
        ("<div class=banner><main><p>one</p></main></div>", "one"),
        ("<div class='site-header js'>x</div><div id=cookie_banner>x</div><p>one</p><div class='comments-section'>x</div><div class=ad-300>x</div>", "one"),
        ("<p>one</p><form><label>mail</label></form><div class='related-posts widget'>x</div>", "one"),
    ],
)
def test_flags_read_whole_class_names(source, text):
    assert text_of_page(source) == text


def test_constant_slots_of_a_region_are_left_out():
    page = "<body><article><div class=tagline>Your daily source</div><h2>Summary</h2><p>text {n}</p><ul><li>Tags</li></ul><div class=end>All rights</div></article>"
    pages = [page.format(n=f"{n} " + "word " * 20) for n in range(5)]
    want = [f"Summary\ntext {n} {'word ' * 20}".strip() + "\nTags" for n in range(5)]
    assert cut_pages(pages) == want
    assert cut_pages(pages[:3])[0].startswith("Your daily source")  # too few pages to tell
    # copies of one page, and pages that say little of their own, stay whole
    assert cut_pages(pages[:1] * 5) == [f"Your daily source\n{want[0]}\nAll rights"] * 5
    assert cut_pages([page.format(n=n) for n in range(5)])[2] == "Your daily source\nSummary\ntext 2\nTags\nAll rights"


@needs_data
def test_pages_by_brute_force(spark):
    """Every page against its host's wrapper, folded in one loop."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = pages.select("page_id", wrapper_html.host(F.col("url")).alias("host"), "html").collect()
    want = {}
    for h in {r.host for r in rows}:
        own = [r for r in rows if r.host == h]
        want.update(zip([r.page_id for r in own], cut_pages([r.html or "" for r in own])))
    assert {r.page_id: r.text for r in wrapper_html.extract_pages(pages).collect()} == want


def test_end_tags_beyond_the_depth_close_what_they_opened():
    deep = wrapper_html.DEPTH
    nest = lambda inner: "<div>" * deep + inner + "</div>" * deep
    page = f"<body><nav>menu</nav><article><h1>T</h1><div>{nest('deep <nav><div>menu</div>more</nav> <p>after')}<p>one</div><p>two</article><footer>x</footer>"
    assert text_of_page(page) == "T\ndeep\nafter\none\ntwo"
    tables = "<table><tr><td>" * deep + "deep" + "</table>" * deep
    assert text_of_page(f"<body><article><div>{tables}</div><p>one</article><p>beside") == "deep\none"
    assert text_of_page("<div>" * 50_000 + "deep" + "</div>" * 50_000 + "<p>after") == "deep\nafter"


def test_wrapper_is_union_free():
    def page(items, ad):
        cells = "".join(f"<dt>k{i}<dd>v{i}" for i in range(items))
        return wrapper_html.generalise(wrapper_html.parse(f"<body><h1>same</h1><dl>{cells}</dl>{'<div>extra</div>' * ad}<p>t{items}</p></body>"))

    w = page(3, 0)
    for items, ad in ((2, 1), (5, 0), (2, 0)):
        w = wrapper_html.merge(w, page(items, ad))
    assert str(w) == "(body(h1(#) dl((dt(#) dd(#))+) div(#)? p(#)))"
    h1 = w.kids[0].kids[0].kids[0]
    assert h1.text == "same" and w.kids[0].kids[-1].kids[0].text is None
    assert str(wrapper_html.load(wrapper_html.dump(w))) == str(w)
