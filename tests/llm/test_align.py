"""Cross-tokenizer alignment against brute force over both libraries' own results."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from panelsignal.llm import align
from panelsignal.llm.queries import op11_fragment_alignment
from panelsignal.llm.tokens import _unicode_bytes

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ARGS = (A, P.PATTERN, B)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """Ids and bytes of both libraries' tokens, or None without tokens."""
    a, b = libraries
    if not text:
        return None
    byte = {c: n for n, c in _unicode_bytes().items()}
    xa = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    xb = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        xb.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    if any(b"".join(t for _, t in x) != raw for x in (xa, xb)):
        return None
    return xa, xb


def brute(libraries, texts):
    docs, holders = [], Counter()
    for text in texts:
        got = tokens(libraries, text)
        if got is None:
            docs.append(None)
            continue
        spans = []
        for x in got:
            end, out = 0, []
            for i, t in x:
                out.append((end, end + len(t), i))
                end += len(t)
            spans.append(out)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [[[i for s, e, i in x if lo < e <= hi] for x in spans] for lo, hi in zip([0, *cuts], cuts)]
        links, j = [], 0
        for s, e, i in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        docs.append((len(got[0]), len(got[1]), groups, links))
        holders.update(set(links))
    most = defaultdict(int)
    for (a, _), n in holders.items():
        most[a] = max(most[a], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = d
        text = ";".join("|".join(",".join(map(str, x)) for x in g) for g in groups)
        best = sum(holders[p] == most[p[0]] for p in links)
        out.append((n_a, n_b, len(groups), len(links), best, sum(holders[p] for p in links), text))
    return out


ODD = [
    None, "", " ", "  ", "\n", "\n\n x", " lead", "trail ", "a  b", "a \n b\n\nc", "tab\tnext \t two", "x\r\ny\r\n", "cr\rlf; \r\n{\r",
    "<s> </s> <unk> <0x41> <|endoftext|>", "low ▁ block▁", "日本語 テスト", "É́ combining ﬁ ½ Ω", "\x00 nul\x1c\x1f \x85 nel ",
    "emoji 👩‍👩‍👧 🇩🇪 ok", "z" * 3000, "ab1!" * 700, " " * 500 + "x", "nbsp  x　y", "don't I'll we've 1234567 3.14", "\U0010ffff￾",
]


def mixed(rng, n):
    words = ["the", "Tokenizer", "überraschung", "x1", "…", "naïve", "日本", "don't", "supercalifragilistic", ";", "123456", "\t", "\n", "\r\n", " ", ""]
    return " ".join(rng.choice(words) for _ in range(n))


def test_fragments_join_to_the_whole(libraries):
    """Any cutting into byte ranges and any tree of joins gives the same groups."""
    rng = random.Random(11)
    two = align.two_tokenizers(*ARGS)
    texts = [t for t in ODD if t] + [mixed(rng, 200) for _ in range(15)]
    for text, want in zip(texts, brute(libraries, texts)):
        for chunk, shared in ((1, 10), (3, 4096), (17, 5), (40, 4096), (1000, 4096)):
            ranges = align.byte_ranges(" " + text, chunk, shared)
            parts = [align.fragment_of(two, *r) for r in ranges]
            while len(parts) > 1:
                k = rng.randrange(len(parts) - 1)
                m = rng.randint(2, 4)
                parts[k : k + m] = [align.joined(two, parts[k : k + m])]
            f = align.finished(two, parts[0])
            if f.bad:
                assert want[0] == 0
                continue
            assert (f.n_a, f.n_b, f.n_groups, int(f.times.sum()), ";".join(f.groups)) == (*want[:4], want[6]), (text, chunk)
            assert not len(f.tail[0]) and not len(f.head[0])


@pytest.mark.parametrize("chunk,block_pairs", [(1 << 16, 4_000_000), (60, 150)])
def test_whole_table(spark, libraries, chunk, block_pairs):
    rng = random.Random(2)
    texts = ODD + [mixed(rng, rng.randint(1, 60)) for _ in range(40)] + ["a  b", None, mixed(rng, 4000)]
    df = spark.createDataFrame([(i % 50, t, "e", "e") for i, t in enumerate(texts)], "doc_id long, text string, Groups string, rid string")
    out = align.align_tokenizers(df, *ARGS, chunk=chunk, block_pairs=block_pairs)
    assert out.columns == ["doc_id", "text", "rid", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    got = Counter(tuple(r)[:2] + tuple(r)[3:] for r in out.collect())
    assert got == Counter((i % 50, t, *w) for i, (t, w) in enumerate(zip(texts, brute(libraries, texts))))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert align.align_tokenizers(empty, *ARGS).collect() == []


def test_query_columns(spark, libraries, tmp_path):
    rng = random.Random(4)
    texts = [mixed(rng, rng.randint(0, 80)) for _ in range(30)] + ODD
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in op11_fragment_alignment(spark, str(tmp_path)).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    assert got == [(i, *w[:6], sha(w[6])) for i, w in enumerate(brute(libraries, texts))]
