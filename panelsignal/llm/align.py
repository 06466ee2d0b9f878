"""Alignment of two tokenizers' tokens by an associative monoid of fragments.

Both tokenizers cut the same bytes.  Where tokens of both end, a group ends; two
tokens are linked where their byte ranges overlap.  A byte range of a document
is a *fragment*: the tokens that end in it, as an open prefix (up to the first
common end), closed groups, and an open suffix (after the last common end).  Joining
two neighbouring fragments closes one group, the left one's suffix with the right
one's prefix; a fragment without a common end is open as a whole.  The joining is
associative, so fragments may be combined in any tree.

* A text up to ``chunk`` characters is one fragment, made where the row lies.
* A longer one is cut into byte ranges, each a row of its own; tasks make their
  fragments, and rounds of joins of at most ``FAN`` neighbours, keyed by (document,
  position), reduce them to one.

A cut may lie anywhere: the stretch of text that it falls into (white space and
the word behind it; neither tokenizer's tokens reach over a place where a
space or line feed follows something that isn't white space) is tokenised for both
sides, each of which takes the tokens that end in its range.  A stretch over
``MOST_SHARED`` characters is not cut but goes to the left side whole.

Inside a fragment the same stretches come again and again, so a worker keeps the ids,
groups and links of the stretches it has met (at most ``KEPT``).

The corpus-wide counts come from a first pass (documents per linked id pair, summed
in the task, then by Spark).  A second pass looks them up in blocks of at most
``BLOCK_PAIRS`` pairs, each broadcast; with more pairs than that, further blocks
take further passes.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelsignal.llm.common import others, own, split_count, text_or_empty, written
from panelsignal.llm.tokens import _unicode_bytes, kept, slices

CHUNK = 1 << 16
FAN = 16
MOST_SHARED = 4096
KEPT = 250_000
BLOCK_PAIRS = 4_000_000
SLICE_CHARS = 1 << 21
#: Characters handed to the libraries at once.
JOINED = 1 << 16
#: (pair, documents) entries a task holds before it sums them up.
HELD = 2_000_000

#: Where a stretch ends: something that isn't white space, then a space or line feed.
_BORDER = re.compile(r"(?<=\S)(?=[ \n])")
_TWO_WHITE = re.compile(r"\s[ \n]").search

FRAGMENT = (
    "rid long, no long, bad boolean, cut boolean, n_a long, n_b long, n_groups long, head_a array<int>, head_b array<int>, "
    "tail_a array<int>, tail_b array<int>, groups string, pairs array<long>, times array<long>"
)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers."""
    x = np.sort(x)
    return x[np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1]))]


def stretches(text: str) -> list:
    """Keys of the stretches of `` text``: ``word`` for `` word``, ``\\nword`` for itself, ``(s,)`` for any other ``s``."""
    if not _TWO_WHITE(" " + text[:1]) and not _TWO_WHITE(text):
        return text.replace("\n", " \n").split(" ")
    whole = " " + text
    ends = [m.start() for m in _BORDER.finditer(whole)] + [len(whole)]
    out, a = [], 0
    for b in ends:
        s = whole[a:b]
        out.append(s[1:] if s[0] == " " and s[1:2] != "\n" else s if s[0] == "\n" else (s,))
        a = b
    return out


def stretch_text(key) -> str:
    if type(key) is tuple:
        return key[0]
    return key if key[:1] == "\n" else " " + key


class TwoTokenizers:
    """``a``: a byte-level vocabulary file of the tokenizers library, with its split; ``b``: a sentencepiece model."""

    def __init__(self, a_path: str, pattern: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        model = json.load(open(a_path, encoding="utf-8"))
        special = {t["content"] for t in model["added_tokens"] if t["special"]}
        vocabulary, merges = model["model"]["vocab"], model["model"]["merges"]
        byte = {c: b for b, c in _unicode_bytes().items()}
        tokens = {bytes(map(byte.__getitem__, t)): i for t, i in vocabulary.items() if t not in special}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in tokens.items():
            self.a_bytes[i] = t
        merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        if merged == sorted(set(merged)):
            # ids in the order of the merges are ranks: the same ids come from the rank-based library, faster
            import tiktoken

            ranked = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=tokens, special_tokens={})
            self.encode_a = lambda s: ranked.encode_to_numpy(s, disallowed_special=()).astype(np.int64)
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(a_path)
            library.encode_special_tokens = True
            self.encode_a = lambda s: np.array(library.encode(s, add_special_tokens=False).ids, np.int64)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁][▁]|.\n|\n.", p) for p in pieces):
            raise ValueError("pieces that reach over the end of a word")
        hexadecimal = re.compile(r"<0x([0-9A-F]{2})>").fullmatch
        self.b_bytes = [
            bytes([int(m[1], 16)]) if (m := hexadecimal(p)) else p.replace("▁", " ").encode() for p in pieces
        ]
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        # a token's decimal id with the mark behind it: inside a group's ids, at their end, at a text's end
        self.marked = [f"{i}{m}" for x, ms in ((self.a_bytes, ",|"), (self.b_bytes, (",", ";", ""))) for m in ms for i in range(len(x))]
        self.base = len(pieces)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text that begins with a space; None unless both give back its bytes."""
        raw = text.encode()
        a, b = self.encode_a(text), np.array(self.b.encode(text[1:]), np.int64)
        for ids, table in ((a, self.a_bytes), (b, self.b_bytes)):
            if b"".join(map(table.__getitem__, ids.tolist())) != raw:
                return None
        return a, b

    def links(self, a, b, a_ends, b_ends) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the overlaps, in order, and their id pairs as numbers."""
        ends = distinct(np.concatenate((a_ends, b_ends)))
        return ends, a[np.searchsorted(a_ends, ends)] * self.base + b[np.searchsorted(b_ends, ends)]

    def texts(self, a, b, a_ends, b_ends, cuts, last) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for the tokens up to each text's last cut; ``last``: numbers of those among the cuts."""
        if not len(last):
            return []
        # first token behind each cut
        to_a, to_b = np.searchsorted(a_ends, cuts, side="right"), np.searchsorted(b_ends, cuts, side="right")
        a_mark, b_mark = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_mark[to_a - 1] = 1
        b_mark[to_b - 1] = 1
        b_mark[to_b[last] - 1] = 2
        a_many, b_many = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        # a group's second ids stand behind its first ones
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(to_b - b_many, a_many)] = a + a_mark * len(self.a_bytes)
        order[np.arange(len(b)) + np.repeat(to_a, b_many)] = b + b_mark * len(self.b_bytes) + 2 * len(self.a_bytes)
        parts = list(map(self.marked.__getitem__, order.tolist()))
        ends = (to_a + to_b)[last].tolist()
        return ["".join(parts[i:j]) for i, j in zip([0, *ends], ends)]


def two_tokenizers(a_path: str, pattern: str, b_path: str) -> TwoTokenizers:
    return kept(("align", a_path, pattern, b_path), lambda: TwoTokenizers(a_path, pattern, b_path))


# ---------------------------------------------------------------- fragments


def _none() -> np.ndarray:
    return np.empty(0, np.int64)


@dataclass
class Fragment:
    """The tokens that end in a byte range; ``cut``: a common end lies in it."""

    bad: bool = False
    cut: bool = False
    n_a: int = 0
    n_b: int = 0
    head: tuple = field(default_factory=lambda: (_none(), _none()))
    tail: tuple = field(default_factory=lambda: (_none(), _none()))
    groups: list[str] = field(default_factory=list)  # texts of one group or several
    n_groups: int = 0
    pairs: np.ndarray = field(default_factory=_none)  # distinct linked pairs of closed groups
    times: np.ndarray = field(default_factory=_none)


def _totals(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and the sums of their times."""
    p, t = np.concatenate(pairs), np.concatenate(times)
    distinct, row = np.unique(p, return_inverse=True)
    return distinct, np.bincount(row, weights=t, minlength=len(distinct)).astype(np.int64)


def fragment_of(two: TwoTokenizers, text: str, lo: int, hi: int) -> Fragment:
    """The fragment of bytes ``lo`` to ``hi`` of a text that begins where a stretch does."""
    encoded = two.encode(" x" + text)  # behind a word of one letter: the stretches are cut as in the document
    if encoded is None:
        return Fragment(bad=True)
    a, b = encoded
    a_ends, b_ends = np.cumsum(two.a_size[a]) - 2, np.cumsum(two.b_size[b]) - 2
    ina, inb = (a_ends > lo) & (a_ends <= hi), (b_ends > lo) & (b_ends <= hi)
    a, a_ends, b, b_ends = a[ina], a_ends[ina], b[inb], b_ends[inb]
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    out = Fragment(n_a=len(a), n_b=len(b))
    if not len(cuts):
        out.head = (a, b)
        return out
    out.cut = True
    out.head, out.tail = (a[a_ends <= cuts[0]], b[b_ends <= cuts[0]]), (a[a_ends > cuts[-1]], b[b_ends > cuts[-1]])
    ina, inb = (a_ends > cuts[0]) & (a_ends <= cuts[-1]), (b_ends > cuts[0]) & (b_ends <= cuts[-1])
    a, a_ends, b, b_ends = a[ina], a_ends[ina], b[inb], b_ends[inb]
    if len(cuts) > 1:
        out.n_groups = len(cuts) - 1
        out.groups = two.texts(a, b, a_ends, b_ends, cuts[1:], np.array([len(cuts) - 2]))
        out.pairs, out.times = np.unique(two.links(a, b, a_ends, b_ends)[1], return_counts=True)
    return out


def _with_group(two: TwoTokenizers, at: Fragment, a: np.ndarray, b: np.ndarray) -> tuple[str, np.ndarray]:
    """Text and linked pairs of one closed group."""
    a_ends, b_ends = np.cumsum(two.a_size[a]), np.cumsum(two.b_size[b])
    return two.texts(a, b, a_ends, b_ends, a_ends[-1:], np.zeros(1, np.int64))[0], two.links(a, b, a_ends, b_ends)[1]


def joined(two: TwoTokenizers, parts: list[Fragment]) -> Fragment:
    """Neighbouring fragments, in order, as one."""
    out = Fragment(bad=any(p.bad for p in parts), n_a=sum(p.n_a for p in parts), n_b=sum(p.n_b for p in parts))
    if out.bad:
        return Fragment(bad=True)
    pairs, times, groups = [_none()], [_none()], []
    open_a, open_b = [], []  # tokens since the last common end
    for p in parts:
        open_a.append(p.head[0])
        open_b.append(p.head[1])
        if not p.cut:
            continue
        a, b = np.concatenate(open_a), np.concatenate(open_b)
        if out.cut:
            text, linked = _with_group(two, out, a, b)
            groups.append(text)
            pairs.append(linked)
            times.append(np.ones(len(linked), np.int64))
            out.n_groups += 1
        else:
            out.cut, out.head = True, (a, b)
        groups += p.groups
        out.n_groups += p.n_groups
        pairs.append(p.pairs)
        times.append(p.times)
        open_a, open_b = [p.tail[0]], [p.tail[1]]
    rest = (np.concatenate(open_a), np.concatenate(open_b)) if open_a else (_none(), _none())
    if out.cut:
        out.tail = rest
    else:
        out.head = rest
    out.groups = [";".join(groups)] if groups else []
    out.pairs, out.times = _totals(pairs, times)
    return out


def finished(two: TwoTokenizers, whole: Fragment) -> Fragment:
    """A whole document's fragment: its head is a group, as a document begins at a common end."""
    return joined(two, [Fragment(cut=True), whole])


def _row(rid: int, no: int, f: Fragment) -> tuple:
    ints = [x.tolist() for x in (*f.head, *f.tail)]
    return (rid, no, f.bad, f.cut, f.n_a, f.n_b, f.n_groups, *ints, ";".join(f.groups), f.pairs.tolist(), f.times.tolist())


_ARROW = pa.schema(
    [
        *[pa.field(c, pa.int64()) for c in ("rid", "no")],
        *[pa.field(c, pa.bool_()) for c in ("bad", "cut")],
        *[pa.field(c, pa.int64()) for c in ("n_a", "n_b", "n_groups")],
        *[pa.field(c, pa.list_(pa.int32())) for c in ("head_a", "head_b", "tail_a", "tail_b")],
        pa.field("groups", pa.string()),
        *[pa.field(c, pa.list_(pa.int64())) for c in ("pairs", "times")],
    ]
)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


def _fragments(table) -> list[Fragment]:
    out = []
    for r in table.to_pylist():
        ids = [np.array(r[c], np.int64) for c in ("head_a", "head_b", "tail_a", "tail_b")]
        out.append(
            Fragment(
                r["bad"], r["cut"], r["n_a"], r["n_b"], (ids[0], ids[1]), (ids[2], ids[3]), [r["groups"]] if r["n_groups"] else [],
                r["n_groups"], np.array(r["pairs"], np.int64), np.array(r["times"], np.int64),
            )
        )
    return out


def byte_ranges(text: str, chunk: int, most_shared: int = MOST_SHARED) -> list[tuple[str, int, int]]:
    """A text that begins with a space, cut about every ``chunk`` characters: (stretches, from byte, to byte).

    Neighbours share the stretch that their border lies in.
    """
    out, start, cut = [], 0, 0  # where the first stretch of this range begins; where the range does
    while cut < len(text):
        goal = cut + chunk
        border = _BORDER.search(text, goal) if goal < len(text) else None
        end = border.start() if border else len(text)
        left = max(0, goal - most_shared)
        before = [m.start() + left for m in _BORDER.finditer(text[left : goal + 1])] or [0] * (left == 0)
        if goal < end and before and end - before[-1] <= most_shared:
            after, next_start = goal, before[-1]
        else:
            after = next_start = end
        lo = len(text[start:cut].encode())
        out.append((text[start:end], lo, lo + len(text[cut:after].encode())))
        start, cut = next_start, after
    return out


def _long_fragments(long: DataFrame, chunk: int, args: tuple) -> DataFrame:
    """A finished fragment per row of ``long`` (rid, text)."""

    def cut(batches):
        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for no, (part, lo, hi) in enumerate(byte_ranges(" " + text, chunk)):
                    columns = [pa.array([x], t) for x, t in zip((rid, no, part, lo, hi), (*[pa.int64()] * 2, pa.string(), *[pa.int64()] * 2))]
                    yield pa.record_batch(columns, names=["rid", "no", "part", "lo", "hi"])

    def make(batches):
        two = two_tokenizers(*args)
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for rid, no, part, lo, hi in zip(*columns):
                yield from _table([_row(rid, no, fragment_of(two, part, lo, hi))]).to_batches()

    def reduce(table: pa.Table) -> pa.Table:
        table = table.sort_by("no")
        whole = joined(two_tokenizers(*args), _fragments(table))
        return _table([_row(table.column("rid")[0].as_py(), table.column("no")[0].as_py() // FAN, whole)])

    def finish(batches):
        two = two_tokenizers(*args)
        for batch in batches:
            for i, f in enumerate(_fragments(batch)):
                yield from _table([_row(batch.column(0)[i].as_py(), 0, finished(two, f))]).to_batches()

    parts = long.mapInArrow(cut, "rid long, no long, part string, lo long, hi long")
    # a document's ranges go to many tasks
    made = written(parts.repartition("rid", "no").mapInArrow(make, FRAGMENT), "fragments")
    last = made.agg(F.max("no")).first()[0] or 0
    while last > 0:
        made = made.groupBy("rid", F.floor(F.col("no") / FAN).alias("part")).applyInArrow(reduce, FRAGMENT)
        last //= FAN
    return written(made.mapInArrow(finish, FRAGMENT), "long")


# ---------------------------------------------------------------- short texts


class _Numbers(dict):
    """Keys get numbers in the order they are first asked for."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class Stretches:
    """Ids, groups and links of the stretches met, by number.

    ``pairs``, ``docs``, ``best``: sorted pairs with their documents, and whether
    those are the most of their first id; with them each stretch's sums are kept, too.
    """

    def __init__(self, two: TwoTokenizers, block=None, texts: bool = False):
        self.two, self.block, self.with_texts = two, block, texts
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.stats = np.empty((6, 0), np.int64)  # n_a, n_b, n_groups, n_best, count_sum, bad
        self.links = _none()
        self.first = np.zeros(1, np.int64)
        self.texts: list[str] = []

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the stretches of all texts, and how many each text has; empty texts have none."""
        if len(self.number) > KEPT:
            self.clear()
        before = len(self.number)
        sizes, per = [], []
        for t in texts:
            keys = stretches(t) if t else []
            sizes.append(len(keys))
            per.append(np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys)))
        if len(self.number) > before:
            self.add(list(islice(self.number, before, None)))
        return np.concatenate(per) if per else _none(), np.array(sizes, np.int64)

    def add(self, new: list) -> None:
        stats, links, sizes = [self.stats], [self.links], [np.diff(self.first)]
        new = list(map(stretch_text, new))
        # nothing may follow a stretch that ends in white space: it is the end of its text
        cuts = [i + 1 for i, s in enumerate(new) if s[-1].isspace()]
        length = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
        cuts += np.searchsorted(length, np.arange(JOINED, int(length[-1]) + JOINED, JOINED)).tolist()
        cuts = sorted({0, len(new), *(c for c in cuts if c < len(new))})
        for a, b in zip(cuts, cuts[1:]):
            for s, pairs, n, texts in self.analysed(new[a:b]):
                stats.append(s)
                sizes.append(n)
                if self.block is None:
                    links.append(pairs)
                self.texts += texts
        self.stats, self.links = np.concatenate(stats, axis=1), np.concatenate(links)
        self.first = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))

    def analysed(self, part: list[str]):
        """Figures of some stretches: tokenised together behind a word of one letter, which ends where they begin."""
        two = self.two
        encoded = two.encode(" x" + "".join(part))
        if encoded is None:
            if len(part) > 1:
                yield from self.analysed(part[: len(part) // 2])
                yield from self.analysed(part[len(part) // 2 :])
            else:
                stats = np.zeros((6, 1), np.int64)
                stats[5] = 1
                yield stats, _none(), np.zeros(1, np.int64), [""]
            return
        a, b = encoded
        ends = np.cumsum([len(s.encode()) for s in part])
        a_ends, b_ends = np.cumsum(two.a_size[a]) - 2, np.cumsum(two.b_size[b]) - 2
        a, a_ends, b, b_ends = a[a_ends > 0], a_ends[a_ends > 0], b[b_ends > 0], b_ends[b_ends > 0]
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        overlap, pairs = two.links(a, b, a_ends, b_ends)
        n = len(part)
        count = lambda x, w=None: np.bincount(np.searchsorted(ends, x), weights=w, minlength=n).astype(np.int64)
        stats = np.zeros((6, n), np.int64)
        stats[0], stats[1], stats[2] = count(a_ends), count(b_ends), count(cuts)
        if self.block is not None:
            known, docs, best = self.block
            row = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            hit = known[row] == pairs if len(known) else np.zeros(len(pairs), bool)
            at = overlap[hit]
            stats[3], stats[4] = count(at, best[row[hit]]), count(at, docs[row[hit]])
        texts = two.texts(a, b, a_ends, b_ends, cuts, np.cumsum(stats[2]) - 1) if self.with_texts else []
        yield stats, pairs, count(overlap), texts

    def document_pairs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs, and how many of the texts hold each."""
        rows, sizes = self.rows(texts)
        text = np.repeat(np.arange(len(texts)), sizes)
        bad = np.unique(text[self.stats[5][rows] > 0])
        at = distinct((text << 32) | rows)
        text, rows = at >> 32, at & 0xFFFFFFFF
        if len(bad):
            good = ~np.isin(text, bad)
            text, rows = text[good], rows[good]
        many = self.first[rows + 1] - self.first[rows]
        entry = np.repeat(self.first[rows] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        codes = distinct(self.links[entry])
        pair = np.searchsorted(codes, self.links[entry])
        held = distinct(np.repeat(text, many) * max(len(codes), 1) + pair) % max(len(codes), 1)
        return codes, np.bincount(held, minlength=len(codes))

    def figures(self, texts: list[str]) -> tuple[np.ndarray, list[str]]:
        """Per text n_a, n_b, n_groups, n_best, count_sum, bad; and its groups."""
        rows, sizes = self.rows(texts)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        sums = np.concatenate((np.zeros((6, 1), np.int64), np.cumsum(self.stats[:, rows], axis=1)), axis=1)
        out = sums[:, ends[1:]] - sums[:, ends[:-1]]
        out[:, out[5] > 0] = 0
        if not self.with_texts:
            return out, []
        get, numbers, ends = self.texts.__getitem__, rows.tolist(), ends.tolist()
        return out, [";".join(map(get, numbers[a:b])) if n else "" for a, b, n in zip(ends, ends[1:], out[0].tolist())]


# ---------------------------------------------------------------- Spark


def _pair_counts(short: DataFrame, long: DataFrame, args: tuple, base: int) -> DataFrame:
    """pair, docs, best: documents that hold each pair, and whether no pair of its first id has more."""

    def count(batches):
        table = Stretches(two_tokenizers(*args))
        pairs, docs, size = [], [], 0

        def summed():
            p, n = _totals(pairs, docs)
            return pa.record_batch([pa.array(p), pa.array(n)], names=["pair", "docs"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, j in slices(texts, SLICE_CHARS):
                p, n = table.document_pairs(texts[i:j])
                pairs.append(p)
                docs.append(n)
                size += len(p)
                if size > HELD:
                    done = _totals(pairs, docs)
                    pairs, docs, size = [done[0]], [done[1]], len(done[0])
                    if size > HELD // 2:
                        yield summed()
                        pairs, docs, size = [], [], 0
        if size:
            yield summed()

    def each(batches):
        for batch in batches:
            pairs = batch.column(0).flatten()
            yield pa.record_batch([pairs, pa.array(np.ones(len(pairs), np.int64))], names=["pair", "docs"])

    schema = "pair long, docs long"
    counts = short.select("body").mapInArrow(count, schema).union(long.select("pairs").mapInArrow(each, schema))
    counts = counts.groupBy("pair").agg(F.sum("docs").alias("docs"))
    # an id has at most as many pairs as the other vocabulary has ids
    first = F.floor(F.col("pair") / base)
    most = F.max("docs").over(Window.partitionBy(first))
    return written(counts.withColumn("best", F.col("docs") == most), "pairs")


def align_tokenizers(
    docs: DataFrame,
    a_path: str,
    pattern: str,
    b_path: str,
    *,
    text: str = "text",
    columns: Sequence[str] | None = None,
    chunk: int = CHUNK,
    block_pairs: int = BLOCK_PAIRS,
) -> DataFrame:
    """``columns`` of ``docs`` (all if not given) with n_a, n_b, n_groups, n_links, n_best, count_sum (longs) and ``groups``
    (``a1,a2|b1;a3|b2,b3``: the ids of each group).

    ``a_path``: a byte-level vocabulary of the tokenizers library, which encodes a space and the text; ``pattern``: its
    split; ``b_path``: a sentencepiece model, which adds the space itself.  Strings of special tokens are
    plain text.  n_links counts overlapping token pairs; an id pair's count is how many rows hold it linked; n_best counts
    links whose count is the highest of their first id (ties included); count_sum adds up the counts of all links.

    A row per row of ``docs``; repeated rows count as often as they stand there.  Null and empty
    texts, and texts whose tokens don't give back their bytes, have no tokens: zeros and empty ``groups``.
    Columns of ``docs`` named as the new ones are replaced; an empty table gives an empty one.
    """
    args = (a_path, pattern, b_path)
    new = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    names = others(docs if columns is None else docs.select(*columns), *new)
    base = two_tokenizers(*args).base
    carried = docs.select(F.struct(*names).alias("row"), text_or_empty(text).alias("body"))
    is_long = F.length("body") > chunk
    short = carried.where(~is_long)
    # the numbers have to stay as they are once given
    long = written(carried.where(is_long).withColumn("rid", F.monotonically_increasing_id()), "long-texts")
    fragments = _long_fragments(long.select("rid", "body"), chunk, args)
    pairs = _pair_counts(short, fragments, args, base)
    blocks = split_count(pairs.count(), block_pairs)
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("pair"), F.lit(blocks)))
    figures = ["n_a", "n_b", "n_groups", "n_best", "count_sum"]
    long_out = fragments.select("rid", "bad", *figures[:3], "groups", "pairs", "times", *[F.lit(0).cast("long").alias(c) for c in figures[3:]])
    short_out = short
    for i in range(blocks):
        table = pairs.where(F.col("block") == i).select("pair", "docs", "best").toArrow().sort_by("pair")
        block = tuple(table.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "docs", "best"))
        short_out = _short_scored(short_out, args, block, last=i + 1 == blocks)
        long_out = _long_scored(long_out, block)
        if i + 1 < blocks:
            short_out, long_out = written(short_out, "short-scored"), written(long_out, "long-scored")
    long_out = long.select("rid", "row").join(long_out.drop("bad", "pairs", "times"), "rid")
    both = short_out.select("row", *figures, "groups").union(long_out.select("row", *figures, "groups"))
    # overlaps end where a token of either ends
    n_links = (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links")
    return both.select("row.*", *figures[:3], n_links, *figures[3:], "groups")


def _short_scored(short: DataFrame, args: tuple, block: tuple, last: bool) -> DataFrame:
    """Figures of one block of pairs, added to those of earlier blocks; with the last one the groups, too."""
    shared = short.sparkSession.sparkContext.broadcast(block)
    figures = ["n_a", "n_b", "n_groups", "n_best", "count_sum"]
    again = "n_a" in short.columns
    carried = ["row"] if last else ["row", "body"]
    fields = [*[short.schema[c] for c in carried], *[T.StructField(c, T.LongType()) for c in figures]]
    schema = T.StructType([*fields, *[T.StructField("groups", T.StringType())] * last])
    names = schema.names

    def run(batches):
        table = Stretches(two_tokenizers(*args), shared.value, texts=last)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in slices(texts, SLICE_CHARS):
                part = batch.slice(i, j - i)
                found, groups = table.figures(texts[i:j])
                if again:
                    found[3] += part.column(5).to_numpy(zero_copy_only=False)
                    found[4] += part.column(6).to_numpy(zero_copy_only=False)
                columns = [*[part.column(k) for k in range(len(carried))], *[pa.array(found[k]) for k in range(5)]]
                yield pa.record_batch([*columns, *[pa.array(groups, pa.string())] * last], names=names)

    return short.mapInArrow(run, schema)


def _long_scored(long: DataFrame, block: tuple) -> DataFrame:
    """``long`` with the block's counts of its pairs added to n_best and count_sum."""
    shared = long.sparkSession.sparkContext.broadcast(block)
    names = long.columns
    at = {c: names.index(c) for c in ("pairs", "times", "n_best", "count_sum")}

    def run(batches):
        known, docs, best = shared.value
        for batch in batches:
            more = {"n_best": [], "count_sum": []}
            for i in range(batch.num_rows):
                pairs, times = (np.asarray(batch.column(at[c])[i].values) for c in ("pairs", "times"))
                row = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
                hit = known[row] == pairs if len(known) else np.zeros(len(pairs), bool)
                more["n_best"].append(int((times[hit] * best[row[hit]]).sum()))
                more["count_sum"].append(int((times[hit] * docs[row[hit]]).sum()))
            columns = list(batch.columns)
            for c, x in more.items():
                columns[at[c]] = pa.array(columns[at[c]].to_numpy(zero_copy_only=False) + np.array(x, np.int64))
            yield pa.record_batch(columns, names=names)

    return long.mapInArrow(run, long.schema)


__all__ = ["Fragment", "Stretches", "TwoTokenizers", "align_tokenizers", "byte_ranges", "finished", "fragment_of", "joined", "two_tokenizers"]
