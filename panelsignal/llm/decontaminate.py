"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its stretches of ``width`` words (an item of fewer is
one window).  A window is a set of shingles of three words; it occurs in a
document only if all of them do, so the prefix that the two must share is a
single shingle, and the rarest one in the documents is taken:

1. windows: the distinct (window, item) pairs of the benchmark, a written table,
   dealt at random into blocks of at most about ``BLOCK_WINDOWS`` pairs;
2. rarity: one pass over all documents counts the block's shingles;
3. join: a second pass looks up the prefix shingles in every document.  Where
   one stands, each of its windows has one possible start (positional bound),
   has to end within the document (length bound), and is compared word by word.

A block is what is broadcast: its size has a bound whatever the benchmark's is.
Further blocks take further passes over the documents, so any benchmark
is covered whole.  Documents are never shuffled, collected or cut; a passage that many
documents hold costs each of them its own look-ups alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelsignal.llm.common import others, own, split_count, written
from panelsignal.llm.tokens import slices

WIDTH = 10
SHINGLE = 3

#: (window, item) pairs of a block.  With ten words a window, numbers of words stay below 2**21 and three fit 63 bits.
BLOCK_WINDOWS = 200_000
SLICE_CHARS = 1 << 22
#: Possible places of windows compared at once.
COMPARED = 1 << 17

SPANS = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "end")]), False)
ITEMS = T.ArrayType(T.StringType(), False)

#: Bytes of words: a-z, 0-9 and all beyond ASCII; A-Z in lower case; the rest parts words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: lower-case ASCII letters, digits and characters beyond ASCII."""
    return (text or "").encode().translate(_FOLD).split()


def windows_of(words: list[bytes], width: int = WIDTH) -> list[bytes]:
    """Stretches of ``width`` words, or all of fewer; none without words."""
    if not words:
        return []
    return [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (window, item): the window's words joined by blanks, and the item's id as a string."""

    def run(batches):
        for batch in batches:
            items, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for item, body in zip(items, texts):
                found = windows_of(words_of(body), width)
                for i in range(0, len(found), 1 << 16):
                    part = found[i : i + (1 << 16)]
                    yield pa.record_batch(
                        [pa.array(part, pa.string()), pa.array([item] * len(part), pa.string())], names=["window", "item"]
                    )

    source = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "window string, item string").distinct()


def shingle_codes(ids: np.ndarray, k: int, base: int) -> np.ndarray:
    """One number per stretch of ``k`` word numbers (along the last axis); -1 where a word has none."""
    n = max(0, ids.shape[-1] - k + 1)
    code = ids[..., :n].astype(np.int64)
    unknown = code < 0
    for j in range(1, k):
        part = ids[..., j : j + n]
        code = code * base + part
        unknown |= part < 0
    code[unknown] = -1
    return code


class Block:
    """Windows of a block: their words as numbers, their items, and their shingles."""

    def __init__(self, windows: list[str], items: list[str | None]):
        self.items: list[list[str]] = []
        numbers: dict[str, int] = {}
        for w, item in zip(windows, items):
            if w not in numbers:
                numbers[w] = len(numbers)
                self.items.append([])
            if item is not None:
                self.items[numbers[w]].append(item)
        split = [w.encode().split() for w in numbers]
        self.vocabulary: dict[bytes, int] = {}
        for words in split:
            for word in words:
                self.vocabulary.setdefault(word, len(self.vocabulary))
        self.lengths = np.array([len(w) for w in split], np.int64)
        self.words = np.full((len(split), int(self.lengths.max(initial=1))), -1, np.int64)
        for i, words in enumerate(split):
            self.words[i, : len(words)] = [self.vocabulary[w] for w in words]
        #: by words of a shingle (fewer than SHINGLE only in windows of as few words): windows, and their shingles
        self.parts = {
            k: np.flatnonzero(np.minimum(self.lengths, SHINGLE) == k) for k in range(1, SHINGLE + 1)
        }
        self.codes = {k: shingle_codes(self.words[at], k, self.base) for k, at in self.parts.items()}
        self.table = {k: np.unique(c[c >= 0]) for k, c in self.codes.items()}

    @property
    def base(self) -> int:
        return max(1, len(self.vocabulary))

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Keep each window's rarest shingle (the first of equals); ``counts`` goes with ``table``."""
        self.prefix, self.first, self.window, self.offset = {}, {}, {}, {}
        for k, at in self.parts.items():
            codes, table = self.codes[k], self.table[k]
            if not len(at):
                continue
            often = np.where(codes >= 0, counts[k][np.minimum(np.searchsorted(table, codes), len(table) - 1)], np.iinfo(np.int64).max)
            offset = often.argmin(axis=1)
            code = codes[np.arange(len(at)), offset]
            seen = often[np.arange(len(at)), offset] > 0  # else the window occurs nowhere
            order = np.flatnonzero(seen)[np.argsort(code[seen], kind="stable")]
            self.prefix[k], starts = np.unique(code[order], return_index=True)
            self.first[k] = np.append(starts, len(order))
            self.window[k], self.offset[k] = at[order], offset[order]
        self.codes = self.table = None  # workers need the prefixes only

    def numbers(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of all texts with a -1 after each, the first place and the number of words of each."""
        get, per, sizes = self.vocabulary.get, [], []
        for t in texts:
            words = words_of(t)
            sizes.append(len(words))
            per.append(np.fromiter(map(get, words, repeat(-1)), np.int64, len(words)))
            per.append(np.full(1, -1, np.int64))
        sizes = np.array(sizes, np.int64)
        return np.concatenate(per) if per else np.empty(0, np.int64), np.cumsum(sizes + 1) - sizes - 1, sizes

    def occurrences(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of every occurrence in the texts behind ``ids``."""
        places, windows = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k, prefix in self.prefix.items():
            if not len(prefix):
                continue
            codes = shingle_codes(ids, k, self.base)
            known = np.flatnonzero(codes >= 0)
            row = np.searchsorted(prefix, codes[known])
            hit = prefix[np.minimum(row, len(prefix) - 1)] == codes[known]
            at, row = known[hit], row[hit]
            many = self.first[k][row + 1] - self.first[k][row]
            ends = np.cumsum(many)
            done = 0
            while done < len(at):  # as many places as make COMPARED pairs, one at least
                upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + COMPARED)))
                n = many[done:upto]
                entry = np.repeat(self.first[k][row[done:upto]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                window = self.window[k][entry]
                start = np.repeat(at[done:upto], n) - self.offset[k][entry]
                text = np.searchsorted(starts, np.repeat(at[done:upto], n), side="right") - 1
                length = self.lengths[window]
                fits = (start >= starts[text]) & (start + length <= starts[text] + sizes[text])
                window, start, length = window[fits], start[fits], length[fits]
                j = np.arange(self.words.shape[1])
                inside = j < length[:, None]
                found = ids[np.minimum(start[:, None] + j, len(ids) - 1)]
                same = ((found == self.words[window]) | ~inside).all(axis=1)
                places.append(start[same])
                windows.append(window[same])
                done = upto
        return np.concatenate(places), np.concatenate(windows)

    def search(self, texts: Sequence[str | None]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
        """Per text: number of words, stretches of hit words as (start, end), items with an occurring window."""
        ids, starts, sizes = self.numbers(texts)
        place, window = self.occurrences(ids, starts, sizes)
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        edges = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edges, place, 1)
        np.add.at(edges, place + self.lengths[window], -1)
        covered = np.concatenate(([0], (np.cumsum(edges[:-1]) > 0).astype(np.int8), [0]))
        change = np.diff(covered)
        first, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        for t, a, b in zip((np.searchsorted(starts, first, side="right") - 1).tolist(), first.tolist(), end.tolist()):
            spans[t].append((a - int(starts[t]), b - int(starts[t])))
        text = np.searchsorted(starts, place, side="right") - 1
        pairs = np.unique(text * len(self.lengths) + window)
        for pair in pairs.tolist():
            t, w = divmod(pair, len(self.lengths))
            items[t].update(self.items[w])
        return sizes, spans, items


def _counted(docs: DataFrame, text: str, block: Block) -> dict[int, np.ndarray]:
    """How often each shingle of the block's table stands in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        b = shared.value
        totals = {k: np.zeros(len(t), np.int64) for k, t in b.table.items()}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, j in slices([t or "" for t in texts], SLICE_CHARS):
                ids, _, _ = b.numbers(texts[i:j])
                for k, table in b.table.items():
                    if len(table):
                        codes = shingle_codes(ids, k, b.base)
                        codes = codes[codes >= 0]
                        row = np.minimum(np.searchsorted(table, codes), len(table) - 1)
                        totals[k] += np.bincount(row[table[row] == codes], minlength=len(table))
        for k, n in totals.items():
            at = np.flatnonzero(n)
            if len(at):
                columns = [pa.array(np.full(len(at), k, np.int64)), pa.array(at), pa.array(n[at])]
                yield pa.record_batch(columns, names=["k", "place", "n"])

    rows = docs.select(F.col(text).cast("string")).mapInArrow(run, "k long, place long, n long")
    rows = rows.groupBy("k", "place").agg(F.sum("n").alias("n")).toArrow()
    counts = {k: np.zeros(len(t), np.int64) for k, t in block.table.items()}
    k, place, n = (rows.column(c).to_numpy() for c in ("k", "place", "n"))
    for part in counts:
        counts[part][place[k == part]] = n[k == part]
    shared.unpersist()
    return counts


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of stretches, touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _searched(docs: DataFrame, text: str, names: Sequence[str], block: Block | None, again: bool) -> DataFrame:
    """``docs`` with the hits of one block, added to those of earlier ones if ``again``."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    n_words, spans, items = names
    body = own("text")
    kept = docs.select(*others(docs, *names))
    source = docs.select(*kept.columns, F.col(text).cast("string").alias(body), *([spans, items] if again else []))
    fields = [T.StructField(n_words, T.LongType()), T.StructField(spans, SPANS), T.StructField(items, ITEMS)]
    schema = T.StructType([*kept.schema.fields, *fields])
    n, columns = len(kept.columns), [*kept.columns, *names]
    pair = pa.struct([pa.field("start", pa.int64(), False), pa.field("end", pa.int64(), False)])

    def run(batches):
        b = shared.value
        for batch in batches:
            texts = batch.column(n).to_pylist()
            for i, j in slices([t or "" for t in texts], SLICE_CHARS):
                part = batch.slice(i, j - i)
                sizes, found, hit = b.search(texts[i:j])
                if again:
                    earlier = [[(x["start"], x["end"]) for x in r] for r in part.column(n + 1).to_pylist()]
                    found = [merged(x + y) for x, y in zip(found, earlier)]
                    hit = [x.union(y) for x, y in zip(hit, part.column(n + 2).to_pylist())]
                spans_out = [[{"start": s, "end": e} for s, e in r] for r in found]
                yield pa.record_batch(
                    [
                        *[part.column(c) for c in range(n)],
                        pa.array(sizes),
                        pa.array(spans_out, pa.list_(pair)),
                        pa.array([sorted(x) for x in hit], pa.list_(pa.string())),
                    ],
                    names=columns,
                )

    return source.mapInArrow(run, schema)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    names: Sequence[str] = ("n_words", "spans", "items"),
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (array of (start, end) word numbers: the
    longest stretches of words inside any occurrence of a window) and ``items`` (the sorted ids, as strings, of the
    items with an occurring window).

    A row per row of ``docs``.  Null and empty texts, and texts without words, have no hits; so
    have all documents where the benchmark is empty.  Items with null or empty texts have no windows; an
    item whose id is null hits words but is not listed; of equal ids one is listed.
    Columns of ``docs`` named as the new ones are replaced.
    """
    windows = written(benchmark_windows(benchmark, width, item_id, item_text), "windows")
    blocks = split_count(windows.count(), block_windows)
    windows = windows.withColumn("block", F.pmod(F.xxhash64("window", "item"), F.lit(blocks)))
    out = docs
    for i in range(blocks):
        rows = windows.where(F.col("block") == i).select("window", "item").toArrow()
        block = Block(rows.column("window").to_pylist(), rows.column("item").to_pylist())
        block.choose(_counted(docs, text, block))
        out = _searched(out, text, names, block, again=i > 0)
        if i + 1 < blocks:
            out = written(out, "contamination")
    return out


__all__ = ["Block", "benchmark_windows", "find_contamination", "merged", "windows_of", "words_of"]
