"""Packing documents into sequences: first-fit decreasing on a tournament tree.

Documents are dealt into randomised groups by a hash of the row, so that a
group is a fair sample of lengths whatever order or source the rows came in.
Each group is packed on its own, in one task: every document is tokenised and
cut into full sequences and one rest; the rests go first-fit decreasing into
bins, the first bin with room being found in a tournament tree of remaining
capacities (each inner node holds the larger capacity below it, so the search
walks down once).  Bins that first-fit leaves short are then topped up from
the emptiest bins of the group, which are cut to measure; the last short bin
of a group is cut into power-of-two sequences, which need no padding.

One shuffle (the texts, by group); a group holds ``docs_per_group`` rows on
average at every size of the input, and groups are packed independently, so a
lost executor costs its own groups only.  The group is a function of the row
alone: a recomputed row lands in the same group, and ids are the same.

Defined results: null and empty texts are one piece with the end id; a null id
stays null; repeated rows are packed each for itself; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsignal.llm.common import split_count, text_or_empty
from panelsignal.llm.tokens import slices, spaced_encoder

SEQUENCE = 1024
END_ID = 0
DOCS_PER_GROUP = 1024
MIN_GAP = 8
#: Bounds what a worker, and the JVM beside it, hold besides a group: characters tokenised at once, pieces sent at once.
SLICE_CHARS = 1 << 20
SEND = 512

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, padded_to long, ids binary"
_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "padded_to")]
    + [("ids", pa.binary())]
)


class TournamentTree:
    """Remaining capacities of bins; finds the first bin that can take a size."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.most = [capacity] * (2 * self.leaves)

    def take_first(self, size: int) -> int:
        most, leaves, i = self.most, self.leaves, 1
        while i < leaves:
            i *= 2
            if most[i] < size:
                i += 1
        found = i - leaves
        most[i] -= size
        while i > 1:
            i //= 2
            most[i] = max(most[2 * i], most[2 * i + 1])
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers; ``sizes`` must be in decreasing order."""
    tree, bins = TournamentTree(max(1, len(sizes)), capacity), []
    for item, size in enumerate(sizes):
        b = tree.take_first(size)
        if b == len(bins):
            bins.append([])
        bins[b].append(item)
    return bins


def pack_rests(rests: list[tuple], capacity: int, min_gap: int) -> list[list[tuple]]:
    """Sequences as lists of (document, start, length); ``rests`` likewise, longest first."""
    bins = [[rests[i] for i in b] for b in first_fit_decreasing([r[2] for r in rests], capacity)]
    fill = [sum(p[2] for p in b) for b in bins]
    short = sorted((i for i, f in enumerate(fill) if capacity - f >= min_gap), key=lambda i: -fill[i])
    low, high = 0, len(short) - 1
    while low < high:
        i, j = short[low], short[high]
        while fill[i] < capacity and bins[j]:
            d, start, n = bins[j].pop()
            cut = min(n, capacity - fill[i])
            bins[i].append((d, start, cut))
            fill[i] += cut
            fill[j] -= n
            if cut < n:
                bins[j].append((d, start + cut, n - cut))
                fill[j] += n - cut
        low += fill[i] == capacity
        high -= not bins[j]
    if low == high and bins[short[low]]:
        last, bins[short[low]] = bins[short[low]], []
        bins += powers_of_two(last)
    return [b for b in bins if b]


def powers_of_two(pieces: list[tuple]) -> list[list[tuple]]:
    """The pieces in order, cut into sequences whose lengths are powers of two, longest first."""
    out, left, pieces = [], sum(p[2] for p in pieces), list(pieces)
    while left:
        want = 1 << (left.bit_length() - 1)
        left -= want
        out.append([])
        while want:
            d, start, n = pieces.pop(0)
            cut = min(n, want)
            out[-1].append((d, start, cut))
            want -= cut
            if cut < n:
                pieces.insert(0, (d, start + cut, n - cut))
    return out


def padded_length(length: int, capacity: int) -> int:
    return length if length & (length - 1) == 0 else capacity


def pack_group(docs: list[tuple], capacity: int, min_gap: int) -> list[list[tuple]]:
    """``docs``: (document number, its ids in all); sequences of (document, start, length)."""
    full, rests = [], []
    for d, n in docs:
        whole = n - n % capacity
        full += [[(d, s, capacity)] for s in range(0, whole, capacity)]
        if n > whole:
            rests.append((d, whole, n - whole))
    rests.sort(key=lambda r: -r[2])
    return full + pack_rests(rests, capacity, min_gap)


def small_batches(rows: pa.Table, size: int = SEND) -> pa.Table:
    """The same rows as batches, which Spark receives one at a time."""
    return pa.Table.from_batches(rows.to_batches(max_chunksize=size), rows.schema)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    pattern: str,
    end_id: int = END_ID,
    capacity: int = SEQUENCE,
    docs_per_group: int = DOCS_PER_GROUP,
    min_gap: int = MIN_GAP,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece, with its ids (little-endian unsigned 32-bit) and the length its sequence is padded to.

    ``tokenizer``: a byte-level vocabulary of the tokenizers library; ``pattern``: its split.
    """
    # for `nulls in any column`: the hash skips nulls, the text spreads them
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    groups = split_count(docs.select(id_col).count(), docs_per_group)
    base = base.withColumn("group", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))
    end = end_id.to_bytes(4, "little")

    def pack(batch: pa.Table) -> pa.Table:
        # order within the group must not depend on the order of arrival
        batch = batch.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        texts, doc_ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
        group = batch.column("group")[0].as_py()
        enc = spaced_encoder(tokenizer, pattern)
        ids = [x + end for a, b in slices(texts, SLICE_CHARS) for x in enc.encode(texts[a:b])]
        sequences = pack_group([(i, len(x) // 4) for i, x in enumerate(ids)], capacity, min_gap)
        cols: list[list] = [[] for _ in _ARROW]
        for k, seq in enumerate(sequences):
            offset, padded = 0, padded_length(sum(p[2] for p in seq), capacity)
            for d, start, n in seq:
                row = (doc_ids[d], start, n, len(ids[d]) // 4, (group << 32) | k, offset, padded, ids[d][4 * start : 4 * (start + n)])
                for c, v in zip(cols, row):
                    c.append(v)
                offset += n
        rows = pa.table([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)
        return small_batches(rows)

    return base.groupBy("group").applyInArrow(pack, SCHEMA)


__all__ = ["first_fit_decreasing", "pack_documents", "pack_group", "padded_length"]
