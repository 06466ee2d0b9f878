"""Byte-level BPE with a hierarchical-bitmap rank queue, and its inverse.

A pre-token's bytes form a linked list.  Every pair with a merge rank stands in
the bucket of that rank; a three-level bitmap (64-way, find-first-set on each
level) gives the lowest rank in use, and an entry whose pair has changed since
is stale and skipped.  A merge costs constant time besides the bucket's own
order, so a pre-token of n bytes costs about n steps however long it is, where
a scan for the minimum costs n per merge.

New pre-tokens of a batch share one queue: their lists lie side by side in
arrays, and popping a rank merges, in every pre-token, its leftmost pair of
that rank at once.  The lowest rank over all lists is the lowest of every list
it occurs in, so each list sees the very order it would see alone.  A pre-token
over ``LONG`` bytes gets a queue of its own.

The work is one map over the documents (no shuffle).  Words and pre-tokens that
a worker has met are looked up in a bounded memo.

Defined results: null and empty texts have no ids; repeated rows are encoded
each for itself; ids outside the table fail on decoding; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsignal.llm.common import text_or_empty
from panelsignal.llm.tokens import MEMO_CHARS, Memo, explicit_white, kept, slices, spaced_keys, spaced_text

LONG = 512
#: Words and pre-tokens remembered, each; less than the default as the merge arrays need room too.
WORDS_KEPT = 150_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankBitmap:
    """A set of ranks; ``low[r >> 6]`` has a bit per rank, ``mid[r >> 12]`` one
    per word of ``low``, ``top`` one per word of ``mid``."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def add(self, rank: int) -> None:
        a = rank >> 6
        self.low[a] |= 1 << (rank & 63)
        self.mid[a >> 6] |= 1 << (a & 63)
        self.top |= 1 << (a >> 6)

    def first(self) -> int:
        c = (self.top & -self.top).bit_length() - 1
        w = self.mid[c]
        a = (c << 6) | ((w & -w).bit_length() - 1)
        w = self.low[a]
        return (a << 6) | ((w & -w).bit_length() - 1)

    def remove(self, rank: int) -> None:
        a = rank >> 6
        self.low[a] &= ~(1 << (rank & 63))
        if not self.low[a]:
            self.mid[a >> 6] &= ~(1 << (a & 63))
            if not self.mid[a >> 6]:
                self.top &= ~(1 << (a >> 6))


class BitmapBPE:
    """Encodes by a rank table as the tiktoken library would, without special tokens."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = read_ranks(path)
        self.longest = max(map(len, self.ranks))
        self.n_ranks = max(self.ranks.values()) + 1
        self.split = regex.compile(explicit_white(pattern)).findall
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        # every cut of a table entry into two entries, by (left, right)
        pairs = {
            self.ranks[w[:i]] * self.n_ranks + self.ranks[w[i:]]: r
            for w, r in self.ranks.items()
            for i in range(1, len(w))
            if w[:i] in self.ranks and w[i:] in self.ranks
        }
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.pieces: dict[str, bytes] = {}

    def _pair_rank(self, left, right) -> np.ndarray:
        q = left * self.n_ranks + right
        at = np.searchsorted(self.pair_keys, q)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == q, self.pair_ranks[at], -1)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token, with a queue of its own."""
        ranks, n, longest, used = self.ranks, len(piece), self.longest, RankBitmap(self.n_ranks)
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        after, before, pair = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        get, buckets = ranks.get, {}

        def push(rank: int, position: int) -> None:
            pair[position] = rank
            if rank in buckets:
                heappush(buckets[rank], position)
            else:
                buckets[rank] = [position]
                used.add(rank)

        for i in range(n - 1):
            if (r := get(piece[i : i + 2])) is not None:
                push(r, i)
        while used.top:
            r = used.first()
            i = heappop(buckets[r])
            if not buckets[r]:
                del buckets[r]
                used.remove(r)
            if pair[i] != r:
                continue  # stale: the pair at this position has changed
            j = after[i]
            k = after[j]
            after[i], pair[j], pair[i] = k, -1, -1
            if k < n:
                before[k] = i
                if after[k] - i <= longest and (x := get(piece[i : after[k]])) is not None:
                    push(x, i)
            h = before[i]
            if h >= 0:
                pair[h] = -1
                if k - h <= longest and (x := get(piece[h:k])) is not None:
                    push(x, h)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """The ids (little-endian unsigned 32-bit) of non-empty pre-tokens, by one shared queue."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        if not len(sizes):
            return []
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        token = self.byte_rank[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(token)
        owner = np.append(np.repeat(np.arange(len(pieces)), sizes), -1)  # the last: behind the end
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        before[starts] = -1
        alive = np.ones(n, bool)
        pair = np.full(n, -1, np.int64)
        inner = np.flatnonzero(owner[1:n] == owner[: n - 1])
        pair[inner] = self._pair_rank(token[inner], token[inner + 1])
        used, buckets = RankBitmap(self.n_ranks), {}

        def push(at: np.ndarray) -> None:
            at = at[pair[at] >= 0]
            if not len(at):
                return
            ranks = pair[at]
            if len(at) > 1:
                order = np.argsort(ranks, kind="stable")
                at, ranks = at[order], ranks[order]
                cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)]
            else:
                cuts = [0, 1]
            for a, b, r in zip(cuts, cuts[1:], ranks[cuts[:-1]].tolist()):
                if r in buckets:
                    buckets[r].append(at[a:b])
                else:
                    buckets[r] = [at[a:b]]
                    used.add(r)

        push(inner)
        while used.top:
            r = used.first()
            found = buckets.pop(r)
            used.remove(r)
            i = found[0] if len(found) == 1 else np.concatenate(found)
            i = i[pair[i] == r]  # without stale entries
            if not len(i):
                continue
            if len(i) > 1:
                i = np.unique(i)
                mine = owner[i]
                later = np.concatenate(([False], mine[1:] == mine[:-1]))
                if later.any():
                    push(i[later])
                    i = i[~later]
            j = after[i]
            k = after[j]
            after[i], token[i], alive[j], pair[j], pair[i] = k, r, False, -1, -1
            on = owner[k] == owner[i]
            ki, ik = k[on], i[on]
            before[ki] = ik
            pair[ik] = self._pair_rank(r, token[ki])
            h = before[i]
            h = h[h >= 0]
            pair[h] = self._pair_rank(token[h], r)
            push(np.concatenate((ik, h)))
        ends = np.cumsum(np.add.reduceat(alive, starts, dtype=np.int64)) * 4
        ids = token[alive].astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def words(self, keys: list) -> list[bytes]:
        """Ids of new words: those of their pre-tokens."""
        known, get = self.pieces, self.ranks.get
        parts = [self.split(spaced_text(k)) for k in keys]
        found: dict[str, bytes] = {}
        queued = []
        for p in set().union(*parts):
            if p in known:
                continue
            raw = p.encode()
            whole = get(raw)
            if whole is not None:
                found[p] = array("I", [whole]).tobytes()
            elif len(raw) > LONG:
                found[p] = array("I", self.merge(raw)).tobytes()
            else:
                queued.append(p)
        found.update(zip(queued, self.merge_many([p.encode() for p in queued])))
        out = [b"".join([known[p] if p in known else found[p] for p in ps]) for ps in parts]
        if len(known) + len(found) > WORDS_KEPT:
            known.clear()
        known.update((p, ids) for p, ids in found.items() if len(p) <= MEMO_CHARS)
        return out


def bpe_encoder(ranks_path: str, pattern: str) -> Memo:
    return kept(("bitmap", ranks_path, pattern), lambda: Memo(spaced_keys, BitmapBPE(ranks_path, pattern).words, WORDS_KEPT))


def _encoding(ranks_path: str, pattern: str):
    def run(batches):
        bpe = bpe_encoder(ranks_path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, 1 << 21):
                ids = bpe.encode(texts[a:b])
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def _decoding(ranks_path: str):
    def table() -> list[bytes]:
        ranks = read_ranks(ranks_path)
        out = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            out[v] = k
        return out

    def run(batches):
        piece = kept(("decode", ranks_path), table).__getitem__
        for batch in batches:
            ids = batch.column(1)
            decoded = [b"".join(map(piece, array("I", x.as_py()))) for x in ids]
            yield pa.record_batch([batch.column(0), ids, pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    return run


def _texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id and ``ids`` (little-endian unsigned 32-bit) of every whole text."""
    return _texts(docs, id_col, text).mapInArrow(_encoding(ranks_path, pattern), "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids and ``decoded``: the bytes that the ids stand for."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoding(ranks_path), "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """encode_documents() and decode_documents() in one pass over a task's batches, hence one worker a task."""
    encode, decode = _encoding(ranks_path, pattern), _decoding(ranks_path)

    def run(batches):
        yield from decode(encode(batches))

    return _texts(docs, id_col, text).mapInArrow(run, "doc_id long, ids binary, decoded binary")
