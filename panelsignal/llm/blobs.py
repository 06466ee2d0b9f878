"""Compact shuffles of hashed items, and fixed-size bit tables built from them.

A 64-bit hash is cut into a shard (its top bits) and the rest.  A map task
sends, per shard, one blob with its distinct hashes (sorted, as differences)
and their counts, so that an item costs a few bytes and a frequent one costs
no more than one entry per task.  A shard's items meet in one task.
"""

from __future__ import annotations

import numpy as np
import xxhash
import zstandard


def pack_counts(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct uint64 hashes and their counts as a compressed blob."""
    first = np.diff(hashes, prepend=np.uint64(0)).astype("<u8")
    # byte planes: the upper bytes of differences are mostly zero and vanish
    planes = first.view(np.uint8).reshape(-1, 8).T
    small = np.minimum(counts, 255).astype(np.uint8)
    large = counts[small == 255].astype("<u8")
    body = len(hashes).to_bytes(8, "little") + planes.tobytes() + small.tobytes() + large.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpack_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(body[:8], "little")
    planes = np.frombuffer(body, np.uint8, 8 * n, 8).reshape(8, n)
    hashes = np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)
    counts = np.frombuffer(body, np.uint8, n, 8 + 8 * n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(body, "<u8", offset=8 + 9 * n).astype(np.int64)
    return hashes, counts


def sum_counts(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes over several blobs with the sums of their counts."""
    parts = [unpack_counts(b) for b in blobs]
    hashes, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.array([], np.int64)
    return hashes[first], np.add.reduceat(counts, first) if len(first) else counts


def shards_of(hashes: np.ndarray, counts: np.ndarray, shard_bits: int):
    """(shard, blob) for sorted distinct hashes."""
    shard = (hashes >> np.uint64(64 - shard_bits)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else []
    for a, b in zip(cuts, [*cuts[1:], len(shard)]):
        yield int(shard[a]), pack_counts(hashes[a:b], counts[a:b])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wrapping multiplications and shifts): spreads every input bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes:
    """64-bit hashes of words, with a bounded memo."""

    LIMIT = 200_000

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        if len(memo) > self.LIMIT:
            memo.clear()
        for w in set(words):
            if w not in memo:
                memo[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


class BitShards:
    """A bit table in equal shards: one shard is one array of 64-bit words; the
    shard of a hash is its top bits, so a shard is filled by one task."""

    def __init__(self, shard_bits: int, words: np.ndarray):
        self.shard_bits, self.words = shard_bits, words  # words: (shards, words per shard)
        self.bits = np.uint64(words.shape[1] * 64)

    @staticmethod
    def places(hashes: np.ndarray, salt: int, bits) -> np.ndarray:
        step = np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & 0xFFFFFFFFFFFFFFFF)
        return mix(hashes + step) % np.uint64(bits)

    @staticmethod
    def fill(bits: int, places: np.ndarray) -> np.ndarray:
        out = np.zeros(bits, bool)
        out[places] = True
        return np.packbits(out, bitorder="little").view("<u8")

    def has(self, hashes: np.ndarray, salt) -> np.ndarray:
        at = self.places(hashes, salt, self.bits)
        shard = (hashes >> np.uint64(64 - self.shard_bits)).astype(np.int64)
        word = self.words[shard, (at >> np.uint64(6)).astype(np.int64)]
        return (word >> (at & np.uint64(63))) & np.uint64(1) == 1
