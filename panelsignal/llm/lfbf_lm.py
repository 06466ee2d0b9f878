"""Bigram scoring from a log-frequency Bloom filter.

Bigram counts of the training texts are quantised to powers of two; the filter
holds a bigram once per level up to its own.  A count is read by probing level
after level until one is missing.  The probability of a word after another is

    P(w | h) = (q(h, w) + MU * P0(w)) / (c(h) + MU),    P0(w) = (c(w) + 1) / (N + V + 1)

with q the lower bound of the level found (never over c(h)), c the exact word
counts, N and V the number of training tokens and of distinct ones.

The filter is cut into slices by the top bits of a bigram's hash.  A slice has
``BITS_PER_ENTRY`` bits for each (bigram, level) it holds, whatever the size of the
corpus, so its rate of false positives does not grow.  Slices, not the filter,
are bounded (about ``max_filter_bytes`` each): a larger corpus has more of them.  No
process holds more than the slice it works on; nothing is broadcast or collected.
Bigrams are told apart by at least 40 bits of hash, and by ten more than the
number of training tokens has.  (Words never seen in training are not looked up
and cannot be false positives.)

Flow, all in blobs of about ``CHUNK_CHARS`` characters of text:

1. texts become chunks of word numbers with the chunk's own word list (written);
2. word lists meet by shards of the words' hash: exact counts go back to each
   chunk.  A chunk sends a word once, so a frequent word is one entry a chunk;
3. bigram hashes meet by slices, packed as sorted differences; each slice fills its
   part of the filter, reads it and sends the level of each hash back to its chunk;
4. each chunk meets its counts and levels and scores its documents.

Defined results: null and empty texts are one end token; a null id counts as
training; repeated rows are scored each for itself; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelsignal.llm.blobs import BitShards, mix, shards_of, sum_counts, unpack_counts
from panelsignal.llm.common import text_or_empty, written

MU = 500.0
PROBES = 3
BITS_PER_ENTRY = 16
#: Of one slice of the filter.
MAX_FILTER_BYTES = 8 << 20
MAX_LEVELS = 48
CHUNK_CHARS = 5 << 20
#: Least bits of a bigram's hash, and bits it has over those of the number of training tokens.
HASH_BITS, SPARE_BITS = 40, 10

_LOWER = bytes(range(256)).lower()
#: Numbers 0 and 1 of every chunk's word list; blanks cannot stand in a word.
START, END = b" start", b" end"


def _chunk(doc_ids, held, texts: list[str]) -> dict:
    """A chunk's blob: documents, their lengths in tokens, word numbers, word list."""
    number: dict[bytes, int] = {START: 0, END: 1}
    lengths, tokens = [], []
    for t in texts:
        words = t.encode().translate(_LOWER).split()
        lengths.append(len(words) + 1)
        tokens += [number.setdefault(w, len(number)) for w in words]
        tokens.append(1)
    z = zstandard.ZstdCompressor(level=3).compress
    # byte planes: the upper bytes of word numbers are nearly all alike
    planes = np.ascontiguousarray(np.array(tokens, "<u4").view(np.uint8).reshape(-1, 4).T)
    return {
        "doc_ids": pa.array(doc_ids, pa.int64()),
        "held": pa.array(held, pa.bool_()),
        "lengths": pa.array(lengths, pa.int64()),
        "tokens": z(planes.tobytes()),
        "words": z(b"\n".join(number)),
    }


_CHUNK_SCHEMA = "chunk long, doc_ids array<long>, held array<boolean>, lengths array<long>, tokens binary, words binary"
_CHUNK_ARROW = pa.schema(
    [
        ("chunk", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("held", pa.list_(pa.bool_())),
        ("lengths", pa.list_(pa.int64())),
        ("tokens", pa.binary()),
        ("words", pa.binary()),
    ]
)


def _unz(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


def chunks(docs: DataFrame, held_out, id_col: str, text: str) -> DataFrame:
    """Written chunks; a chunk's number is fixed once written."""
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held"),
        text_or_empty(text).alias("text"),
    )

    def run(batches):
        from pyspark import TaskContext

        from panelsignal.llm.tokens import slices

        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in slices(texts, CHUNK_CHARS):
                c = _chunk(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), texts[a:b])
                yield pa.record_batch(
                    [pa.array([n]), *(pa.array([c[k].to_pylist() if hasattr(c[k], "to_pylist") else c[k]], _CHUNK_ARROW.field(k).type) for k in c)],
                    schema=_CHUNK_ARROW,
                )
                n += 1

    return written(base.mapInArrow(run, _CHUNK_SCHEMA), "lm-chunks")


class Chunk:
    """A chunk read back."""

    def __init__(self, row: dict):
        self.doc_ids, self.held = row["doc_ids"], np.array(row["held"], bool)
        self.lengths = np.array(row["lengths"], np.int64)
        planes = np.frombuffer(_unz(row["tokens"]), np.uint8).reshape(4, -1)
        self.tokens = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
        self.words = _unz(row["words"]).split(b"\n")
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))

    def before(self) -> np.ndarray:
        """The word number before each token."""
        out = np.empty_like(self.tokens)
        out[1:] = self.tokens[:-1]
        out[self.starts] = 0
        return out

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))


def hash_bits(n: int) -> int:
    """Bits that tell apart the bigrams of ``n`` tokens; each byte less is one less in the shuffle."""
    return min(64, max(HASH_BITS, n.bit_length() + SPARE_BITS))


def bigram_hash(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    drop = np.uint64(64 - bits)
    return mix(left * np.uint64(0x9DDFEA08EB382D69) + right) >> drop << drop


def word_counts(chunked: DataFrame, shard_bits: int) -> DataFrame:
    """(chunk, numbers, counts) back to each chunk, a row per shard; chunk -1: one
    row per shard with [tokens, distinct words] of its training tokens as counts."""

    def send(batches):
        z = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row)
                train = np.repeat(~c.held, c.lengths)
                counts = np.bincount(c.tokens[train], minlength=len(c.words))
                counts[0] = int((~c.held).sum())  # the start: one a training document
                shard = (c.hashes() >> np.uint64(64 - shard_bits)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.diff(shard[order], prepend=-1)).tolist()
                rows = []
                for a, b in zip(cuts, [*cuts[1:], len(order)]):
                    at = order[a:b]
                    words = z(b"\n".join([c.words[i] for i in at.tolist()]))
                    rows.append((int(shard[at[0]]), row["chunk"], words, at.astype("<u4").tobytes(), counts[at].astype("<i8").tobytes()))
                yield pa.record_batch(
                    [pa.array(col, t) for col, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                    names=["shard", "chunk", "words", "numbers", "counts"],
                )

    def meet(group: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        lists = []
        for words, counts in zip(group.column("words").to_pylist(), group.column("counts").to_pylist()):
            words = _unz(words).split(b"\n")
            lists.append(words)
            for w, n in zip(words, np.frombuffer(counts, "<i8").tolist()):
                if n:
                    total[w] = total.get(w, 0) + n
        back = [np.array([total.get(w, 0) for w in words], "<i8").tobytes() for words in lists]
        seen = [n for w, n in total.items() if w != START]
        back.append(np.array([sum(seen), len(seen)], "<i8").tobytes())
        return pa.table(
            {
                "chunk": pa.array([*group.column("chunk").to_pylist(), -1], pa.int64()),
                "numbers": pa.array([*group.column("numbers").to_pylist(), b""], pa.binary()),
                "counts": pa.array(back, pa.binary()),
            }
        )

    sent = chunked.mapInArrow(send, "shard long, chunk long, words binary, numbers binary, counts binary")
    return written(sent.groupBy("shard").applyInArrow(meet, "chunk long, numbers binary, counts binary"), "lm-counts")


def levels(counts: np.ndarray) -> np.ndarray:
    """The quantised count: 1 + floor(log2)."""
    return np.minimum(np.frexp(counts.astype(np.float64))[1], MAX_LEVELS).astype(np.int64)


def fill(hashes: np.ndarray, level: np.ndarray) -> np.ndarray:
    """A slice of the filter that holds each hash once per level up to its own."""
    size, places = max(64, -(-BITS_PER_ENTRY * int(level.sum()) // 64) * 64), [np.array([], np.uint64)]
    for j in range(1, int(level.max(initial=0)) + 1):
        hashes, level = hashes[level >= j], level[level >= j]
        places += [BitShards.places(hashes, j * PROBES + p, size) for p in range(PROBES)]
    return BitShards.fill(size, np.concatenate(places))


def probe(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The level that a slice has for each hash; 0: none."""
    found = np.zeros(len(hashes), np.uint8)
    at = np.arange(len(hashes))
    for j in range(1, MAX_LEVELS + 1):
        for p in range(PROBES):
            place = BitShards.places(hashes[at], j * PROBES + p, len(words) * 64)
            at = at[(words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
        if not len(at):
            break
        found[at] = j
    return found


def bigram_levels(chunked: DataFrame, slice_bits: int, bits: int) -> DataFrame:
    """(chunk, slice, levels): the levels of a chunk's distinct bigram hashes, in the hashes' order."""

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row)
                h = c.hashes()
                hashes, at = np.unique(bigram_hash(h[c.before()], h[c.tokens], bits), return_inverse=True)
                # held-out texts' bigrams are asked for, but not counted
                counts = np.bincount(at[np.repeat(~c.held, c.lengths)], minlength=len(hashes))
                rows = list(shards_of(hashes, counts, slice_bits))
                if rows:
                    yield pa.record_batch(
                        [
                            pa.array([r[0] for r in rows], pa.int64()),
                            pa.array([row["chunk"]] * len(rows), pa.int64()),
                            pa.array([r[1] for r in rows], pa.binary()),
                        ],
                        names=["slice", "chunk", "blob"],
                    )

    def meet(group: pa.Table) -> pa.Table:
        blobs = group.column("blob").to_pylist()
        hashes, counts = sum_counts(blobs)
        found = probe(fill(hashes, levels(counts)), hashes)
        z = zstandard.ZstdCompressor(level=3).compress
        back = [z(found[np.searchsorted(hashes, unpack_counts(b)[0])].tobytes()) for b in blobs]
        return pa.table({"chunk": group.column("chunk"), "slice": group.column("slice"), "levels": pa.array(back, pa.binary())})

    sent = chunked.mapInArrow(send, "slice long, chunk long, blob binary")
    return sent.groupBy("slice").applyInArrow(meet, "chunk long, slice long, levels binary")


def score_chunk(c: Chunk, count: np.ndarray, n: int, v: int, level: np.ndarray, mu: float) -> dict:
    """Per document of a chunk; ``count``: the exact training count of each word number;
    ``level``: that of each distinct bigram hash, in the hashes' order."""
    left, right = c.before(), c.tokens
    p0 = (count[right] + 1.0) / (n + v + 1.0)
    h = c.hashes()
    pairs, at = np.unique(left * len(c.words) + right, return_inverse=True)
    pl, pr = np.divmod(pairs, len(c.words))
    level = level[np.unique(bigram_hash(h[pl], h[pr], hash_bits(n)), return_inverse=True)[1]]
    # the quantised count's lower bound: 0, 1, 2, 4, ...
    q = np.where((level > 0) & (count[pl] > 0) & (count[pr] > 0), np.exp2(level - 1.0), 0.0)
    q = np.minimum(q, np.minimum(count[pl], count[pr]))
    p = (q[at] + mu * p0) / (count[left] + mu)
    total = lambda x: np.add.reduceat(x, c.starts)
    return {
        "doc_id": pa.array(c.doc_ids, pa.int64()),
        "held_out": pa.array(c.held),
        "n_tokens": pa.array(c.lengths),
        "n_known": pa.array(total((count[right] > 0).astype(np.int64))),
        "train_tokens": pa.array(np.full(len(c.lengths), n, np.int64)),
        "base_score": pa.array(total(np.log10(p0))),
        "score": pa.array(total(np.log10(p))),
    }


def score_documents(
    docs: DataFrame,
    held_out,
    id_col: str = "doc_id",
    text: str = "text",
    mu: float = MU,
    max_filter_bytes: int = MAX_FILTER_BYTES,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; ``held_out``: a Boolean column."""
    chunked = chunks(docs, held_out, id_col, text)
    # shards grow with the chunks, so that a shard's task holds about as much as a chunk
    shard_bits = max(4, min(14, chunked.select("chunk").count().bit_length()))
    counts = word_counts(chunked, shard_bits)
    n = v = 0
    for r in counts.where("chunk = -1").select("counts").toLocalIterator():
        n, v = np.array([n, v]) + np.frombuffer(r["counts"], "<i8")
    n, v = int(n), int(v)
    # entries are no more than tokens
    slice_bits = max(shard_bits, (BITS_PER_ENTRY * n // (8 * max_filter_bytes)).bit_length())
    found = bigram_levels(chunked, slice_bits, hash_bits(n))

    def score(group: pa.Table, back: pa.Table) -> pa.Table:
        c = Chunk(group.to_pylist()[0])
        count = np.zeros(len(c.words), np.int64)
        level = []
        for k, numbers, values in zip(*(back.column(x).to_pylist() for x in ("slice", "numbers", "counts"))):
            if k is None:
                count[np.frombuffer(numbers, "<u4")] = np.frombuffer(values, "<i8")
            else:
                level.append((k, _unz(values)))
        level = np.frombuffer(b"".join(x for _, x in sorted(level)), np.uint8)
        return pa.table(score_chunk(c, count, n, v, level, mu))

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    none = F.lit(None)
    back = counts.where("chunk >= 0").select("chunk", none.cast("long").alias("slice"), "numbers", "counts")
    back = back.union(found.select("chunk", "slice", none.cast("binary"), "levels"))
    return chunked.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(score, schema)
