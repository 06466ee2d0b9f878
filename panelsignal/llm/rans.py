"""Token-id files coded by a static range asymmetric numeral system (rANS).

One frequency table, counted over all documents and scaled to 2**SCALE_BITS,
is shared by every block.  A block holds whole documents (about
``BLOCK_TOKENS`` ids; a longer document makes a longer block); its ids are
dealt over ``LANES`` interleaved coders that share one stream of 32-bit words.
Every ``STEPS`` steps the coders' states and the place in the stream are kept
as a checkpoint, so that the parts of a block are decoded side by side; blocks
need nothing from each other.  CRC-32 sums cover the block's body and its ids.

File: blocks one after another, each ended by a newline:

    b"RANS" | body length u32 | body CRC-32 u32 | body
    body: zlib(documents' index) length u32, index, ids u64, ids' CRC-32 u32,
          checkpoints u32, words u32, place of each checkpoint u32,
          states u64 (checkpoints x LANES), words u32
    index: first id's place in the whole collection i64, documents u64,
           id present u8 each, doc_id i64 each, ids u64 each

and one file with the table.  Documents stand in ascending doc_id order in and
across files (null ids first; equal ids by their tokens).

The ids are written once to the shared folder after tokenising; the table, the
parts' totals and the sorted blocks are made from that copy, and only ids are
shuffled, by ranges of doc_id.

Defined results: null and empty texts hold the end id alone; repeated rows are
kept each for itself; extra columns are ignored; an empty table gives an empty
result (and a table file only).
"""

from __future__ import annotations

import json
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsignal.llm.common import text_or_empty, written
from panelsignal.llm.tokens import bare_encoder, slices

END_ID = 1
SCALE_BITS = 20
LANES = 512
STEPS = 128
BLOCK_TOKENS = LANES * STEPS * 4
TOKENS_PER_PART = 1 << 22
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_MASK = np.uint64(0xFFFFFFFF)


class Table:
    """Frequencies that sum to 2**SCALE_BITS; every id that occurs has one at least."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.int64), freq.astype(np.int64))
        # a coder gives a word away before its state would outgrow 63 bits
        self.limit = self.freq << np.uint64(63 - SCALE_BITS)

    @staticmethod
    def scaled(counts: np.ndarray) -> np.ndarray:
        total, size = int(counts.sum()), 1 << SCALE_BITS
        used = np.flatnonzero(counts)
        if not len(used):
            return counts.astype(np.int64)
        if len(used) > size:
            raise ValueError(f"{len(used)} ids don't fit a table of {size} slots")
        out = np.zeros(len(counts), np.int64)
        out[used] = np.maximum(1, (counts[used].astype(np.float64) * (size / total)).astype(np.int64))
        while (off := size - int(out.sum())) != 0:  # settle the rounding on the most frequent ids
            order = used[np.argsort(-out[used], kind="stable")]
            room = np.ones(len(order), np.int64) if off > 0 else -np.minimum(1, out[order] - 1)
            step = np.sign(off) * np.cumsum(np.abs(room)) <= off if off > 0 else np.cumsum(np.abs(room)) <= -off
            out[order[step]] += room[step]
        return out


def encode_ids(ids: np.ndarray, table: Table) -> bytes:
    """checkpoints u32, words u32, places, states, words."""
    n = len(ids)
    rows = -(-n // LANES)
    most = int(np.argmax(table.freq))
    grid = np.full(rows * LANES, most, np.int64)
    grid[:n] = ids
    freq, start, limit = table.freq, table.cum, table.limit
    x = np.full(LANES, _LOW, np.uint64)
    words, places, states = [], [], []
    given = 0
    scale = np.uint64(SCALE_BITS)
    for t in range(rows - 1, -1, -1):
        s = grid[t * LANES : (t + 1) * LANES]
        f = freq[s]
        out = np.flatnonzero(x >= limit[s])
        if len(out):
            words.append((x[out] & _MASK).astype("<u4"))
            given += len(out)
            x[out] >>= _WORD
        q, r = np.divmod(x, f)
        x = (q << scale) + r + start[s]
        if t % STEPS == 0:
            places.append(given)
            states.append(x.copy())
    words.reverse()
    places = [given - p for p in reversed(places)]
    body = np.concatenate(words) if words else np.array([], "<u4")
    return b"".join(
        [
            struct.pack("<II", len(places), given),
            np.array(places, "<u4").tobytes(),
            np.array(states[::-1], "<u8").tobytes(),
            body.tobytes(),
        ]
    )


def decode_ids(body: bytes, n: int, table: Table) -> np.ndarray:
    """All checkpoints' parts side by side."""
    parts, given = struct.unpack_from("<II", body)
    at = 8
    places = np.frombuffer(body, "<u4", parts, at).astype(np.int64)
    at += 4 * parts
    x = np.frombuffer(body, "<u8", parts * LANES, at).reshape(parts, LANES).copy()
    at += 8 * parts * LANES
    words = np.append(np.frombuffer(body, "<u4", given, at), np.uint32(0)).astype(np.uint64)
    rows = -(-n // LANES)
    out = np.zeros((parts, STEPS, LANES), np.int64)
    scale, slot_mask = np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1)
    for t in range(min(STEPS, rows)):
        live = parts if (parts - 1) * STEPS + t < rows else parts - 1  # the last part may be shorter
        y = x[:live]
        slot = y & slot_mask
        s = table.symbol[slot]
        out[:live, t] = s
        y = table.freq[s] * (y >> scale) + slot - table.cum[s]
        need = y < _LOW
        took = np.cumsum(need, axis=1)
        take = (places[:live, None] + took - 1)[need]
        y[need] = (y[need] << _WORD) | words[take]
        places[:live] += took[:, -1]
        x[:live] = y
    return out.reshape(-1, LANES).ravel()[:n]


def make_block(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, first: int, table: Table) -> bytes:
    present = np.array([d is not None for d in doc_ids], np.uint8)
    index = zlib.compress(
        struct.pack("<qQ", first, len(doc_ids))
        + present.tobytes()
        + np.array([d or 0 for d in doc_ids], "<i8").tobytes()
        + lengths.astype("<u8").tobytes()
    )
    body = (
        struct.pack("<I", len(index))
        + index
        + struct.pack("<QI", len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        + encode_ids(ids, table)
    )
    return b"RANS" + struct.pack("<II", len(body), zlib.crc32(body)) + body


def read_blocks(content: bytes, table: Table):
    """(doc_id, start, ids as bytes) of a file's documents."""
    at = 0
    while at < len(content):
        if content[at : at + 4] != b"RANS":
            raise ValueError(f"no block at byte {at}")
        size, crc = struct.unpack_from("<II", content, at + 4)
        body = content[at + 12 : at + 12 + size]
        if zlib.crc32(body) != crc:
            raise ValueError(f"block at byte {at}: wrong checksum")
        at += 12 + size + 1
        (k,) = struct.unpack_from("<I", body)
        index = zlib.decompress(body[4 : 4 + k])
        n, ids_crc = struct.unpack_from("<QI", body, 4 + k)
        ids = decode_ids(body[16 + k :], n, table).astype("<u4")
        if zlib.crc32(ids.tobytes()) != ids_crc:
            raise ValueError("decoded ids have a wrong checksum")
        first, docs = struct.unpack_from("<qQ", index)
        present = np.frombuffer(index, np.uint8, docs, 16)
        doc_ids = np.frombuffer(index, "<i8", docs, 16 + docs)
        lengths = np.frombuffer(index, "<u8", docs, 16 + 9 * docs).astype(np.int64)
        ends = np.cumsum(lengths)
        for p, d, a, b in zip(present.tolist(), doc_ids.tolist(), (ends - lengths).tolist(), ends.tolist()):
            yield (d if p else None), first + a, ids[a:b].tobytes()


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text: str) -> DataFrame:
    """doc_id, n, ids (little-endian unsigned 16-bit where the vocabulary allows, else 32) of every text; written."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    end = end_id.to_bytes(4, "little")

    def run(batches):
        enc = bare_encoder(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids = [np.frombuffer(x + end, "<u4") for x in enc.encode(texts[a:b])]
                packed = [x.astype("<u2").tobytes() if x.max() < 65536 else x.tobytes() for x in ids]
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), pa.array([len(x) for x in ids], pa.int64()), pa.array(packed, pa.binary())],
                    names=["doc_id", "n", "ids"],
                )

    return written(base.mapInArrow(run, "doc_id long, n long, ids binary"), "rans-ids")


def _unpack(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")


def frequencies(ids: DataFrame) -> np.ndarray:
    """The shared table's frequencies, from counts over all ids (as many rows as the vocabulary has ids, at most)."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = np.bincount(_unpack(x, n))
                if len(c) > len(total):
                    total = np.concatenate((total, np.zeros(len(c) - len(total), np.int64)))
                total[: len(c)] += c
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["symbol", "n"])

    rows = ids.select("n", "ids").mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["symbol"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r["symbol"]] = r["n"]
    return Table.scaled(counts)


def cuts_below(column: str, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at or below the column: looked up in two steps of about their square root."""
    if not cuts:
        return F.lit(0)
    size = math.isqrt(len(cuts)) + 1
    runs = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    table = F.from_json(F.lit(json.dumps(runs)), "array<array<bigint>>")
    heads = F.from_json(F.lit(json.dumps([r[0] for r in runs])), "array<bigint>")
    before = F.size(F.filter(heads, lambda c: c <= F.col(column)))
    inside = F.size(F.filter(F.get(table, before - 1), lambda c: c <= F.col(column)))
    return F.when(before == 0, 0).otherwise((before - 1) * size + inside)


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text"
) -> None:
    """Write the documents' ids under ``path``: blocks/ and table/."""
    ids = tokenised(docs, tokenizer, end_id, id_col, text)
    freq = frequencies(ids)
    spark = docs.sparkSession
    spark.createDataFrame([(freq.tolist(),)], "freq array<long>").coalesce(1).write.parquet(f"{path}/table")

    # ranges of doc_id with about TOKENS_PER_PART ids; their totals give each range its first place
    total = ids.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // TOKENS_PER_PART))
    cuts = ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    cuts = sorted({int(c) for c in cuts})

    parted = ids.withColumn("part", F.when(F.col("doc_id").isNull(), 0).otherwise(cuts_below("doc_id", cuts)).cast("long"))

    sums = {r["part"]: r["n"] for r in parted.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    firsts, at = {}, 0
    for p in sorted(sums):
        firsts[p], at = at, at + sums[p]

    def run(batches):
        table = Table(freq)
        part, place, doc_ids, lengths, chunks, held = None, 0, [], [], [], 0

        def block():
            nonlocal place, doc_ids, lengths, chunks, held
            out = make_block(doc_ids, np.array(lengths, np.int64), np.concatenate(chunks).astype(np.int64), place, table)
            place += held
            doc_ids, lengths, chunks, held = [], [], [], 0
            return pa.record_batch([pa.array([out], pa.binary())], names=["block"])

        for batch in batches:
            for p, d, n, x in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if p != part:
                    if held:
                        yield block()
                    part, place = p, firsts[p]
                doc_ids.append(d)
                lengths.append(n)
                chunks.append(_unpack(x, n))
                held += n
                if held >= BLOCK_TOKENS:
                    yield block()
        if held:
            yield block()

    blocks = (
        parted.select("part", "doc_id", "n", "ids")
        .repartitionByRange(max(1, len(firsts)), "part")
        .sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "ids")
        .mapInArrow(run, "block binary")
    )
    # the text writer puts a string's bytes down as they are: a binary file
    blocks.select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (little-endian unsigned 32-bit) of every document in the files under ``path``."""
    freq = np.array(spark.read.parquet(f"{path}/table").first()["freq"], np.int64)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/blocks")

    def run(batches):
        table = Table(freq)
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for row in read_blocks(content.as_buffer().to_pybytes(), table):
                    rows.append(row)
                    if len(rows) == 4096:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    return files.select("content").mapInArrow(run, "doc_id long, start long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows)
    return pa.record_batch(
        [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "ids"]
    )
