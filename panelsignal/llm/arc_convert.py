"""Legacy ARC archives to WARC.

:func:`write_arc` lays pages down as gzip ARC files (version 1 or 2, by
partition), :func:`read_arc` parses ARC files by the record definition that
their own version block states and by declared lengths, :func:`arc_to_warc`
synthesises equivalent WARC records and :func:`read_warc` reads them back.

A WARC record's identifier is a UUID of its ARC locator (file, offset), its date
the ARC date, its type ``response`` or, where an earlier copy of the same payload
is kept elsewhere, ``revisit``; payload and block digests are SHA-1.  Of equal
payloads of ``min_bytes`` or more the one with the largest page id is the response.

Files are written by Spark's own text writer (a record is a row; the record's
end is the line separator), so writing is atomic and survives lost executors
and any store works; a file is one gzip stream.  Files are parsed as streams,
record by record.  Which records are revisits is decided on digests alone
(counted with partial aggregation, so that a payload a third of all pages share
is one row a task); decisions go back to the ARC files by file name, one row a
file, so no payload is shuffled by its digest.

Defined results: a null html is an empty payload; a null url is ``about:blank``;
a null page id is smaller than any other; of repeated rows one is the response;
extra columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import hashlib
import io
import re
import urllib.parse
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelsignal.llm.common import written

MIN_BYTES = 1000
BATCH_BYTES = 4 << 20

# Record definitions of the ARC format's versions, and the WARC profile of a revisit.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

_GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": "0"}
_EPOCH = dt.datetime(2001, 1, 1)
_SPAN = 10 * 365 * 24 * 3600
_URL_SAFE = "".join(map(chr, range(33, 127)))


def _batches(rows, schema: pa.Schema, size):
    """Record batches of rows whose sizes add up to about BATCH_BYTES."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= BATCH_BYTES or len(held) >= 10_000:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_VALUE = pa.schema([("value", pa.binary())])


def _write_records(records: DataFrame, path: str, end: str) -> None:
    # a string's bytes are written as they are
    records.select(F.col("value").cast("string").alias("value")).write.options(**_GZIP).option("lineSep", end).text(path)


# --- ARC ---------------------------------------------------------------------


def http_response(page_id: int | None, payload: bytes) -> bytes:
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"X-Page-Id: {'-' if page_id is None else page_id}\r\nContent-Length: {len(payload)}\r\n\r\n"
    )
    return head.encode() + payload


def arc_file_header(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 archive\n{ARC_FIELDS[version]}\n\n".encode()
    host = "filedesc://" + name
    fields = {1: f"{host} 0.0.0.0 {date} text/plain {len(body)}"}
    fields[2] = f"{host} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}"
    return fields[version].encode() + b"\n" + body


def arc_record(url: str, date: str, body: bytes, version: int, name: str, offset: int) -> bytes:
    line = f"{url} 127.0.0.1 {date} text/html"
    if version == 2:
        line += f" 200 {hashlib.md5(body).hexdigest()} - {offset} {name}"
    return f"{line} {len(body)}\n".encode() + body


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html") -> None:
    """One gzip ARC file per partition of ``pages``; even partitions in version 1, odd ones in version 2."""
    base = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.col(url).cast("string"), F.lit("about:blank")).alias("url"),
        F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name, version = f"pages-{part:06d}.arc", 1 + part % 2

        def rows():
            offset = 0
            for batch in batches:
                for page_id, where, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    date = (_EPOCH + dt.timedelta(seconds=(page_id or 0) % _SPAN)).strftime("%Y%m%d%H%M%S")
                    if not offset:
                        first = arc_file_header(name, version, date)
                        yield (first,)
                        offset = len(first) + 1
                    where = urllib.parse.quote(where, safe=_URL_SAFE) or "about:blank"
                    record = arc_record(where, date, http_response(page_id, payload), version, name, offset)
                    yield (record,)
                    offset += len(record) + 1

        yield from _batches(rows(), _VALUE, lambda r: len(r[0]))

    _write_records(base.mapInArrow(run, "value binary"), path, "\n")


def parse_arc(stream):
    """(offset, fields by name, body) of an ARC stream's records, by the definition in its version block."""
    names, offset = None, 0
    while line := stream.readline():
        start, offset = offset, offset + len(line)
        if line == b"\n":
            continue
        values = line.decode().rstrip("\n").split(" ")
        if names is None:
            body = stream.read(int(values[-1]))
            names = body.decode().split("\n")[1].split(" ")
        else:
            body = stream.read(int(values[-1]))
            if len(values) != len(names):
                raise ValueError(f"{len(values)} fields, {len(names)} defined, at offset {start}")
        if len(body) != int(values[-1]):
            raise ValueError(f"record at offset {start} is cut short")
        offset += len(body)
        if not values[0].startswith("filedesc://"):
            yield start, dict(zip(names, values)), body


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """An HTTP message's head (with its empty line) and payload."""
    at = body.find(b"\r\n\r\n")
    return (body[: at + 4], body[at + 4 :]) if at >= 0 else (b"", body)


_PAGE_ID = re.compile(rb"\r\nX-Page-Id: (-?\d+)\r\n").search
_LENGTH = re.compile(rb"\r\nContent-Length: (\d+)\r\n").search


def _page_id(head: bytes) -> int | None:
    m = _PAGE_ID(head)
    return int(m[1]) if m else None


def _open(content) -> io.BufferedReader:
    raw = io.BytesIO(content.as_buffer())
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16)


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.col("path").alias("file"), "content")


_SUMMARY = "file string, offset long, page_id long, url string, date string, n_bytes long, digest binary"
_SUMMARY_ARROW = pa.schema(
    [("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("n_bytes", pa.int64()), ("digest", pa.binary())]
)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """One row per ARC record, without its payload: locator, page id, url, date, payload size and SHA-1."""

    def run(batches):
        def rows():
            for batch in batches:
                for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    for offset, f, body in parse_arc(_open(content)):
                        head, payload = split_http(body)
                        yield (file, offset, _page_id(head), f["URL"], f["Archive-date"], len(payload), hashlib.sha1(payload).digest())

        yield from _batches(rows(), _SUMMARY_ARROW, lambda r: 200)

    return _files(spark, path).mapInArrow(run, _SUMMARY)


# --- WARC --------------------------------------------------------------------


def warc_date(arc_date: str) -> str:
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(file: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{offset}')}>"


def sha1_label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    lines = [f"{k}: {v}\r\n" for k, v in headers.items()] + [f"Content-Length: {len(block)}\r\n\r\n"]
    return b"WARC/1.0\r\n" + "".join(lines).encode() + block


def convert_record(file: str, offset: int, f: dict, body: bytes, kept: dict | None) -> bytes:
    """The WARC record of an ARC record; ``kept``: the response that it repeats, if any."""
    head, payload = split_http(body)
    block = head if kept else body
    headers = {
        "WARC-Type": "revisit" if kept else "response",
        "WARC-Record-ID": record_id(file, offset),
        "WARC-Date": warc_date(f["Archive-date"]),
        "WARC-Target-URI": f["URL"],
        "WARC-IP-Address": f["IP-address"],
        "WARC-Payload-Digest": sha1_label(hashlib.sha1(payload).digest()),
        "WARC-Block-Digest": sha1_label(hashlib.sha1(block).digest()),
        "Content-Type": "application/http; msgtype=response",
    }
    if kept:
        headers |= {
            "WARC-Profile": REVISIT_PROFILE,
            "WARC-Refers-To": record_id(kept["file"], kept["offset"]),
            "WARC-Refers-To-Target-URI": kept["url"],
            "WARC-Refers-To-Date": warc_date(kept["date"]),
        }
    return warc_record(headers, block)


def revisits(records: DataFrame, min_bytes: int) -> DataFrame:
    """(file, offset, kept) of the records that repeat another's payload; ``records``: read_arc()'s rows."""
    records = written(records, "arc-summary")
    same = (
        records.where(F.col("n_bytes") >= min_bytes)
        .groupBy("digest", "n_bytes")
        .agg(F.max(F.struct("page_id", "file", "offset", "url", "date")).alias("kept"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "n_bytes", "kept")
    )
    return (
        records.join(written(same, "arc-kept"), ["digest", "n_bytes"])
        .where("NOT (file = kept.file AND offset = kept.offset)")
        .select("file", "offset", "kept")
    )


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = MIN_BYTES) -> None:
    """Convert the ARC files under ``arc_path``; one gzip WARC file per task."""
    repeats = revisits(read_arc(spark, arc_path), min_bytes)
    # a file's decisions are bounded by its records
    per_file = repeats.groupBy("file").agg(F.collect_list(F.struct("offset", "kept")).alias("repeats"))
    files = _files(spark, arc_path).join(written(per_file, "arc-decisions"), "file", "left")

    def run(batches):
        def rows():
            info = b"software: ARC conversion\r\nformat: WARC File Format 1.0\r\n"
            first = True
            for batch in batches:
                for file, content, repeats in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                    kept = {r["offset"]: r["kept"] for r in repeats or ()}
                    for offset, f, body in parse_arc(_open(content)):
                        if first:
                            yield (
                                warc_record(
                                    {
                                        "WARC-Type": "warcinfo",
                                        "WARC-Record-ID": record_id(file, -1),
                                        "WARC-Date": warc_date(f["Archive-date"]),
                                        "Content-Type": "application/warc-fields",
                                    },
                                    info,
                                ),
                            )
                            first = False
                        yield (convert_record(file, offset, f, body, kept.get(offset)),)

        yield from _batches(rows(), _VALUE, lambda r: len(r[0]))

    _write_records(files.select("file", "content", "repeats").mapInArrow(run, "value binary"), warc_path, "\r\n\r\n")


def parse_warc(stream):
    """(headers, block) of a WARC stream's records, by declared lengths."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            headers[k.strip()] = v.strip()
        size = int(headers["Content-Length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('WARC-Record-ID')} is cut short")
        yield headers, block


_WARC = "record_id string, record_type string, url string, date string, refers_to_id string, page_id long, payload_bytes long, payload_digest string"
_WARC_ARROW = pa.schema(
    [(n, pa.string()) for n in ("record_id", "record_type", "url", "date", "refers_to_id")]
    + [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
)


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row per response or revisit record, with its payload if asked for; digests are checked."""
    schema = _WARC + (", payload binary" if payload else "")
    arrow = _WARC_ARROW.append(pa.field("payload", pa.binary())) if payload else _WARC_ARROW

    def run(batches):
        def rows():
            for batch in batches:
                for content in batch.column(1):
                    for h, block in parse_warc(_open(content)):
                        kind = h["WARC-Type"]
                        if kind not in ("response", "revisit"):
                            continue
                        if sha1_label(hashlib.sha1(block).digest()) != h["WARC-Block-Digest"]:
                            raise ValueError(f"record {h['WARC-Record-ID']}: wrong block digest")
                        head, body = split_http(block)
                        stated = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if kind == "response" and hashlib.sha1(body).hexdigest() != stated:
                            raise ValueError(f"record {h['WARC-Record-ID']}: wrong payload digest")
                        size = len(body) if kind == "response" else int(_LENGTH(head)[1])
                        row = (h["WARC-Record-ID"], kind, h["WARC-Target-URI"], h["WARC-Date"], h.get("WARC-Refers-To"), _page_id(head), size, stated)
                        yield row + ((body if kind == "response" else None),) if payload else row

        yield from _batches(rows(), arrow, lambda r: 200 + (len(r[-1] or b"") if payload else 0))

    return _files(spark, path).mapInArrow(run, schema)


def with_responses(records: DataFrame) -> DataFrame:
    """``records`` (read_warc()) with ``refers_to``: the page id of the response that a revisit names."""
    records = written(records, "warc-records")
    responses = records.where("record_type = 'response'")
    targets = responses.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    named = records.where("record_type = 'revisit'").join(targets, "refers_to_id", "left")
    return responses.withColumn("refers_to", F.lit(None).cast("long")).unionByName(named)
