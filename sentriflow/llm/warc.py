"""WARC archives: writing pages, normalising whole-file gzip streams, and reading records by offset.

Crawls often come as one gzip stream per file, which can only be read from the start. The normaliser inflates such a file once,
in pieces of bounded size, writes each record as a gzip member of its own, and writes a sidecar index with the place
of every record; any record can then be read alone.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_bits, flag_in_bitmap, fresh_dir, key_bitmap, materialize, spread
from .files import Sink, open_read

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A file is closed once its records take so many bytes before compression.
FILE_BYTES = 64 << 20
READ_BYTES = 1 << 20
LEVEL = 6
GZIP = 16 + zlib.MAX_WBITS


def _clean(url: str | None) -> str:
    """A URL that fits on a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(page_id, url: str | None, payload: bytes, sha1_hex: str, refers_to) -> bytes:
    """One WARC record: a response with its payload, or a revisit of the record `refers_to` without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(sha1_hex)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """Names (lower case) and values of a record's header lines, without the version line."""
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a stream of bytes, each with its head, block and end; holds one record and one piece at a time."""
    held, need = bytearray(), None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                if not held.startswith(b"WARC/"):
                    raise ValueError("not a WARC record")
                need = end + 4 + int(parse_head(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError("the last record is cut off")


def inflate(file) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in pieces."""
    state = zlib.decompressobj(GZIP)
    while True:
        raw = file.read(READ_BYTES)
        if not raw:
            break
        while raw:
            out = state.decompress(raw, READ_BYTES)
            if out:
                yield out
            if state.eof:
                raw, state = state.unused_data, zlib.decompressobj(GZIP)
            else:
                raw = state.unconsumed_tail


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(_id, _url, _payload, _sha1, _refers_to): of equal payloads of `min_bytes` or more, all but the largest id refer to it.

    Only payloads that may repeat, by a bitmap of their digests, are shuffled. A null payload is empty, and a null id refers to the largest id of its payload.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary")).alias("_payload"))
    rows = rows.withColumn("_sha1", F.sha1("_payload")).withColumn("_k", F.xxhash64("_sha1"))
    seen = rows.filter(F.octet_length("_payload") >= min_bytes)
    groups = materialize(seen.groupBy("_sha1").agg(F.max("_id").alias("_last"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_sha1", "_last"), "warc-groups")
    bits = bitmap_bits(groups.count())
    marked = flag_in_bitmap(rows, "_k", key_bitmap(groups.select(F.xxhash64("_sha1").alias("_k")), "_k", bits), "_maybe", bits)
    once = marked.filter("NOT _maybe").withColumn("_refers_to", F.lit(None).cast("long"))
    again = marked.filter("_maybe").join(groups.withColumnRenamed("_sha1", "_of"), F.col("_sha1") == F.col("_of"), "left")
    refers = F.when((F.octet_length("_payload") >= min_bytes) & (F.col("_id").isNull() | (F.col("_id") < F.col("_last"))), F.col("_last"))
    cols = ["_id", "_url", "_payload", "_sha1", "_refers_to"]
    return once.select(cols).unionByName(again.withColumn("_refers_to", refers).select(cols))


def write_monolithic(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record per row into archives of one gzip stream each; returns (path, n_records).

    Payloads are the column's UTF-8, null as empty. An empty table writes no file. A null id refers to the largest id with its payload; rows that
    repeat an id with an equal payload are responses alike. Other columns are ignored.
    """
    folder = fresh_dir(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sink, packer, size, n = None, None, 0, 0

        def close() -> pa.RecordBatch:
            sink.write(packer.flush())
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([sink.uri]), pa.array([n], pa.int64())], ["path", "n_records"])

        for batch in batches:
            for i, url, payload, sha1, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if sink is None:
                    sink, packer, size, n = Sink(folder, f"whole-{TaskContext.get().partitionId():05d}", ".warc.gz"), zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), 0, 0
                raw = record(i, url, payload, sha1, refers)
                sink.write(packer.compress(raw))
                size, n = size + len(raw), n + 1
                if size >= FILE_BYTES:
                    yield close()
                    sink = None
        if sink is not None:
            yield close()

    marked = mark_revisits(pages, id_col, url_col, payload_col, min_bytes)
    return materialize(marked.mapInArrow(run, "path string, n_records long"), "warc-list")


def normalise(archives: DataFrame, path_col: str = "path") -> DataFrame:
    """Rewrite each gzip archive with a member per record and a sidecar index; returns (path, index_path, n_records, bytes).

    Reads each file once from start to end, a task for each (up to `MAX_TASKS`). The index has a JSON line per record: offset, length, id, type, uri. A task
    holds one record at a time, however long. A file that isn't gzip, or whose last record is cut off, fails the job. An empty list gives an empty one.
    """
    folder = fresh_dir(archives.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out, index, n = Sink(folder, "records", ".warc.gz"), Sink(folder, "records", ".idx.jsonl"), 0
                with open_read(path) as f:
                    for raw in split_records(inflate(f)):
                        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                        member = packer.compress(raw) + packer.flush()
                        head = parse_head(raw[: raw.find(b"\r\n\r\n")])
                        line = {"offset": out.size, "length": len(member), "id": head.get("warc-record-id"), "type": head.get("warc-type"), "uri": head.get("warc-target-uri")}
                        index.write(json.dumps(line).encode() + b"\n")
                        out.write(member)
                        n += 1
                out.close()
                index.close()
                yield pa.RecordBatch.from_pylist([{"path": out.uri, "index_path": index.uri, "n_records": n, "bytes": out.size}], _NORMALISED)

    return materialize(spread(archives.select(path_col)).mapInArrow(run, "path string, index_path string, n_records long, bytes long"), "warc-list")


_NORMALISED = pa.schema([("path", pa.string()), ("index_path", pa.string()), ("n_records", pa.int64()), ("bytes", pa.int64())])


def read_index(archives: DataFrame) -> DataFrame:
    """One row per record of normalised archives (a written table): path, offset, length, id, type, uri; archives are dealt out one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(*(c.to_pylist() for c in batch.columns)):
                with open_read(index) as f:
                    lines = [json.loads(x) | {"path": path} for x in f.read().splitlines()]
                for a in range(0, len(lines), 5000):
                    yield pa.RecordBatch.from_pylist(lines[a : a + 5000], _INDEX)

    return spread(archives.select("path", "index_path")).mapInArrow(run, "path string, offset long, length long, id string, type string, uri string")


_INDEX = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("id", pa.string()), ("type", pa.string()), ("uri", pa.string())])


def read_records(index: DataFrame) -> DataFrame:
    """The records at the listed places: page_id, url, record_type, refers_to, payload_digest, stated_bytes and payload (null for revisits).

    Each record is one seek and one gzip member. A response whose payload doesn't have the stated digest fails the job.
    A place that repeats gives its record as often. An empty index gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size, path, f = [], 0, None, None
            for at_path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if at_path != path:
                    path, f = at_path, open_read(at_path)
                f.seek(offset)
                rows.append(read_record(zlib.decompress(f.read(length), GZIP)))
                size += len(rows[-1]["payload"] or b"") + 300
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _RECORD)

    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, stated_bytes long, payload binary"
    return index.select("path", "offset", "length").mapInArrow(run, schema)


def read_record(raw: bytes) -> dict:
    end = raw.find(b"\r\n\r\n")
    head = parse_head(raw[:end])
    block = raw[end + 4 : end + 4 + int(head["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    kind = head["warc-type"]
    if kind == "response" and base32_sha1(hashlib.sha1(payload).hexdigest()) != digest:
        raise ValueError(f"payload of {head['warc-record-id']} doesn't have its digest")
    return {
        "page_id": _page_id(head["warc-record-id"]),
        "url": head["warc-target-uri"],
        "record_type": kind,
        "refers_to": _page_id(head["warc-refers-to"]) if "warc-refers-to" in head else None,
        "payload_digest": digest,
        "stated_bytes": stated,
        "payload": payload if kind == "response" else None,
    }


def _page_id(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("stated_bytes", pa.int64()), ("payload", pa.binary())])


def op4_warc(spark, sf_dir: str) -> DataFrame:
    archives = normalise(write_monolithic(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    records = read_records(read_index(archives))
    size = F.coalesce(F.octet_length("payload").cast("long"), F.col("stated_bytes"))
    return records.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
