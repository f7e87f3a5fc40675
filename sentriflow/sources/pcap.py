"""Packet captures as event rows, and events as packet captures.

Classic captures (both byte orders, micro- and nanoseconds) and pcapng (sections, interfaces, enhanced, simple and obsolete packet blocks) with Ethernet, raw IP
or Linux cooked frames; IPv4 and IPv6 with TCP, UDP and ICMP; DNS headers and questions on port 53; TLS hellos. Other frames are skipped and counted. Here a file is
one task; `capture_splits` reads files in parts.
"""

from __future__ import annotations

import ipaddress
import struct
import uuid
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexical import DNS_CODES, DNS_TYPES
from ..schemas import EVENT
from ..storage import written

# Fixed values of the format: magic numbers (byte order, fraction of a second), link types, TLS versions.
MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 1e-6), b"\xa1\xb2\xc3\xd4": (">", 1e-6), b"\x4d\x3c\xb2\xa1": ("<", 1e-9), b"\xa1\xb2\x3c\x4d": (">", 1e-9)}
PCAPNG, SECTION_LITTLE = b"\x0a\x0d\x0d\x0a", b"\x4d\x3c\x2b\x1a"
INTERFACE, OBSOLETE, SIMPLE, ENHANCED, TIME_RESOLUTION = 1, 2, 3, 6, 9
ETHERNET, RAW, LINUX_SLL = 1, 101, 113
TLS_VERSIONS = {0x0300: "SSL 3.0", 0x0301: "TLS 1.0", 0x0302: "TLS 1.1", 0x0303: "TLS 1.2", 0x0304: "TLS 1.3"}


def packets(data: bytes, limit: int | None = None) -> Iterator[tuple[float, int, bytes]]:
    """(time, link type, frame) of a capture; a cut-off last packet is left out."""
    found = _blocks(data) if data[:4] == PCAPNG else _classic(data)
    return found if limit is None else islice(found, limit)


def _classic(data: bytes) -> Iterator[tuple[float, int, bytes]]:
    kind = MAGICS.get(bytes(data[:4]))
    if kind is None:
        raise ValueError("not a packet capture")
    order, unit = kind
    link = struct.unpack_from(order + "I", data, 20)[0] & 0xFFFF
    at = 24
    while at + 16 <= len(data):
        sec, frac, size, _ = struct.unpack_from(order + "IIII", data, at)
        at += 16
        if at + size > len(data):
            return
        yield sec + frac * unit, link, data[at : at + size]
        at += size


def _blocks(data: bytes) -> Iterator[tuple[float, int, bytes]]:
    """The packets of a pcapng file. A simple packet block has no time; it gets that of the packet before."""
    at, order, links, time = 0, "<", [], 0.0
    while at + 12 <= len(data):
        kind = data[at : at + 4]
        if kind == PCAPNG:
            order, links = "<" if data[at + 8 : at + 12] == SECTION_LITTLE else ">", []
        size = struct.unpack_from(order + "I", data, at + 4)[0]
        if size < 12 or at + size > len(data):
            return
        number, body = struct.unpack(order + "I", kind)[0], data[at + 8 : at + size - 4]
        if number == INTERFACE:
            links.append((struct.unpack_from(order + "H", body)[0], _resolution(body[8:], order), struct.unpack_from(order + "I", body, 4)[0]))
        elif number in (ENHANCED, OBSOLETE) and len(body) >= 20:
            port, high, low, held = struct.unpack_from(order + ("I" if number == ENHANCED else "Hxx") + "III", body)
            if port < len(links):
                time = (high << 32 | low) * links[port][1]
                yield time, links[port][0], body[20 : 20 + held]
        elif number == SIMPLE and links and len(body) >= 4:
            held = struct.unpack_from(order + "I", body)[0]
            yield time, links[0][0], body[4 : 4 + min(held, links[0][2] or held)]
        at += size


def _resolution(options: bytes, order: str) -> float:
    """Seconds of a time unit, from an interface's options; microseconds unless it says otherwise."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == 0:
            break
        if code == TIME_RESOLUTION and size == 1:
            value = options[at + 4]
            return 2.0 ** -(value & 127) if value & 128 else 10.0**-value
        at += 4 + (size + 3) // 4 * 4
    return 1e-6


def count_packets(data: bytes, most: int = 10_000) -> dict:
    """Format and number of packets up to `most`, by the record headers alone."""
    if data[:4] == PCAPNG:
        return {"format": "pcapng", "packets": sum(1 for _ in packets(data, most))}
    if bytes(data[:4]) not in MAGICS:
        return {"format": "unknown", "packets": None}
    order, at, n = MAGICS[bytes(data[:4])][0], 24, 0
    while at + 16 <= len(data) and n < most:
        at += 16 + struct.unpack_from(order + "I", data, at + 8)[0]
        n += 1
    return {"format": "pcap", "packets": n}


def decode(time: float, link: int, frame: bytes) -> dict | None:
    """The event of a frame; None for frames without IP."""
    if link == ETHERNET:
        kind, at = int.from_bytes(frame[12:14], "big"), 14
        while kind in (0x8100, 0x88A8):
            kind, at = int.from_bytes(frame[at + 2 : at + 4], "big"), at + 4
    elif link == LINUX_SLL:
        kind, at = int.from_bytes(frame[14:16], "big"), 16
    else:
        kind, at = (0x0800 if frame[:1] and frame[0] >> 4 == 4 else 0x86DD), 0
    ip = frame[at:]
    if kind == 0x0800 and len(ip) >= 20:
        size, total = (ip[0] & 15) * 4, int.from_bytes(ip[2:4], "big")
        proto, ttl, src, dst = ip[9], ip[8], ipaddress.IPv4Address(ip[12:16]), ipaddress.IPv4Address(ip[16:20])
        body, version = ip[size : total or None], 4
    elif kind == 0x86DD and len(ip) >= 40:
        proto, ttl, src, dst = ip[6], ip[7], ipaddress.IPv6Address(ip[8:24]), ipaddress.IPv6Address(ip[24:40])
        body, version = ip[40 : 40 + int.from_bytes(ip[4:6], "big")], 6
        while proto in (0, 43, 60) and len(body) >= 8:
            proto, body = body[0], body[8 + body[1] * 8 :]
    else:
        return None
    row = dict.fromkeys(_COLUMNS) | {"timestamp": time, "source_ip": str(src), "destination_ip": str(dst), "ip_version": version, "ip_ttl": ttl, "protocol": proto, "packet_length": len(frame), "payload_length": 0, "ingestion_source": "pcap", "is_aggregated": False}
    payload = b""
    if proto == 6 and len(body) >= 20:
        row["source_port"], row["destination_port"], row["tcp_sequence"], row["tcp_ack"] = struct.unpack_from(">HHII", body)
        row["tcp_flags"], row["tcp_window"] = body[13], int.from_bytes(body[14:16], "big")
        payload = body[(body[12] >> 4) * 4 :]
        row["tls"] = tls_hello(payload)
    elif proto == 17 and len(body) >= 8:
        row["source_port"], row["destination_port"] = struct.unpack_from(">HH", body)
        payload = body[8:]
    if proto in (6, 17):
        row["payload_length"] = len(payload)
        if 53 in (row["source_port"], row["destination_port"]):
            row["dns"] = dns_header(payload[2:] if proto == 6 else payload)
    return row


def dns_header(data: bytes) -> dict | None:
    if len(data) < 12:
        return None
    ident, flags, questions, answers = struct.unpack_from(">HHHH", data)
    name, at = [], 12
    while questions and at < len(data) and data[at] and data[at] < 64:
        name.append(data[at + 1 : at + 1 + data[at]].decode("latin-1"))
        at += 1 + data[at]
    kind = int.from_bytes(data[at + 1 : at + 3], "big") if questions else None
    return {
        "query_name": ".".join(name) if name else None, "query_type": None if kind is None else DNS_TYPES.get(kind, str(kind)), "query_class": None,
        "response_code": DNS_CODES.get(flags & 15, str(flags & 15)), "answer_count": answers, "is_query": not flags & 0x8000, "transaction_id": ident, "ttl": None,
    }


def tls_hello(data: bytes) -> dict | None:
    """Version and server name of a client or server hello."""
    if len(data) < 11 or data[0] != 22 or data[5] not in (1, 2):
        return None
    version, sni = int.from_bytes(data[9:11], "big"), None
    if data[5] == 1:
        try:
            at = 43
            at += 1 + data[at]
            at += 2 + int.from_bytes(data[at : at + 2], "big")
            at += 1 + data[at]
            end = at + 2 + int.from_bytes(data[at : at + 2], "big")
            at += 2
            while at + 4 <= min(end, len(data)):
                kind, size = struct.unpack_from(">HH", data, at)
                if kind == 0 and size >= 5:
                    n = int.from_bytes(data[at + 7 : at + 9], "big")
                    sni = data[at + 9 : at + 9 + n].decode("latin-1")
                at += 4 + size
        except IndexError:
            pass
    return dict.fromkeys(_TLS) | {"version": TLS_VERSIONS.get(version, hex(version)), "sni": sni}


_TLS = ("version", "sni", "cipher_suite", "ja3_fingerprint", "ja3s_fingerprint", "cert_subject", "cert_issuer", "cert_not_before", "cert_not_after", "is_self_signed", "resumed")
_COLUMNS = (
    "timestamp", "correlation_id", "source_ip", "destination_ip", "ip_version", "ip_ttl", "source_port", "destination_port", "protocol", "packet_length", "payload_length", "tcp_flags",
    "tcp_sequence", "tcp_ack", "tcp_window", "dns", "tls", "ingestion_source", "interface", "zeek_uid", "is_aggregated", "aggregated_duration", "aggregated_packet_count", "aggregated_byte_count",
)


def decode_captures(df: DataFrame, content: str = "content", limit: int | None = None, batch: int = 20_000) -> DataFrame:
    """Event rows of a column of captures, at most `limit` packets of each. Frames that can't be decoded are left out; see `count_frames`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for data in pdf["c"]:
                rows: list[dict] = []
                for p in packets(bytes(data), limit):
                    try:
                        row = decode(*p)
                    except (IndexError, struct.error, ValueError):
                        row = None
                    if row is not None:
                        rows.append(row)
                    if len(rows) >= batch:
                        yield _table(rows)
                        rows = []
                if rows:
                    yield _table(rows)

    return df.select(F.col(content).alias("c")).filter("c IS NOT NULL").mapInPandas(run, EVENT)


def _table(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object) for c in _COLUMNS})


def read_pcap(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    return decode_captures(spark.read.format("binaryFile").load(path), "content", limit)


def count_frames(df: DataFrame, content: str = "content") -> DataFrame:
    """Per capture: packets, events, skipped (without IP) and errors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for data in pdf["c"]:
                seen = {"packets": 0, "events": 0, "skipped": 0, "errors": 0}
                for p in packets(bytes(data)):
                    seen["packets"] += 1
                    try:
                        seen["skipped" if decode(*p) is None else "events"] += 1
                    except (IndexError, struct.error, ValueError):
                        seen["errors"] += 1
                yield pd.DataFrame([seen])

    return df.select(F.col(content).alias("c")).mapInPandas(run, "packets long, events long, skipped long, errors long")


def inspect(df: DataFrame, content: str = "content", most: int = 10_000) -> DataFrame:
    """Format and number of packets of captures, without decoding them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([count_packets(bytes(d), most) for d in pdf["c"]]).astype({"packets": "Int64"})

    return df.select(F.col(content).alias("c")).mapInPandas(run, "format string, packets long")


def frame(src: str, dst: str, sport: int, dport: int, proto: int, payload: bytes, flags: int = 0) -> bytes:
    """An Ethernet frame with an IPv4 TCP or UDP packet; checksums are 0."""
    body = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 8192, 0, 0) if proto == 6 else struct.pack(">HHHH", sport, dport, 8 + len(payload), 0)
    body += payload
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0, ipaddress.IPv4Address(src).packed, ipaddress.IPv4Address(dst).packed)
    return b"\0" * 12 + b"\x08\x00" + ip + body


def record(us: int, f: bytes) -> bytes:
    return struct.pack("<IIII", us // 1_000_000, us % 1_000_000, len(f), len(f)) + f


def capture(frames: list[tuple[int, bytes]]) -> bytes:
    """A capture of (microseconds, frame)."""
    return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, ETHERNET) + b"".join(record(*f) for f in frames)


def to_captures(events: DataFrame, by: str, most: int = 1 << 20) -> DataFrame:
    """Captures per value of `by`, of rows with us, source_ip, destination_ip, source_port, destination_port, protocol, tcp_flags and payload, in time order. A cell holds a whole capture; see `write_captures`.

    A capture ends with the record that takes it to `most` bytes, and the value's next record begins another one, so no task holds more than one capture.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, size = None, [], 0
        for pdf in frames:
            for value, f in zip(pdf[by], _frames(pdf)):
                same = value == key or (pd.isna(value) and pd.isna(key))
                if held and (size >= most or not same):
                    yield pd.DataFrame({by: [key], "content": [capture(held)]})
                    held, size = [], 0
                key = value
                held.append(f)
                size += 16 + len(f[1])
        if held:
            yield pd.DataFrame({by: [key], "content": [capture(held)]})

    names = ["us", "source_ip", "destination_ip", "source_port", "destination_port", "protocol", "tcp_flags", "payload"]
    rows = events.select(*dict.fromkeys([by, *names])).repartition(by).sortWithinPartitions(by, "us")
    return rows.mapInPandas(run, f"{by} {dict(events.dtypes)[by]}, content binary")


def _frames(pdf: pd.DataFrame) -> Iterator[tuple[int, bytes]]:
    for r in pdf.itertuples():
        yield int(r.us), frame(r.source_ip, r.destination_ip, int(r.source_port), int(r.destination_port), int(r.protocol), bytes(r.payload), int(r.tcp_flags))


def write_captures(events: DataFrame, folder: str, files: int) -> DataFrame:
    """The rows of `to_captures` as `files` capture files at most, each of a range of times, in time order, written record by record; returns (path, packets) of the files that count.

    A file has a name of its own per attempt, so what a lost task left isn't among them.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path, out, n = *pafs.FileSystem.from_uri(f"{folder}/{uuid.uuid4().hex}.pcap"), None, 0
        for pdf in frames:
            if out is None:
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = fs.open_output_stream(path)
                out.write(capture([]))
            out.write(b"".join(map(record, *zip(*_frames(pdf)))))
            n += len(pdf)
        if out is not None:
            out.close()
            yield pd.DataFrame([(f"{folder}/{path.rsplit('/', 1)[1]}", n)], columns=["path", "packets"])

    names = ["us", "source_ip", "destination_ip", "source_port", "destination_port", "protocol", "tcp_flags", "payload"]
    return written(events.select(*names).repartitionByRange(files, "us").sortWithinPartitions("us").mapInPandas(run, "path string, packets long"), "captures")
