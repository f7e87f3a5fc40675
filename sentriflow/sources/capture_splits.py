"""Captures read in parts: a data source whose tasks each take a range of bytes of a file.

A range is cut where records begin. A capture has no marks, so a border is found by its looks: a place from which a chain of `CHAIN` record headers follow each other (lengths that
fit, fractions below a second, times close together), or one that ends with the file; in pcapng, a packet block with a time whose length stands at both ends, and so do those of the blocks after it. A payload may
hold a capture itself, whose chain runs into that of the records around it at the end of its frame. So the search begins `LOOK_BACK` bytes before the range, longer than a frame, and
follows the chain to the range's first record. A task looks for the border at both ends of its range, so neighbours agree, and it fails if its own records don't lead from one to the other. Each part is
a small capture of its own: the head of the file (header, or section and interfaces) and its records.

    spark.dataSource.register(CaptureSource)
    parts = spark.read.format("capture_parts").option("split", 64 << 20).load("/captures")
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import pcap

SPLIT = 64 << 20
#: Headers in a row that make a border, bytes that are searched at a time, seconds between two records at most.
CHAIN, WINDOW, APART = 16, 1 << 20, 30 * 86_400
LOOK_BACK, _LARGEST = 1 << 19, 1 << 26


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int
    size: int


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file://{path.removeprefix('file:')}")


class CaptureSource(DataSource):
    """Options: path (a file or a folder; also of load()), split (bytes a part; 0 keeps files whole), lookback (bytes before a range)."""

    @classmethod
    def name(cls) -> str:
        return "capture_parts"

    def schema(self) -> str:
        return "path string, start long, content binary"

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options["path"], int(self.options.get("split", SPLIT)), int(self.options.get("lookback", LOOK_BACK)))


class CaptureReader(DataSourceReader):
    def __init__(self, path: str, split: int, look_back: int):
        self.path, self.split, self.look_back = path, split, look_back

    def partitions(self) -> list[Part]:
        fs, path = _file_system(self.path)
        info = fs.get_file_info(path)
        files = [info] if info.type == pafs.FileType.File else [f for f in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if f.type == pafs.FileType.File and f.base_name[:1] not in "._"]
        prefix = self.path[: self.path.index("://") + 3] if "://" in self.path else "file://"
        return [Part(prefix + f.path, a, min(a + (self.split or f.size), f.size), f.size) for f in files for a in range(0, f.size, self.split or max(f.size, 1))]

    def read(self, partition: Part) -> Iterator[tuple[str, int, bytes]]:
        fs, path = _file_system(partition.path)
        with fs.open_input_file(path) as f:
            whole = partition.start == 0 and partition.end == partition.size
            if whole:
                yield partition.path, 0, f.read()
                return
            kind = (_Blocks if f.read_at(4, 0) == pcap.PCAPNG else _Classic)(f, partition.size)
            start, end = (kind.border(at, self.look_back) for at in (partition.start, partition.end))
            if start < end:
                records = f.read_at(end - start, start)
                kind.check(records, partition, end)
                yield partition.path, start, kind.head + records


class _Records:
    """Records of an open capture of a given size; `first` is the place of the first packet."""

    f, size, first = None, 0, 0

    def border(self, at: int, look_back: int) -> int:
        """The first packet at or after a place; the end of the file if there is none."""
        if at >= self.size:
            return self.size
        low = at - look_back
        now = self.first if low <= self.first else self._found(low)
        data, shift = b"", 0
        while now < self.size and (now < at or not self.is_packet(now)):
            if now + 16 > shift + len(data):
                data, shift = self.f.read_at(WINDOW, now), now
            step = self.step(data, now - shift)
            if step <= 0:
                return self.size
            now += step
        return min(now, self.size)

    def _found(self, at: int) -> int:
        """The first place from `at` on where a chain of records begins."""
        while at < self.size:
            data = self.f.read_at(WINDOW + 16, at)
            for o in self.plausible(data, at):
                if o < WINDOW and self._chain(at + int(o)):
                    return at + int(o)
            at += WINDOW
        return self.size

    def _chain(self, at: int) -> bool:
        before = None
        for n in range(CHAIN):
            if at == self.size:
                return n > 0
            held, before = self.follows(at, before)
            if not held:
                return False
            at += held
            if at > self.size:
                return n > 2  # a cut-off last record
        return True

    def check(self, records: bytes, part: Part, end: int) -> None:
        at = 0
        while at + 8 <= len(records):
            step = self.step(records, at)
            if step <= 0:
                break
            self.inner(records, at, part)
            at += step
        if at != len(records) and end < part.size:  # the last record of a file may be cut off
            raise ValueError(f"{part.path}: records from {part.start} don't lead to a border at {part.end}; read it with split 0")

    def inner(self, records: bytes, at: int, part: Part) -> None:
        pass


class _Classic(_Records):
    """Classic captures: a header of 16 bytes per record."""

    def __init__(self, f, size: int):
        self.f, self.size, self.first = f, size, 24
        self.head = f.read_at(24, 0)
        if self.head[:4] not in pcap.MAGICS:
            raise ValueError("not a packet capture")
        self.order, unit = pcap.MAGICS[self.head[:4]]
        self.fractions = round(1 / unit)
        self.largest = min(_LARGEST, max(1 << 18, struct.unpack_from(self.order + "I", self.head, 16)[0]))

    def is_packet(self, at: int) -> bool:
        return True

    def step(self, data: bytes, at: int) -> int:
        return 16 + struct.unpack_from(self.order + "I", data, at + 8)[0] if at + 16 <= len(data) else 0

    def plausible(self, data: bytes, at: int) -> np.ndarray:
        if len(data) < 16:
            return np.zeros(0, np.int64)
        word = np.ndarray((len(data) - 3,), np.dtype(self.order + "u4"), data, strides=(1,))
        n = len(data) - 15
        fraction, held, whole = word[4 : 4 + n], word[8 : 8 + n], word[12 : 12 + n]
        return np.flatnonzero((fraction < self.fractions) & (held <= whole) & (held <= self.largest) & (whole <= 1 << 28) & (held > 0))

    def follows(self, at: int, before: int | None) -> tuple[int, int | None]:
        head = self.f.read_at(16, at)
        if len(head) < 16:
            return 16, before  # the file was cut off in a header
        sec, fraction, held, whole = struct.unpack(self.order + "IIII", head)
        sound = fraction < self.fractions and 0 < held <= min(whole, self.largest) and (before is None or abs(sec - before) <= APART)
        return (16 + held if sound else 0), sec


class _Blocks(_Records):
    """pcapng: blocks with their length at both ends; the head are those before the first packet."""

    def __init__(self, f, size: int):
        self.f, self.size = f, size
        self.order = "<" if f.read_at(12, 0)[8:12] == pcap.SECTION_LITTLE else ">"
        at = 0
        while at + 12 <= size:
            kind, length = struct.unpack(self.order + "II", f.read_at(8, at))
            if kind in (pcap.ENHANCED, pcap.OBSOLETE, pcap.SIMPLE) or length < 12:
                break
            at += length
        self.first, self.head = at, f.read_at(at, 0)

    def is_packet(self, at: int) -> bool:
        """Whether a packet with a time begins here; parts don't begin with others, which have the time of the packet before."""
        return at == self.first or struct.unpack(self.order + "I", self.f.read_at(4, at).ljust(4, b"\0"))[0] in (pcap.ENHANCED, pcap.OBSOLETE)

    def step(self, data: bytes, at: int) -> int:
        length = struct.unpack_from(self.order + "I", data, at + 4)[0] if at + 8 <= len(data) else 0
        return length if length >= 12 else 0

    def plausible(self, data: bytes, at: int) -> np.ndarray:
        shift = -at % 4
        words = np.frombuffer(data[shift : shift + (len(data) - shift) // 4 * 4], self.order + "u4")
        return shift + 4 * np.flatnonzero((words == pcap.ENHANCED) | (words == pcap.OBSOLETE))

    def follows(self, at: int, before: int | None) -> tuple[int, int | None]:
        head = self.f.read_at(8, at)
        length = struct.unpack(self.order + "II", head)[1] if len(head) == 8 else 12
        if length < 12 or length % 4 or length > _LARGEST:
            return 0, None
        ends = at + length > self.size or self.f.read_at(4, at + length - 4) == struct.pack(self.order + "I", length)
        return (length if ends else 0), None

    def inner(self, records: bytes, at: int, part: Part) -> None:
        if records[at : at + 4] in (pcap.PCAPNG, struct.pack(self.order + "I", pcap.INTERFACE)):
            raise ValueError(f"{part.path}: sections or interfaces begin after packets; read it with split 0")


def read_parts(spark: SparkSession, path: str, split: int = SPLIT, look_back: int = LOOK_BACK) -> DataFrame:
    """(path, start, content) of the parts of a capture, or of all captures of a folder; no part holds more than `split` bytes and a record. Frames must be shorter than `look_back`."""
    spark.dataSource.register(CaptureSource)
    return spark.read.format("capture_parts").option("split", str(split)).option("lookback", str(look_back)).load(path)


def read_captures(spark: SparkSession, path: str, split: int = SPLIT, look_back: int = LOOK_BACK) -> DataFrame:
    """Event rows of captures, read in parts."""
    return pcap.decode_captures(read_parts(spark, path, split, look_back), "content")


def capture_counters(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Packets, events, skipped and errors of all captures together, counted in parts."""
    each = pcap.count_frames(read_parts(spark, path, split), "content")
    return each.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("packets", "events", "skipped", "errors")])
