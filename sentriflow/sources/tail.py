"""A log that still grows, as a stream of its lines.

The offset is (inode, byte) of the file under the name. What lies between two offsets is read by inode: a file that was rotated away is finished under its new name, with all that were
rotated between, and the new one follows from its start; a file that has become shorter was truncated and is read from its start again. Only whole lines are taken, so a line that
is being written waits. Spark's checkpoint holds the offsets: after a restart no line is lost or read twice.

    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("log_tail").load("/logs/conn.log")
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .logs import LOG_JSON, TSV_EVENTS, json_events, split_tsv

#: Bytes that one task reads at most.
SPLIT = 64 << 20


@dataclass
class Piece(InputPartition):
    """Lines that begin in a range of bytes of a file."""

    inode: int
    start: int
    end: int


class TailSource(DataSource):
    """Options: path (also of load()), split (bytes a task)."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "value string, inode long, byte long"

    def streamReader(self, schema) -> TailReader:  # noqa: N802
        return TailReader(self.options["path"], int(self.options.get("split", SPLIT)))


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path.removeprefix("file://"), split

    def initialOffset(self) -> dict:  # noqa: N802
        return {"inode": -1, "byte": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """The file under the name, up to its last whole line."""
        try:
            with open(self.path, "rb") as f:
                return {"inode": os.fstat(f.fileno()).st_ino, "byte": whole_lines(f)}
        except FileNotFoundError:
            return self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        if start["inode"] == end["inode"]:
            first = start["byte"] if start["byte"] <= end["byte"] else 0
            found = [(end["inode"], first, end["byte"])]
        else:
            found = [(inode, start["byte"] if inode == start["inode"] else 0, size) for inode, size in self._rotated(start["inode"], end["inode"])]
            found.append((end["inode"], 0, end["byte"]))
        return [Piece(i, a, min(a + self.split, b)) for i, low, b in found if i >= 0 for a in range(low, b, self.split)]

    def _rotated(self, old: int, new: int) -> list[tuple[int, int]]:
        """(inode, size) of the file that was read last, if it is still there, and of those that came between it and the present one, oldest first."""
        if old < 0:
            return []
        stats = [s for s in self._files().values() if s.st_ino != new]
        last = next((s for s in stats if s.st_ino == old), None)
        if last is None:
            return []
        between = [s for s in stats if s.st_ino != old and s.st_mtime_ns > last.st_mtime_ns]
        return [(s.st_ino, s.st_size) for s in [last, *sorted(between, key=lambda s: s.st_mtime_ns)]]

    def _files(self) -> dict[str, os.stat_result]:
        """The file and its siblings whose names begin with its own."""
        folder, name = os.path.split(self.path)
        with os.scandir(folder or ".") as entries:
            return {e.path: e.stat() for e in entries if e.name.startswith(name) and e.is_file()}

    def read(self, partition: Piece) -> Iterator[tuple[str, int, int]]:
        path = next((p for p, s in self._files().items() if s.st_ino == partition.inode), None)
        if path is None:
            raise FileNotFoundError(f"{self.path} (inode {partition.inode}) went before it was read")
        with open(path, "rb") as f:
            # a line belongs to the piece in which it begins
            f.seek(max(0, partition.start - 1))
            at = partition.start
            if at and f.read(1) != b"\n":
                at += len(f.readline())
            while at < partition.end:
                line = f.readline()
                if not line:
                    break
                if line.strip():
                    yield line.rstrip(b"\r\n").decode("utf-8", "replace"), partition.inode, at
                at += len(line)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def whole_lines(f) -> int:
    """The byte after the last line end of an open file."""
    at = f.seek(0, os.SEEK_END)
    while at:
        step = min(at, 1 << 16)
        f.seek(at - step)
        cut = f.read(step).rfind(b"\n")
        if cut >= 0:
            return at - step + cut + 1
        at -= step
    return 0


def tail_log(spark: SparkSession, path: str, kind: str, form: str = "json", fields: list[str] | None = None, split: int = SPLIT) -> DataFrame:
    """A growing log (kind conn, dns or ssl; JSON lines, or tab-separated with the given `fields`) as a stream of events. Lines that can't be read are dropped."""
    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("log_tail").option("split", str(split)).load(path)
    if form == "json":
        parsed = lines.filter(F.try_parse_json("value").isNotNull()).select(F.from_json("value", LOG_JSON).alias("r")).select("r.*")
        return json_events(parsed, kind)
    if fields is None:
        raise ValueError("a tab-separated log that is read from its middle needs its fields")
    return TSV_EVENTS[kind](split_tsv(lines.select("value"), fields))
