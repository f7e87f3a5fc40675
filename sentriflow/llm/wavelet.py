"""Token ids in wavelet-matrix shards.

A shard holds the ids of consecutive documents as bit planes, highest bit first: plane k has bit k of every id in the order that the planes
before give, zeros before ones. With the ones counted per block, access to the i-th id, counting an id in a
range and finding its n-th occurrence take a rank or select per plane. Planes lie in the file in compressed blocks
that are read one by one.

File: MAGIC, header length (u32), header (JSON: n, bits, zeros per plane, block offsets, documents), plane blocks. Each block covers
BLOCK_BITS bits and starts with the ones before it, so that a rank reads one block.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import PieceEncoder
from .common import fresh_dir, materialize, spread
from .files import Sink, open_read

MAGIC = b"WVMTRX1\n"
BLOCK_BITS = 1 << 18
#: A shard is closed once it has so many ids; a document is never cut.
SHARD_IDS = 4_000_000
END_ID = 0


def write_shard(out, ids: np.ndarray, doc_ids: list, doc_ends: list[int]) -> None:
    """Write ids (in document order) with the documents' ids and end positions."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    zeros, blocks, offsets, at = [], [], [], 0
    packer = zstandard.ZstdCompressor(level=1)
    for k in range(bits - 1, -1, -1):
        before, row, low, high = 0, [], [], []
        for b in range(0, max(1, len(ids)), BLOCK_BITS):
            part = now[b : b + BLOCK_BITS]
            ones = (part & part.dtype.type(1 << k)) != 0
            body = packer.compress(np.packbits(ones).tobytes())
            blocks.append(struct.pack("<QI", before, len(body)) + body)
            row.append(at)
            at += len(blocks[-1])
            low.append(np.compress(~ones, part))
            high.append(np.compress(ones, part))
            before += len(high[-1])
        zeros.append(len(ids) - before)
        offsets.append(row)
        now = np.concatenate(low + high)
    head = {"n": len(ids), "bits": bits, "zeros": zeros, "blocks": offsets, "doc_ids": doc_ids, "doc_ends": doc_ends}
    head = zlib.compress(json.dumps(head).encode(), 1)
    out.write(MAGIC + struct.pack("<I", len(head)) + head)
    for b in blocks:
        out.write(b)


class Shard:
    """Reads a shard; only the blocks that a question needs, and those once."""

    def __init__(self, file):
        self._file = file
        if file.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        size = struct.unpack("<I", file.read(4))[0]
        self.head = json.loads(zlib.decompress(file.read(size)))
        self.n, self.bits, self.zeros = self.head["n"], self.head["bits"], self.head["zeros"]
        self._base = len(MAGIC) + 4 + size
        self._kept: dict[tuple[int, int], tuple[int, np.ndarray]] = {}

    def _block(self, plane: int, b: int) -> tuple[int, np.ndarray]:
        """Ones before block b of a plane, and its bits."""
        if (plane, b) not in self._kept:
            self._file.seek(self._base + self.head["blocks"][plane][b])
            before, size = struct.unpack("<QI", self._file.read(12))
            raw = zstandard.ZstdDecompressor().decompress(self._file.read(size), max_output_size=BLOCK_BITS // 8)
            bits = np.unpackbits(np.frombuffer(raw, np.uint8))
            self._kept[plane, b] = before, bits[: self.n - b * BLOCK_BITS]
        return self._kept[plane, b]

    def rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i >= self.n:
            return self.n - self.zeros[plane]
        before, bits = self._block(plane, i // BLOCK_BITS)
        return before + int(np.count_nonzero(bits[: i % BLOCK_BITS]))

    def select(self, plane: int, bit: int, n: int) -> int:
        """Position of the n-th (from 0) such bit of a plane."""
        lo, hi = 0, len(self.head["blocks"][plane]) - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            ones = self._block(plane, mid)[0]
            if (ones if bit else mid * BLOCK_BITS - ones) <= n:
                lo = mid
            else:
                hi = mid - 1
        ones, bits = self._block(plane, lo)
        return lo * BLOCK_BITS + int(np.flatnonzero(bits == bit)[n - (ones if bit else lo * BLOCK_BITS - ones)])

    def access(self, i: int) -> int:
        """The i-th id."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.bits):
            ones = self.rank1(p, i)
            bit = self.rank1(p, i + 1) - ones
            value = value << 1 | bit
            i = self.zeros[p] + ones if bit else i - ones
        return value

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        """The range of `token` among positions a to b, in the order below the last plane."""
        if token < 0 or token >> self.bits:
            return 0, 0
        for p in range(self.bits):
            x, y = self.rank1(p, a), self.rank1(p, b)
            a, b = (self.zeros[p] + x, self.zeros[p] + y) if token >> self.bits - 1 - p & 1 else (a - x, b - y)
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """How often `token` occurs from position a to before b."""
        a, b = self._range(token, a, self.n if b is None else b)
        return max(0, b - a)

    def occurrence(self, token: int, n: int) -> int:
        """Position of the n-th (from 0) `token`; -1 if there are fewer."""
        a, b = self._range(token, 0, self.n)
        if n < 0 or a + n >= b:
            return -1
        at = a + n
        for p in range(self.bits - 1, -1, -1):
            bit = token >> self.bits - 1 - p & 1
            at = self.select(p, bit, at - self.zeros[p] if bit else at)
        return at

    def all_ids(self) -> np.ndarray:
        """All ids, by undoing the planes from the last one up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        # ids as they lie below the last plane are sorted by reversed bits; only their bits matter, plane by plane
        now = np.zeros(self.n, kind)
        opened = zstandard.ZstdDecompressor()
        for p in range(self.bits - 1, -1, -1):
            out, z, o, bit = np.empty(self.n, kind), 0, self.zeros[p], kind(1 << self.bits - 1 - p)
            for b, at in enumerate(self.head["blocks"][p]):
                self._file.seek(self._base + at)
                _, size = struct.unpack("<QI", self._file.read(12))
                raw = opened.decompress(self._file.read(size), max_output_size=BLOCK_BITS // 8)
                part = out[b * BLOCK_BITS : (b + 1) * BLOCK_BITS]
                ones = np.unpackbits(np.frombuffer(raw, np.uint8), count=len(part)).view(bool)
                n = int(np.count_nonzero(ones))
                part[ones] = now[o : o + n] | bit
                part[~ones] = now[z : z + len(part) - n]
                z, o = z + len(part) - n, o + n
            now = out
        return now


_encoders: dict[str, PieceEncoder] = {}


def _default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, bounds: list[int] | None = None) -> DataFrame:
    """(_id, _range, width, ids): each text's ids as little-endian integers of `width` bytes, without an end id, and how many of `bounds` the id has passed.

    Null and empty texts have no ids. Texts are read where they lie; only ids move on.
    """
    path, edges = tokenizer or _default_tokenizer(), np.array(bounds or [], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in _encoders:
            _encoders[path] = PieceEncoder(path)
        encoder = _encoders[path]
        width = encoder.kind.itemsize
        for batch in batches:
            for a, b, ids, first in encoder.encode(batch.column(1)):
                own = batch.column(0).slice(a, b - a)
                span = np.searchsorted(edges, own.fill_null(np.iinfo(np.int64).min).to_numpy(), "left").astype(np.int32)
                flat = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((first * width).astype(np.int32)), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([own, pa.array(span), pa.array(np.full(b - a, width, np.int32)), flat], ["_id", "_range", "width", "ids"])

    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "_id long, _range int, width int, ids binary")


def _bounds(df: DataFrame, id_col: str, parts: int) -> list[int]:
    """At most `parts` - 1 ids that part the rows about evenly."""
    if parts < 2:
        return []
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    found = df.agg(F.percentile_approx(F.col(id_col).cast("long"), shares, F.lit(max(10_000, 10 * parts))).alias("q")).first()["q"]
    return sorted(set(found or []))


def write_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode all texts, write shards in ascending id order, and return their list.

    One row per shard: part and shard (their order is the documents' order), path, n_docs, n_ids and start (ids in all shards before). The path of
    the tokenizer must be readable on every executor. Null and empty texts have the end id alone; a null id comes first;
    rows that repeat an id follow each other, in the order of their ids' bytes. A very long text is one document of one shard, which it may
    make longer than `shard_ids`. An empty table gives no shard. Other columns are ignored.
    """
    spark = df.sparkSession
    folder = fresh_dir(spark, "wavelet")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        doc_ids: list = []
        ends: list[int] = []

        def close() -> pa.RecordBatch:
            sink = Sink(folder, f"part-{part:05d}-{shard:04d}", ".wvm")
            write_shard(sink, np.concatenate(held), doc_ids, ends)
            sink.close()
            return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "path": sink.uri, "n_docs": len(ends), "n_ids": ends[-1]}], _MANIFEST)

        for batch in batches:
            width = batch.column(1)[0].as_py() if batch.num_rows else 4
            raw = batch.column(2).cast(pa.large_binary())
            edge = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            size = np.diff(edge) // width
            # an end id after each document
            ids = np.full(int(size.sum()) + len(size), END_ID, f"<u{width}")
            ids[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[edge[0] : edge[-1]].view(f"<u{width}")
            after = np.cumsum(size + 1)
            names, row = batch.column(0).to_pylist(), 0
            while row < len(names):
                before = int(after[row - 1]) if row else 0
                base = ends[-1] if ends else 0
                stop = min(len(names), int(np.searchsorted(after, before + shard_ids - base, "left")) + 1)
                held.append(ids[before : after[stop - 1]])
                doc_ids += names[row:stop]
                ends += (after[row:stop] - before + base).tolist()
                row = stop
                if ends[-1] >= shard_ids:
                    yield close()
                    held, doc_ids, ends, shard = [], [], [], shard + 1
        if ends:
            yield close()

    # as many ranges as the session has shuffle partitions; the bounds are found without the texts
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    encoded = encode(df, id_col, text_col, tokenizer, _bounds(df, id_col, parts))
    ordered = encoded.repartitionById(parts, "_range").drop("_range").sortWithinPartitions("_id", "ids")
    shards = materialize(ordered.mapInArrow(run, "part int, shard int, path string, n_docs long, n_ids long"), "wavelet-list")
    sums = shards.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    sums = sums.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    in_part = Window.partitionBy("part").orderBy("shard")
    return shards.join(sums, "part").select("part", "shard", "path", "n_docs", "n_ids", (F.col("_before") + F.sum("n_ids").over(in_part) - F.col("n_ids")).alias("start"))


_MANIFEST = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def read_documents(shards: DataFrame) -> DataFrame:
    """One row per document of the listed shards: doc_id, start (ids before it), n_tokens and ids (little-endian 32-bit).

    Shards are dealt out one by one, so as many tasks read as there are shards (up to `MAX_TASKS`).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_read(path) as f:
                    shard = Shard(f)
                    raw = shard.all_ids().astype("<u4")
                ends = shard.head["doc_ends"]
                for a in range(0, len(ends), 500):
                    own = list(zip([0, *ends][a : a + 500], ends[a : a + 500]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.head["doc_ids"][a : a + 500], pa.int64()), pa.array([start + x for x, _ in own], pa.int64()), pa.array([y - x for x, y in own], pa.int64()), pa.array([raw[x:y].tobytes() for x, y in own], pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return spread(shards.select("path", "start")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op10_token_wavelet(spark, sf_dir: str) -> DataFrame:
    docs = read_documents(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
