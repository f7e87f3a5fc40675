"""Removing passages that repeat across documents, by suffix order of collections.

A byte goes if a string of `WINDOW` bytes that covers it also starts in a document with a smaller id.

1. Whole texts that are equal are one text, of its smallest id.
2. In each window, the `GRAM`-byte string with the smallest hash is its anchor. Equal windows have equal anchors at equal places, so windows are compared only with
   those of the same anchor, whose hash is their key; windows in a row with the same anchor are one segment. A key that a single document holds decides nothing:
   a bitmap of fixed size leaves most of these out (its errors only let more through).
3. The segments are dealt out by key. Each task takes keys together into blocks of bounded size and builds the suffix order of a block's different segments
   column by column (`bwt`). Suffixes that share `WINDOW` bytes lie together in it; the smallest id of such a run
   decides for each window whether it goes. A segment that a smaller document has, too, goes as a whole.
4. A key with more than `BUSY_SEGMENTS` segments is busy. Of its segments, different ones are found first, each with its smallest document, summed map-side: a passage
   that a third of all documents hold is one row per task. The decisions on these are joined back to all documents that hold the segment. If the different
   ones are still too many, the windows are dealt out anew by half the distance of the anchor from a window's start and the longer string around the anchor that
   such windows share, again and again, until they fit. At the last split all windows of a key are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import suffix_order
from .common import bitmap_bits, flag_in_bitmap, fresh_dir, key_bitmap, materialize, row_key
from .text import U, mix64, prefix_hashes, utf8_column, window_hashes

WINDOW = 50
GRAM = 20
#: Segments in a block, about, and of a key from which on it is busy.
BLOCK_SEGMENTS = 20_000
BUSY_SEGMENTS = 5_000
#: The bitmap of shared keys has 2**28 bits: 32 MB.
KEY_BITS = 28
_SLICE = 1 << 15
_CHUNK = 1 << 20
_POSITION = 26


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, key, anchor's place, first window, last window) of the segments of texts that lie one after another, and the prefix hashes."""
    n = len(data)
    count = n - WINDOW + 1
    none = np.zeros(0, np.int64)
    if count <= 0:
        return none, none, none, none, none, np.zeros(n + 1, U)
    prefix = prefix_hashes(data)
    at = np.arange(n - GRAM + 1)
    gram = window_hashes(prefix, at, at + GRAM)
    low = (gram >> U(_POSITION)) << U(_POSITION) | at.astype(U)
    for step in (1, 2, 4, 8):
        low = np.minimum(low[:-step], low[step:])
    span = WINDOW - GRAM + 1
    low = np.minimum(low[:count], low[span - 16 : span - 16 + count])
    # windows that cross from one text into the next
    inside = np.zeros(count + 1, np.int32)
    ends = offsets[1:] - WINDOW + 1
    long = np.flatnonzero(ends > offsets[:-1])
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, ends[long], -1)
    window = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    anchor = (low[window] & U((1 << _POSITION) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(window) else none
    first = window[new]
    last = window[np.concatenate((new[1:] - 1, [len(window) - 1]))] if len(window) else none
    at = anchor[new]
    return np.searchsorted(offsets, first, "right") - 1, gram[at].view(np.int64), at, first, last, prefix


def chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets, offset in the row) for texts in pieces of about `_CHUNK` bytes; long ones in overlapping pieces."""
    data, offsets = utf8_column(column.cast(pa.string()))
    row, n = 0, len(column)
    while row < n:
        if offsets[row + 1] - offsets[row] > _CHUNK:
            for a in range(int(offsets[row]), int(offsets[row + 1]) - WINDOW + 1, _CHUNK):
                piece = data[a : min(a + _CHUNK + WINDOW - 1, offsets[row + 1])]
                yield np.array([row]), piece, np.array([0, len(piece)]), np.array([a - offsets[row]])
            row += 1
            continue
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _CHUNK, "right")) - 1)
        end = min(end, n)
        yield np.arange(row, end), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], np.zeros(end - row, np.int64)
        row = end


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different keys of each document, with the number of its segments."""
    for batch in batches:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for rows, data, offsets, _ in chunks(batch.column(0)):
            doc, key, *_ = segments(data, offsets)
            if len(rows) == 1:  # perhaps a piece of a long text
                held.append((rows[doc], key))
                continue
            yield _key_batch(rows[doc], key)
        if held:
            yield _key_batch(*(np.concatenate(x) for x in zip(*held)))


def _key_batch(doc: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))) if len(key) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(np.diff(np.append(new, len(key))).astype(np.int32))], ["key", "n"])


_ROW = "key long, lo int, hi int, place int, doc long, row long, starts array<long>, segment binary"
_ROW_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def _in(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    bit = key & ((1 << KEY_BITS) - 1)  # the low bits: an anchor is the smallest hash of many, so its high ones are mostly 0
    return ((bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)


def _shared_segments(wanted, unwanted):
    """The segments whose key is in the bitmap `wanted` and not in `unwanted` (None: empty), equal ones of a document once, with the places where they start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own_keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for rows, data, offsets, shift in chunks(batch.column(2)):
                doc, key, at, first, last, prefix = segments(data, offsets)
                hit = _in(wanted.value, key)
                if unwanted is not None:
                    hit &= ~_in(unwanted.value, key)
                keep = np.flatnonzero(hit)
                doc, key, at, first, last = doc[keep], key[keep], at[keep], first[keep], last[keep]
                whole = window_hashes(prefix, first, last + WINDOW) if len(first) else np.zeros(0, U)
                order = np.lexsort((whole, key, doc))
                doc, key, at, first, last, whole = doc[order], key[order], at[order], first[order], last[order], whole[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])
                lists = np.append(np.flatnonzero(new), len(doc)).astype(np.int32)
                starts = pa.ListArray.from_arrays(pa.array(lists), pa.array(first - offsets[doc] + shift[doc]))
                doc, key, at, first, last = doc[new], key[new], at[new], first[new], last[new]
                size = last - first + WINDOW
                ends = np.concatenate(([0], np.cumsum(size)))
                flat = data[np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)]
                segment = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
                distance = [pa.array(np.full(len(doc), x, np.int32)) for x in (0, WINDOW - GRAM)]
                columns = [pa.array(key), *distance, pa.array((at - first).astype(np.int32)), pa.array(ids[rows[doc]]), pa.array(own_keys[rows[doc]]), starts, segment]
                yield pa.RecordBatch.from_arrays(columns, _ROW_NAMES)

    return run


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments cut in two by distance; each part has the hash of the bytes that its windows share as its key."""
    for batch in batches:
        out = []
        for key, lo, hi, place, doc, row, starts, segment in zip(*(c.to_pylist() for c in batch.columns)):
            middle = (lo + hi) // 2
            for a, b in ((lo, middle), (middle + 1, hi)):
                first, last = max(0, place - b), min(len(segment) - WINDOW, place - a)
                if first <= last:
                    shared = segment[place - a : place + WINDOW - b]
                    digest = hashlib.blake2b(shared, digest_size=8, key=b"%d-%d" % (a, b)).digest()
                    out.append((int.from_bytes(digest, "little", signed=True), a, b, place - first, doc, row, [x + first for x in starts], segment[first : last + WINDOW]))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], _ROW_NAMES)


def _may_repeat(key, lo, hi, place, data, at, size) -> np.ndarray:
    """Which texts share a longer string around the anchor with another: the windows of each quarter of the distances have one in common."""
    prefix = prefix_hashes(data)
    keep = np.zeros(len(key), bool)
    step = (hi - lo) // 4 + 1
    for part in range(4):
        a = lo + part * step
        b = np.minimum(a + step - 1, hi)
        own = np.flatnonzero((a <= hi) & (np.maximum(0, place - b) <= np.minimum(size - WINDOW, place - a)))
        if len(own):
            begin = at[own] + place[own] - a[own]
            h = window_hashes(prefix, begin, begin + WINDOW - (b - a)[own]) ^ mix64(key[own].view(U) + a[own].astype(U))
            _, which, count = np.unique(h, return_inverse=True, return_counts=True)
            keep[own[count[which] > 1]] = True
    return keep


def block_spans(least: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, from, to) of what goes of each text for the document `least`; all texts with windows of the same key are in the block."""
    _, text, offset, lcp = suffix_order(data, at, size, folder)
    run = np.cumsum(lcp < WINDOW) - 1
    owner = np.full(run[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(owner, run, least[text])
    # windows of each text, and the smallest id that has them
    windows = size - WINDOW + 1
    base = np.concatenate(([0], np.cumsum(windows)))
    smallest = np.zeros(base[-1], np.int64)
    whole = offset <= size[text] - WINDOW
    smallest[base[text[whole]] + offset[whole]] = owner[run[whole]]
    row = np.repeat(np.arange(len(least)), windows)
    goes = smallest < least[row]
    opens, closes = goes.copy(), goes.copy()
    opens[1:] &= ~(goes[:-1] & (row[1:] == row[:-1]))
    closes[:-1] &= ~(goes[1:] & (row[1:] == row[:-1]))
    a, b = np.flatnonzero(opens), np.flatnonzero(closes)
    return row[a], a - base[row[a]], b - base[row[b]] + WINDOW


_DECISION = "key long, sid binary, least long, spans array<struct<a:int,b:int>>"


def _decisions(key, lo, hi, place, least, data: np.ndarray, at: np.ndarray, size: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, from, to) of what goes of different segments for the smallest document of each."""
    keep = np.flatnonzero(_may_repeat(key, lo, hi, place, data, at, size))
    if not len(keep):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    inner = np.concatenate(([0], np.cumsum(size[keep])))
    own = data[np.arange(inner[-1]) + np.repeat(at[keep] - inner[:-1], size[keep])]
    row, a, b = block_spans(least[keep], own, inner[:-1], size[keep], folder)
    return keep[row], a, b


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and sizes of a binary column."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends[:-1] - ends[0], np.diff(ends)


def _by_key(solve, block_segments: int):
    """A mapInArrow function that gives `solve` tables of whole keys of about so many rows, of rows that come sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= block_segments:
                table = pa.Table.from_batches(held)
                key = table.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on
                if cut:
                    yield from solve(table.slice(0, cut).combine_chunks())
                    held = table.slice(cut).to_batches()
                    rows = table.num_rows - cut
        if rows:
            yield from solve(pa.Table.from_batches(held).combine_chunks())

    return run


_KEY_COLUMNS = ("key", "lo", "hi", "place")
_SPANS = "array<struct<a:bigint,b:bigint>>"


def _direct(folder: str):
    """(doc, row, spans) of the segments of a block."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        doc = table.column("doc").to_numpy()
        # a key of one document decides nothing
        key = table.column("key").to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        several = np.repeat(np.minimum.reduceat(doc, edge) != np.maximum.reduceat(doc, edge), np.diff(np.append(edge, len(key))))
        table = table.take(pa.array(np.flatnonzero(several))).combine_chunks()
        if not table.num_rows:
            return
        doc = table.column("doc").to_numpy()
        data, at, size = _bytes_of(table.column("segment").combine_chunks())
        raw, same = data.tobytes(), {}
        which = np.array([same.setdefault(raw[x : x + n], len(same)) for x, n in zip(at.tolist(), size.tolist())], np.int64)
        one = np.zeros(len(same), np.int64)
        one[which[::-1]] = np.arange(len(which))[::-1]
        least = np.full(len(same), np.iinfo(np.int64).max)
        np.minimum.at(least, which, doc)
        columns = [table.column(c).to_numpy()[one] for c in _KEY_COLUMNS]
        text, a, b = _decisions(*columns, least, data, at[one], size[one], folder)
        # back to the rows: the whole segment, or what the suffix order says of its smallest document's
        later = np.flatnonzero(doc > least[which])
        first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(same)))))
        firsts = np.flatnonzero(doc == least[which])
        times = (first[1:] - first[:-1])[which[firsts]]
        pick = np.arange(times.sum()) + np.repeat(first[which[firsts]] - (np.cumsum(times) - times), times)
        row = np.concatenate((later, np.repeat(firsts, times)))
        a, b = np.concatenate((np.zeros(len(later), np.int64), a[pick])), np.concatenate((size[later], b[pick]))
        # and to the places where they start
        starts = table.column("starts").combine_chunks().take(pa.array(row))
        each = starts.value_lengths().to_numpy()
        begin = starts.flatten().to_numpy()
        row, a, b = np.repeat(row, each), begin + np.repeat(a, each), begin + np.repeat(b, each)
        order = np.lexsort((a, row))
        row, a, b = row[order], a[order], b[order]
        said, count = np.unique(row, return_counts=True)
        spans = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]))
        yield pa.RecordBatch.from_arrays([pa.array(doc[said]), table.column("row").combine_chunks().take(pa.array(said)), spans], ["doc", "row", "spans"])

    return solve


def _by_decision(folder: str):
    """_DECISION rows of different segments: what goes of each, and which of them more documents have."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        least, most = (table.column(c).to_numpy() for c in ("least", "most"))
        columns = [table.column(c).to_numpy() for c in _KEY_COLUMNS]
        row, a, b = _decisions(*columns, least, *_bytes_of(table.column("segment").combine_chunks()), folder)
        count = np.bincount(row, minlength=len(least))
        said = np.flatnonzero((count > 0) | (least < most))
        spans = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["a", "b"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count[said]))).astype(np.int32)), spans)
        yield pa.RecordBatch.from_arrays([pa.array(columns[0][said]), table.column("sid").combine_chunks().take(pa.array(said)), pa.array(least[said]), lists], ["key", "sid", "least", "spans"])

    return solve


def _busy_spans(rows: DataFrame, block_segments: int, folder: str) -> DataFrame:
    """(doc, row, spans) of the segments in a written table, by way of different segments."""
    distinct = rows.groupBy("key", "lo", "hi", "place", "segment").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    distinct = materialize(distinct.withColumn("sid", F.unhex(F.md5("segment"))), "suffix-distinct")
    busy = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("hi") - F.col("lo")).alias("width")).filter((F.col("n") > block_segments) & (F.col("width") > 0))
    busy = materialize(busy.select(F.expr("key ^ 1").alias("_busy")), "suffix-busy")
    some_busy = not busy.isEmpty()
    calm = distinct.join(busy, F.expr("key ^ 1") == F.col("_busy"), "left_anti") if some_busy else distinct
    decided = calm.repartition("key").sortWithinPartitions("key").mapInArrow(_by_key(_by_decision(folder), block_segments), _DECISION)
    decided = materialize(decided, "suffix-decided").select(F.expr("key ^ 1").alias("_key"), F.expr("concat(sid, X'')").alias("_sid"), "least", "spans")
    held = rows.withColumn("sid", F.unhex(F.md5("segment")))
    found = held.join(decided, (F.expr("key ^ 1") == F.col("_key")) & (F.expr("concat(sid, X'')") == F.col("_sid")))
    # a segment that a smaller document has goes as a whole
    whole = F.array(F.struct(F.lit(0).alias("a"), F.octet_length("segment").cast("int").alias("b")))
    gone = F.when(F.col("doc") > F.col("least"), whole).otherwise(F.col("spans"))
    spans = found.withColumn("gone", gone).filter(F.size("gone") > 0).select("doc", "row", F.expr("flatten(transform(starts, s -> transform(gone, x -> struct(s + x.a AS a, s + x.b AS b))))").alias("spans"))
    if not some_busy:
        return spans
    parts = rows.join(busy, F.expr("key ^ 1") == F.col("_busy"), "left_semi").select(*_ROW_NAMES).mapInArrow(_split, _ROW)
    return spans.unionByName(_busy_spans(materialize(parts, "suffix-parts"), block_segments, folder))


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bit for each key of a written table: at most 8192 slices of 4 KB, whatever the input."""
    bit = F.pmod(F.col("key"), F.lit(1 << KEY_BITS)).cast("int")
    found = keys.groupBy(F.shiftright(bit, 15).alias("slice")).agg(F.bitmap_construct_agg(bit.bitwiseAND(_SLICE - 1).cast("long")).alias("bits")).toArrow()
    table = np.zeros(((1 << KEY_BITS) // _SLICE, _SLICE // 8), np.uint8)
    for s, b in zip(found["slice"].to_pylist(), found["bits"]):
        table[s] = np.frombuffer(b.as_buffer(), np.uint8)
    return table.ravel()


def repeated_spans(texts: DataFrame, block_segments: int = BLOCK_SEGMENTS, busy_segments: int = BUSY_SEGMENTS) -> DataFrame:
    """(doc, row, spans): byte ranges of `texts` (_id, _row, _text; ids not null) that a text with a smaller id holds, overlapping ones included."""
    spark = texts.sparkSession
    folder = fresh_dir(spark, "suffix-rounds")
    counts = texts.select("_text").mapInArrow(_keys, "key long, n int").groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"))
    shared = materialize(counts.filter("docs > 1").select("key", (F.col("n") > busy_segments).alias("busy")), "suffix-keys")
    wanted = spark.sparkContext.broadcast(_bitmap(shared))
    busy = shared.filter("busy")
    crowd = None if busy.isEmpty() else spark.sparkContext.broadcast(_bitmap(busy))
    rows = texts.select("_id", "_row", "_text")
    calm = rows.mapInArrow(_shared_segments(wanted, crowd), _ROW).repartition("key").sortWithinPartitions("key")
    spans = calm.mapInArrow(_by_key(_direct(folder), block_segments), f"doc long, row long, spans {_SPANS}")
    if crowd is None:
        return spans
    held = materialize(rows.mapInArrow(_shared_segments(crowd, None), _ROW), "suffix-busy-rows")
    return spans.unionByName(_busy_spans(held, block_segments, folder))


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, text, whole, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            gone = [(0, len(raw))] if whole and len(raw) >= WINDOW else []
            if spans.is_valid and not whole:
                flat = spans.values
                gone = _merge(list(zip(flat.field(0).to_pylist(), flat.field(1).to_pylist())))
            kept, last = [], 0
            for a, b in gone:
                kept.append(raw[last:a])
                last = b
            kept.append(raw[last:])
            rows.append((i, len(raw), sum(b - a for a, b in gone), [{"a": a, "b": b} for a, b in gone], b"".join(kept)))
        kinds = [batch.column(0).type, pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], ["_id", "n_bytes", "n_removed", "removed", "kept"])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_segments: int = BLOCK_SEGMENTS, busy_segments: int = BUSY_SEGMENTS) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, removed (byte ranges, maximal) and kept (the other bytes).

    Null texts count as empty; texts of fewer than `WINDOW` bytes lose nothing. A very long text is worked on in overlapping pieces. Rows that repeat an id
    don't take from each other, and each loses what a smaller id holds of its own text. A row with a null id loses nothing and takes nothing.
    An empty table gives an empty result. Other columns are ignored.
    """
    docs = df.select(F.col(id_col).cast("long").alias("_id"), row_key(F.col(id_col), F.col(text_col)).alias("_row"), F.col(text_col).cast("binary").alias("_text"))
    keyed = docs.filter("_id IS NOT NULL").withColumn("_digest", F.unhex(F.sha2(F.coalesce("_text", F.lit("").cast("binary")), 256)))
    copies = keyed.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    copies = materialize(copies.select(F.col("_digest").alias("_of"), "_first", F.xxhash64("_digest").alias("_h")), "suffix-copies")
    bits = bitmap_bits(copies.count())
    flagged = flag_in_bitmap(keyed.withColumn("_h", F.xxhash64("_digest")), "_h", key_bitmap(copies.select("_h"), "_h", bits), "_maybe", bits)
    members = flagged.filter("_maybe").join(copies.drop("_h"), F.col("_digest") == F.col("_of"), "left")
    later = F.coalesce(F.col("_id") > F.col("_first"), F.lit(False))
    wholes = materialize(members.filter(later).select("_id", "_row").distinct(), "suffix-wholes")
    columns = ["_id", "_row", "_text"]
    unique = flagged.filter("NOT _maybe").select(columns).unionByName(members.filter(~later).select(columns))
    spans = repeated_spans(unique, block_segments, busy_segments).groupBy("doc", "row").agg(F.flatten(F.collect_list("spans")).alias("_spans"))
    changes = spans.select("doc", "row", "_spans", F.lit(False).alias("_whole")).unionByName(
        wholes.select(F.col("_id").alias("doc"), F.col("_row").alias("row"), F.lit(None).cast(_SPANS).alias("_spans"), F.lit(True).alias("_whole"))
    )
    changes = materialize(changes, "suffix-changes")
    bits = bitmap_bits(changes.count())
    touched = flag_in_bitmap(docs, "_row", key_bitmap(changes.select("row"), "row", bits), "_maybe", bits)
    as_is = touched.filter("NOT _maybe").select("_id", "_text", F.lit(False).alias("_whole"), F.lit(None).cast(_SPANS).alias("_spans"))
    cut = touched.filter("_maybe").join(changes, (F.col("_id") == F.col("doc")) & (F.col("_row") == F.col("row")), "left").select("_id", "_text", F.coalesce("_whole", F.lit(False)).alias("_whole"), "_spans")
    schema = "_id long, n_bytes long, n_removed long, removed array<struct<a:bigint,b:bigint>>, kept binary"
    return as_is.unionByName(cut).mapInArrow(_apply, schema).withColumnRenamed("_id", id_col)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
