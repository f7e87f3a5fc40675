"""Matroska media columns: bytes as 8-bit PCM in a Matroska file, and Matroska files as packet tables.

The reader walks EBML elements of variable-length ids and sizes (unknown sizes included), clusters, simple blocks and
block groups, undoes Xiph, EBML and fixed-size lacing, and reads the cues. Each packet gets its track, its
timestamp and its byte range in the file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

# Fixed values of the Matroska format: element ids
EBML, DOC_TYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, TIMESTAMP_SCALE = 0x18538067, 0x1549A966, 0x2AD7B1
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
#: Elements that end a cluster or segment of unknown size.
TOP = {CLUSTER, CUES, TRACKS, INFO, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}

NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
RATE = 8000
FRAME = 1024
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 8
PAD = 64
#: Output batches are cut at about so many bytes.
BATCH_BYTES = 8 << 20


def vint(value: int, length: int = 0) -> bytes:
    """An EBML variable-length number, in the fewest bytes or in `length`."""
    length = length or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * length).to_bytes(length, "big")


def element(eid: int, body: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(eid: int, value: int) -> bytes:
    return element(eid, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """The head and the frames of a laced block body."""
    if kind == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING:
        head += vint(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1]):
            n = next(n for n in range(1, 9) if abs(b - a) < (1 << 7 * n - 1) - 1)
            head += vint(b - a + (1 << 7 * n - 1) - 1, n)
    return head + b"".join(frames)


def _block(track: int, relative: int, flags: int, body: bytes) -> bytes:
    return vint(track) + struct.pack(">hB", relative, flags) + body


def mux(payload: bytes) -> bytes:
    """A Matroska file with one mono 8-bit PCM track; its samples are the bytes of `payload`."""
    head = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(DOC_TYPE, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    track = number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT")
    parts = [element(INFO, number(TIMESTAMP_SCALE, 1_000_000)), element(TRACKS, element(TRACK_ENTRY, track + number(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + audio))]
    at, cues = sum(map(len, parts)), []
    per_block = FRAME * FRAMES_PER_BLOCK
    per_cluster = per_block * BLOCKS_PER_CLUSTER
    for c in range(0, len(payload), per_cluster):
        start = c * 1000 // RATE
        blocks = [number(TIMESTAMP, start)]
        for b in range(c, min(c + per_cluster, len(payload)), per_block):
            frames = [payload[f : f + FRAME] for f in range(b, min(b + per_block, len(payload)), FRAME)]
            kind = NO_LACING if len(frames) == 1 else (XIPH, FIXED, EBML_LACING)[(b // per_block) % 3]
            if kind == FIXED and len(frames[-1]) != len(frames[0]):
                kind = EBML_LACING
            body = _block(1, b * 1000 // RATE - start, 0x80 | kind << 1, lace(frames, kind))
            # the last block of a file goes into a block group, the others are simple blocks
            last = b + per_block >= len(payload)
            blocks.append(element(BLOCK_GROUP, element(BLOCK, _block(1, b * 1000 // RATE - start, kind << 1, lace(frames, kind)))) if last else element(SIMPLE_BLOCK, body))
        cues.append((start, at))
        parts.append(element(CLUSTER, b"".join(blocks)))
        at += len(parts[-1])
    points = [element(CUE_POINT, number(CUE_TIME, t) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, p))) for t, p in cues]
    parts.append(element(CUES, b"".join(points)))
    return head + element(SEGMENT, b"".join(parts))


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """(value, next position, whether all value bits are ones)."""
    first = data[at]
    if first == 0:
        raise ValueError(f"EBML number of more than 8 bytes at {at}")
    length = 9 - first.bit_length()
    if at + length > len(data):
        raise ValueError("EBML number is cut off")
    raw = int.from_bytes(data[at : at + length], "big")
    value = raw & ((1 << 7 * length) - 1)
    return raw if keep_marker else value, at + length, value == (1 << 7 * length) - 1


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start and end of the body) of the elements from `at` to `end`, without going into them."""
    while at < end:
        eid, at, _ = read_vint(data, at, keep_marker=True)
        size, at, unknown = read_vint(data, at)
        stop = at + size
        if unknown:
            stop = at
            while stop < end:
                inner, after, _ = read_vint(data, stop, keep_marker=True)
                if inner == SEGMENT or inner == EBML or (eid != SEGMENT and inner in TOP):
                    break
                n, after, endless = read_vint(data, after)
                stop = end if endless and eid == SEGMENT else after + n
        if stop > end:
            raise ValueError("EBML element is cut off")
        yield eid, at, stop
        at = stop


def _unsigned(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def unlace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges (start, size) of the frames of a block body."""
    if kind == NO_LACING:
        return [(at, end - at)]
    n, at, sizes = data[at] + 1, at + 1, []
    if kind == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
            sizes.append(size)
    elif kind == EBML_LACING:
        size, at, _ = read_vint(data, at)
        sizes = [size] if n > 1 else []
        for _ in range(n - 2):
            length = 9 - data[at].bit_length()
            delta, at, _ = read_vint(data, at)
            sizes.append(sizes[-1] + delta - ((1 << 7 * length - 1) - 1))
    else:
        if (end - at) % n:
            raise ValueError("fixed-size lacing doesn't divide the block")
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing is longer than its block")
    starts = np.cumsum([at, *sizes[:-1]]).tolist()
    return list(zip(starts, sizes))


def parse(data: bytes) -> dict:
    """{'doc_type', 'tracks': {number: {...}}, 'packets': [...], 'cues': [(time, track, offset)], 'clusters': [offset]}.

    A packet is (track, timestamp in ns, offset, size, keyframe, lacing, cluster, cued).
    """
    out: dict = {"doc_type": "", "tracks": {}, "packets": [], "cues": [], "clusters": []}
    scale = 1_000_000
    for eid, a, b in elements(data, 0, len(data)):
        if eid == EBML:
            out["doc_type"] = next((data[x:y].rstrip(b"\0").decode("ascii", "replace") for i, x, y in elements(data, a, b) if i == DOC_TYPE), "matroska")
        if eid != SEGMENT:
            continue
        top = list(elements(data, a, b))
        for i, x, y in top:
            if i == INFO:
                scale = next((_unsigned(data, p, q) for j, p, q in elements(data, x, y) if j == TIMESTAMP_SCALE), scale)
            elif i == TRACKS:
                for j, p, q in elements(data, x, y):
                    if j == TRACK_ENTRY:
                        track = _track(data, p, q)
                        out["tracks"][track["number"]] = track
            elif i == CUES:
                out["cues"] += _cues(data, x, y, a)
        before = a
        for i, x, y in top:
            if i == CLUSTER:
                out["clusters"].append(before)
                _cluster(data, x, y, scale, out)
            before = y
    cued = {p for _, _, p in out["cues"]}
    out["packets"] = [(*p[:6], p[6], out["clusters"][p[6]] in cued) for p in out["packets"]]
    return out


def _track(data: bytes, a: int, b: int) -> dict:
    found = {"number": 0, "type": 0, "codec": "", "default_duration": 0, "rate": 8000.0, "channels": 1, "bits": 0}
    for i, x, y in elements(data, a, b):
        if i in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
            found[{TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "default_duration"}[i]] = _unsigned(data, x, y)
        elif i == CODEC_ID:
            found["codec"] = data[x:y].rstrip(b"\0").decode("ascii", "replace")
        elif i == AUDIO:
            for j, p, q in elements(data, x, y):
                if j == SAMPLING_FREQUENCY:
                    found["rate"] = struct.unpack(">d" if q - p == 8 else ">f", data[p:q])[0]
                elif j in (CHANNELS, BIT_DEPTH):
                    found["channels" if j == CHANNELS else "bits"] = _unsigned(data, p, q)
    return found


def _cues(data: bytes, a: int, b: int, segment: int) -> list[tuple[int, int, int]]:
    found = []
    for i, x, y in elements(data, a, b):
        if i != CUE_POINT:
            continue
        time, places = 0, []
        for j, p, q in elements(data, x, y):
            if j == CUE_TIME:
                time = _unsigned(data, p, q)
            elif j == CUE_TRACK_POSITIONS:
                inner = {k: _unsigned(data, r, s) for k, r, s in elements(data, p, q)}
                places.append((inner.get(CUE_TRACK, 0), segment + inner.get(CUE_CLUSTER_POSITION, 0)))
        found += [(time, track, offset) for track, offset in places]
    return found


def _cluster(data: bytes, a: int, b: int, scale: int, out: dict) -> None:
    base, index = 0, len(out["clusters"]) - 1
    for i, x, y in elements(data, a, b):
        if i == TIMESTAMP:
            base = _unsigned(data, x, y)
        elif i == SIMPLE_BLOCK:
            _packets(data, x, y, base, scale, None, index, out)
        elif i == BLOCK_GROUP:
            inner = list(elements(data, x, y))
            key = all(j != REFERENCE_BLOCK for j, _, _ in inner)
            for j, p, q in inner:
                if j == BLOCK:
                    _packets(data, p, q, base, scale, key, index, out)


def _packets(data: bytes, a: int, b: int, base: int, scale: int, key: bool | None, index: int, out: dict) -> None:
    track, at, _ = read_vint(data, a)
    relative, flags = struct.unpack_from(">hB", data, at)
    kind = flags >> 1 & 3
    step = out["tracks"].get(track, {}).get("default_duration", 0)
    for n, (start, size) in enumerate(unlace(data, at + 3, b, kind)):
        out["packets"].append((track, (base + relative) * scale + n * step, start, size, bool(flags & 0x80) if key is None else key, kind, index))


def _cut(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], sized: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows, cut by the bytes in column `sized`."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[sized] or b"") + 64
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def padded(text: bytes) -> bytes:
    """`text` with bytes 0 up to the next positive multiple of 64."""
    return text.ljust(max(PAD, -(-len(text) // PAD) * PAD), b"\0")


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8, padded, as a Matroska file in a table in the shared folder.

    Null is empty; repeated rows give equal files; ids may be null or repeat. A very long text is one file of one row, written in clusters. An empty table gives
    an empty one. Other columns are ignored, whatever their names.
    """
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            texts = (v.as_buffer().to_pybytes() if v.is_valid else b"" for v in batch.column(1).cast(pa.binary()))
            rows = ((i, len(t), mux(padded(t))) for i, t in zip(batch.column(0), texts))
            yield from _cut(((i.as_py(), n, m) for i, n, m in rows), ["_id", "n_bytes", "media"], [batch.column(0).type, pa.int64(), pa.binary()], 2)

    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    stored = rows.mapInArrow(run, f"_id {kind}, n_bytes long, media binary")
    return materialize(stored, "media", compression="zstd").withColumnRenamed("_id", id_col)


PACKET_SCHEMA = "track int, timestamp_ns long, offset long, size int, keyframe boolean, lacing int, cluster int, cued boolean"


def packet_table(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet of each file, in file order: id, packet number and the columns of PACKET_SCHEMA, and `error`.

    A null or empty file has no rows; one that can't be parsed has a single row with `error` set, the rest null. Only the id and
    the media column are read, whatever else the table holds. Rows that repeat give their packets as often as they come. An empty table gives an empty result.
    """
    kind = dict(df.dtypes)[id_col]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_()]
    names = ["_id", "packet", *(c.split()[0] for c in PACKET_SCHEMA.split(", ")), "error"]

    def rows(batch):
        for i, m in zip(batch.column(0).to_pylist(), batch.column(1)):
            if m.is_valid and len(m.as_buffer()):
                try:
                    for n, p in enumerate(parse(m.as_buffer().to_pybytes())["packets"]):
                        yield (i, n, *p, None)
                except (ValueError, IndexError, struct.error) as e:
                    yield (i, None, *[None] * 8, str(e))

    def run(batches):
        for batch in batches:
            held = []
            for row in rows(batch):
                held.append(row)
                if len(held) == 50_000:
                    yield _rows_batch(held, names, [batch.column(0).type, pa.int32(), *types, pa.string()])
                    held = []
            if held:
                yield _rows_batch(held, names, [batch.column(0).type, pa.int32(), *types, pa.string()])

    out = df.select(F.col(id_col).alias("_id"), F.col(media_col).alias("_m")).mapInArrow(run, f"_id {kind}, packet int, {PACKET_SCHEMA}, error string")
    return out.withColumnRenamed("_id", id_col)


def _rows_batch(held: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def feature(samples: np.ndarray, parsed: dict) -> str:
    """Packets, cues, duration and simple statistics of the samples, as text."""
    centred = samples.astype(np.int16) - 128
    crossings = int(np.count_nonzero(np.diff(centred >= 0))) if len(centred) > 1 else 0
    total, squares = int(centred.sum(dtype=np.int64)), int((centred.astype(np.int32) ** 2).sum(dtype=np.int64))
    lacings = np.bincount([p[5] for p in parsed["packets"]], minlength=4).tolist()
    return (
        f"packets={len(parsed['packets'])};clusters={len(parsed['clusters'])};cues={len(parsed['cues'])};laced={'/'.join(map(str, lacings))};"
        f"ms={len(samples) * 1000 // RATE};mean={total / max(1, len(samples)):.4f};rms={(squares / max(1, len(samples))) ** 0.5:.4f};crossings={crossings}"
    )


def read_features(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per file: id, the payload's size and digests from its packets, the file's own, and `feature`.

    A null file counts as empty: no packets, payload_bytes 0. A file that can't be parsed fails the job; `packet_table` reports such files.
    Rows that repeat come as often as they are. An empty table gives an empty result.
    """
    kind = dict(df.dtypes)[id_col]
    names = ["_id", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            out = []
            for i, m in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = m.as_buffer().to_pybytes() if m.is_valid else b""
                parsed = parse(data)
                payload = b"".join([data[p[2] : p[2] + p[3]] for p in parsed["packets"]])
                out.append((i, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(data), hashlib.sha256(data).hexdigest(), feature(np.frombuffer(payload, np.uint8), parsed)))
            if out:
                yield _rows_batch(out, names, [batch.column(0).type, *types])

    schema = f"_id {kind}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return df.select(F.col(id_col).alias("_id"), F.col(media_col).alias("_m")).mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def _with_sizes(stored: DataFrame) -> DataFrame:
    """read_features for stored texts, with n_bytes beside the id."""
    out = read_features(stored.select(F.struct("doc_id", "n_bytes").alias("k"), "media"), "k")
    return out.select("k.doc_id", "k.n_bytes", *out.columns[1:])


def op9_media_matroska(spark, sf_dir: str) -> DataFrame:
    return _with_sizes(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
