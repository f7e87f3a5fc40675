"""Hard negatives for embedding training, by a secondary sort of scored pairs.

Anchors are a stated set of rows, which are scored against all rows in blocks: rows and anchors are packed into matrices of bounded size, each block of rows meets each block of
anchors, and a matrix product gives the scores. Of a pair of blocks only what may count is put out: in a first pass the best `positives` rows of an anchor's own label, in
a second one, for each of the anchor's positives, the best `negatives` rows of other labels in the positive's window of scores. The best of all are among the best of each block, so
nothing is lost, and an anchor sends a bounded number of pairs per block.

Pairs are packed into binary keys (anchor, descending score, kind, id), dealt out by anchor and sorted by the key within the partition: what `repartitionAndSortWithinPartitions` is for pair RDDs, on
DataFrames. An iterator goes through the sorted pairs: a positive opens its window, a negative goes to the windows that are open and not full, and no more than these windows is held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, materialize, scanned_rows

#: Rows and anchors in a block.
BLOCK_ROWS, BLOCK_ANCHORS = 4096, 256
#: Blocks of anchors that a task holds at once: 5 MB of 64 components.
SENT_BLOCKS = 64
_KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
_SIGN = np.uint64(1 << 63)
_POSITIVE, _NEGATIVE = 0, 1
_PAIR = "_anchor long, _key binary"
_BLOCK = "_dim int, _n int, _ids binary, _labels binary, _values binary, _windows binary"


def pack_keys(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> np.ndarray:
    """Binary keys whose byte order is by anchor, descending score, kind and id."""
    out = np.zeros(len(ids), _KEY)
    out["anchor"], out["id"] = (x.astype(np.int64).view(np.uint64) ^ _SIGN for x in (anchor, ids))
    out["score"] = ~(score.astype(np.int64).view(np.uint64) ^ _SIGN)
    out["kind"] = kind
    return out


def unpack_keys(column: pa.Array) -> tuple[list, list, list, list]:
    """(anchor, score, kind, id) of each key."""
    keys = np.frombuffer(b"".join(column.to_pylist()), _KEY)
    anchor, ids = ((keys[f].astype(np.uint64) ^ _SIGN).view(np.int64).tolist() for f in ("anchor", "id"))
    return anchor, (~keys["score"].astype(np.uint64) ^ _SIGN).view(np.int64).tolist(), keys["kind"].tolist(), ids


def _pairs_batch(*parts: np.ndarray) -> pa.RecordBatch:
    keys = np.frombuffer(b"".join(p.tobytes() for p in parts), _KEY)  # np.concatenate would swap the bytes
    ends = pa.py_buffer((np.arange(len(keys) + 1) * _KEY.itemsize).astype(np.int32).tobytes())
    packed = pa.Array.from_buffers(pa.binary(), len(keys), [None, ends, pa.py_buffer(keys.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array((keys["anchor"].astype(np.uint64) ^ _SIGN).view(np.int64)), packed], ["_anchor", "_key"])


def _pack(scale: float, rows: int):
    """Blocks of at most `rows` rows (_id, _label, _vector, _windows) of one length of vectors, in order of id; equal rows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            vectors, windows = batch.column(2), batch.column(3).to_pylist()
            size = np.diff(vectors.offsets.to_numpy())
            flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * scale)
            first = np.cumsum(size) - size
            for dim in np.unique(size):
                own = np.flatnonzero(size == dim)
                for at in range(0, len(own), rows):
                    some = own[at : at + rows]
                    some = some[np.lexsort((labels[some], ids[some]))]
                    values = flat[first[some][:, None] + np.arange(dim)[None, :]] if dim else np.zeros((len(some), 0))
                    again = {}
                    keep = [j for j in range(len(some)) if again.setdefault((int(ids[some[j]]), int(labels[some[j]]), values[j].tobytes()), j) == j]
                    some, values = some[keep], values[keep]
                    small = np.abs(values).max(initial=0) < 1 << 24
                    wide = max((len(windows[j]) for j in some), default=0)
                    limits = np.array([windows[j] + windows[j][-1:] * (wide - len(windows[j])) for j in some], np.int64)
                    yield pa.RecordBatch.from_pydict({
                        "_dim": pa.array([dim], pa.int32()), "_n": pa.array([len(some)], pa.int32()),
                        "_ids": [ids[some].astype(np.int64).tobytes()], "_labels": [labels[some].astype(np.int64).tobytes()],
                        "_values": [values.astype(np.float32 if small else np.float64).tobytes()], "_windows": [limits.tobytes()],
                    })

    return run


def _packed(rows: DataFrame, scale: float, size: int, tag: str) -> DataFrame:
    if "_windows" not in rows.columns:
        rows = rows.withColumn("_windows", F.array().cast("array<bigint>"))
    return materialize(rows.select("_id", "_label", "_vector", "_windows").mapInArrow(_pack(scale, size), _BLOCK), tag)


def _met(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each block of anchors beside each block of rows, which stay where they lie: each of their partitions meets parts of `SENT_BLOCKS` blocks of anchors.

    A product gives a pair of blocks at a time. A hash or loop join would first copy a block of rows for every block of anchors, and anchors dealt to each block by a number would be
    broadcast, once for each block, at the size of the anchors alone. Blocks of other lengths of vectors meet, too, and are passed over: an equality of lengths would deal all rows out by them.
    """
    names = ["_dim", "_n", "_ids", "_labels", "_values", "_windows"]
    sent = anchors.select(*[F.col(c).alias(f"{c}_a") for c in names]).repartition(max(1, -(-anchors.count() // SENT_BLOCKS)))
    return blocks.select(*[c for c in names if c != "_windows"]).crossJoin(sent.hint("shuffle_replicate_nl"))


def _matrix(n: int, dim: int, data: bytes) -> np.ndarray:
    kind = np.float64 if dim and len(data) == 8 * n * dim else np.float32
    return np.frombuffer(data, kind).astype(float).reshape(n, dim)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers: by doubles where they hold every partial sum, by Python's integers beyond."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return whole(a) @ whole(b).T


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, earlier ones first where they are equal."""
    if len(score) > 4 * k:
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return near[np.argsort(-score[near], kind="stable")][:k]
    return np.argsort(-score, kind="stable")[:k]


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple]:
    for r in batch.to_pylist():
        dim = r["_dim"]
        if dim != r["_dim_a"]:
            continue
        rows = (np.frombuffer(r["_ids"], np.int64), np.frombuffer(r["_labels"], np.int64), _matrix(r["_n"], dim, r["_values"]))
        anchors = (np.frombuffer(r["_ids_a"], np.int64), np.frombuffer(r["_labels_a"], np.int64), _matrix(r["_n_a"], dim, r["_values_a"]))
        yield rows, anchors, np.frombuffer(r["_windows_a"], np.int64)


def _best_positives(k: int):
    """Of each pair of blocks, an anchor's best k other rows of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (ids, labels, values), (a_ids, a_labels, a_values), _ in _blocks(batch):
                out = []
                for label in np.intersect1d(labels, a_labels):
                    own, of = np.flatnonzero(labels == label), np.flatnonzero(a_labels == label)
                    for a, score in zip(of, exact_scores(a_values[of], values[own])):
                        other = own[ids[own] != a_ids[a]]
                        score = score[ids[own] != a_ids[a]]
                        best = _best(score, k)
                        out.append(pack_keys(np.full(len(best), a_ids[a]), score[best], _POSITIVE, ids[other[best]]))
                if out:
                    yield _pairs_batch(*out)

    return run


def _best_negatives(k: int, low: int):
    """Of each pair of blocks, for each positive of an anchor, the best k rows of another label in its window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (ids, labels, values), (a_ids, a_labels, a_values), windows in _blocks(batch):
                out, scores = [], exact_scores(a_values, values)
                for a, limits in enumerate(windows.reshape(len(a_ids), -1)):
                    score = scores[a]
                    near = np.flatnonzero((labels != a_labels[a]) & (score <= int(limits.max())) & (100 * score >= low * int(limits.min())))
                    near = near[np.argsort(-score[near], kind="stable")]
                    down, taken = -score[near], np.zeros(len(near), bool)
                    for top in set(limits.tolist()):
                        at = int(np.searchsorted(down, -top, "left"))
                        taken[at : at + k] |= -down[at : at + k] * 100 >= low * top
                    near = near[taken]
                    out.append(pack_keys(np.full(len(near), a_ids[a]), score[near], _NEGATIVE, ids[near]))
                if out:
                    yield _pairs_batch(*out)

    return run


class Windows:
    """The stream of an anchor's pairs in order: positives open windows, negatives fill them. Holds `positives` windows at most."""

    def __init__(self, positives: int, negatives: int, low: int):
        self.positives, self.negatives, self.low = positives, negatives, low
        self.last: tuple | None = None
        self.open: list[list] = []
        self.seen = 0

    def take(self, anchor: int, score: int, kind: int, row: int) -> Iterator[tuple]:
        """What a pair gives: (positive id, rank, negative id, positive score, negative score); a positive itself has no negative and rank 0."""
        pair = (anchor, score, kind, row)
        if pair == self.last:
            return
        if self.last is None or self.last[0] != anchor:
            self.open, self.seen = [], 0
        self.last = pair
        if kind == _POSITIVE:
            if self.seen < self.positives:
                self.seen += 1
                self.open.append([row, score, 0])
                yield row, 0, None, score, None
            return
        # scores only fall: a window that is full or left behind stays so
        self.open = [w for w in self.open if w[2] < self.negatives and self.low * w[1] <= 100 * score]
        for w in self.open:
            if score <= w[1]:
                w[2] += 1
                yield w[0], w[2], row, w[1], score


_FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _streamed(pairs: DataFrame, positives: int, negatives: int, low: int) -> DataFrame:
    """The secondary sort of packed pairs, and the iterator over it."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(positives, negatives, low)
        for batch in batches:
            out = [(anchor, *x) for anchor, score, kind, row in zip(*unpack_keys(batch.column(1))) for x in windows.take(anchor, score, kind, row)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], [c.split()[0] for c in _FOUND.split(", ")])

    return pairs.repartition("_anchor").sortWithinPartitions("_key").mapInArrow(run, _FOUND)


def mine_hard_negatives(
    df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0, positives: int = 5, negatives: int = 5, low: int = 80
) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Components become floor(`scale` * x); a score is the exact inner product of these integers (one beyond 64 bits is an error). An anchor's positives are its best
    `positives` other rows of the same label, higher scores first, then smaller ids. The negatives of a positive are the best `negatives` rows of other labels whose score is from
    `low` per cent of the positive's up to the positive's; of a negative score there are none.

    Rows without id, label or vector, or with a component that is null or not finite, take no part. Vectors of different lengths don't meet; empty ones do, with score 0. An id
    that repeats is still one anchor, with its smallest label and vector, and never its own positive; rows of one id with equal scores count once. Without rows or anchors
    the result is empty. Other columns of `df` are ignored, whatever their names.
    """
    if not (0 < positives <= 64 and negatives > 0 and 0 <= low <= 100):
        raise ValueError("1 to 64 positives, at least a negative, and a window of 0 to 100 per cent are needed")
    # rows hold whole vectors, and later whole blocks
    with arrow_rows(df.sparkSession, BLOCK_ROWS):
        blocks, anchors = _tables(df, is_anchor, id_col, vector_col, label_col, scale)
    with arrow_rows(df.sparkSession, 4), scanned_rows(df.sparkSession, 4):
        pairs = _pairs(blocks, anchors, scale, positives, negatives, low)
    return _streamed(pairs, positives, negatives, low).filter("rank > 0")


def _tables(df: DataFrame, is_anchor: Column, id_col: str, vector_col: str, label_col: str, scale: float) -> tuple[DataFrame, DataFrame]:
    """Written tables: blocks of all rows that take part, and the anchors."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{label_col}`").cast("long").alias("_label"), F.col(f"`{vector_col}`").cast("array<double>").alias("_vector"), is_anchor.alias("_is_anchor"))
    odd = F.exists("_vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter("_id IS NOT NULL AND _label IS NOT NULL AND _vector IS NOT NULL").filter(~odd)
    anchors = rows.filter("_is_anchor").groupBy("_id").agg(F.min(F.struct("_label", "_vector")).alias("_r")).select("_id", "_r.*")
    return _packed(rows, scale, BLOCK_ROWS, "hard-rows"), materialize(anchors, "hard-anchors")


def _pairs(blocks: DataFrame, anchors: DataFrame, scale: float, positives: int, negatives: int, low: int) -> DataFrame:
    """A written table of packed pairs: the positives of each anchor, and the best negatives of each block."""
    if blocks.isEmpty() or anchors.isEmpty():
        return blocks.sparkSession.createDataFrame([], _PAIR)
    best = _met(_packed(anchors, scale, BLOCK_ANCHORS, "hard-anchor-blocks"), blocks).mapInArrow(_best_positives(positives), _PAIR)
    found = materialize(_streamed(best, positives, negatives, low), "hard-positives")
    windows = found.groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score")).alias("_windows"))
    windowed = anchors.join(windows, F.col("_id") == F.col("anchor_id"))
    near = _met(_packed(windowed, scale, BLOCK_ANCHORS, "hard-window-blocks"), blocks).mapInArrow(_best_negatives(negatives, low), _PAIR)
    opened = found.select("anchor_id", "positive_score", "positive_id").mapInArrow(_opened, _PAIR)
    return materialize(opened.unionByName(near), "hard-pairs")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        anchor, score, ids = (batch.column(i).to_numpy() for i in range(3))
        yield _pairs_batch(pack_keys(anchor, score, _POSITIVE, ids))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


SQL = {
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INT AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5
"""
}
