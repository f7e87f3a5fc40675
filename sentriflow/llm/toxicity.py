"""Toxicity grades by cumulative-link ordinal regression over hashed words.

P(grade > j) = sigmoid(w.x - threshold_j): one weight vector for all thresholds, which stay in order. The expected severity is the sum of
these over the thresholds. x holds log(1 + count) of the words that tell the labels apart; they are
found by counts over the labelled rows.

The labels are 0 or 1. Grades above 0 come from how many telling words a toxic document holds: the thirds of the toxic training rows by that
number are mild, moderate and severe. The labelled rows are in two halves by a hash, and a row is graded by the words that tell the labels of the
other half apart, so no row helps to choose the words that grade it. Severity is therefore weakly supervised; only the step from 0 to 1 is labelled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .text import U, lower_ascii, mix64, prefix_hashes, slices, window_hashes

BUCKETS = 1 << 20
GRADES = 4
#: Labelled rows to learn from: at most so many, by a hash of the id.
MAX_FIT_ROWS = 30_000
#: A word enters the model if so many toxic documents hold it, and so many standard errors more than by chance. There are `BUCKETS` words at most.
MIN_DOCS = 5
MIN_Z = 6.0
FLAG_AT = 0.3

_LETTERS = np.zeros(256, bool)
_LETTERS[97:123] = True
_LETTERS[128:] = True


def word_buckets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, buckets of all words, first word of each row): words are runs of letters, A-Z in lower case."""
    for first, end, data, offsets in slices(column):
        data = lower_ascii(data)
        inside = np.concatenate(([False], _LETTERS[data], [False]))
        starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
        ends = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
        starts, ends = _split(starts, ends, offsets, inside[1:-1])
        h = window_hashes(prefix_hashes(data), starts, ends)
        yield first, end, (mix64(h) >> U(44)).astype(np.int64), np.searchsorted(starts, offsets)


def _split(starts, ends, offsets, inside):
    """Cut the words that cross from one row into the next."""
    at = offsets[1:-1]
    at = at[(at > 0) & (at < len(inside))]
    at = np.unique(at[inside[at] & inside[at - 1]]) if len(at) else at
    return np.union1d(starts, at), np.union1d(ends, at)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for _, _, buckets, first in word_buckets(batch.column(1)):
            found += [np.unique(buckets[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([x for x, _ in found], pa.list_(pa.int64())), pa.array([n for _, n in found], pa.list_(pa.int64()))],
            ["toxic", "words", "counts"],
        )


def _entries(mask):
    """The words of each row whose bit is set in `mask` (an array of BUCKETS), with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
            row = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            keep = np.flatnonzero(mask.value[words])
            edge = np.concatenate(([0], np.cumsum(np.bincount(row[keep], minlength=batch.num_rows)))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(edge), pa.array(x[keep])) for x in (words, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["toxic", "half", "words", "counts"])

    return run


class Model:
    """Chosen buckets with weights, and thresholds in ascending order."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.buckets, self.weights, self.thresholds = buckets, weights, thresholds
        order = np.argsort(buckets)
        self.buckets, self.weights = buckets[order], weights[order]

    def exceed(self, signal: np.ndarray) -> np.ndarray:
        """P(grade > j) for each row and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - signal[:, None], -40, 40)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, x: np.ndarray, grade: np.ndarray, features: int, l2: float = 1e-3, steps: int = 600):
    """Weights and thresholds of most likelihood less an L2 penalty, by Adam on the sparse entries (rows, cols, x)."""
    n = len(grade)
    base = np.array([(np.sum(grade > j) + 0.5) / (n + 1.0) for j in range(GRADES - 1)])
    start = np.log((1 - base) / base)
    # threshold_0, then logs of the gaps
    par = np.concatenate((np.zeros(features), start[:1], np.log(np.maximum(np.diff(start), 0.05))))
    m, v = np.zeros_like(par), np.zeros_like(par)
    for step in range(1, steps + 1):
        w, gaps = par[:features], np.exp(par[features + 1 :])
        theta = par[features] + np.concatenate(([0.0], np.cumsum(gaps)))
        signal = np.bincount(rows, weights=w[cols] * x, minlength=n)
        above = 1 / (1 + np.exp(np.clip(theta[None, :] - signal[:, None], -40, 40)))
        edges = np.concatenate((np.ones((n, 1)), above, np.zeros((n, 1))), axis=1)
        p = np.maximum(np.take_along_axis(edges, grade[:, None], 1) - np.take_along_axis(edges, grade[:, None] + 1, 1), 1e-12)[:, 0]
        slope = np.concatenate((np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))), axis=1)
        hi, lo = np.take_along_axis(slope, grade[:, None], 1)[:, 0], np.take_along_axis(slope, grade[:, None] + 1, 1)[:, 0]
        by_signal = -(hi - lo) / p / n
        by_theta = np.zeros(GRADES - 1)
        for j in range(GRADES - 1):
            by_theta[j] = (np.sum((hi / p)[grade == j + 1]) - np.sum((lo / p)[grade == j])) / n
        grad = np.concatenate((np.bincount(cols, weights=by_signal[rows] * x, minlength=features) + l2 * w, np.zeros(GRADES - 1)))
        grad[features] = by_theta.sum()
        grad[features + 1 :] = np.cumsum(by_theta[::-1])[::-1][1:] * gaps
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        par = par - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    theta = par[features] + np.concatenate(([0.0], np.cumsum(np.exp(par[features + 1 :]))))
    return par[:features], theta


def _telling(found: DataFrame) -> tuple[np.ndarray, list[np.ndarray], float, int]:
    """The words that tell the labels apart, in all rows and in each half (masks of BUCKETS), the share of toxic rows, and the rows."""
    sums = found.groupBy("half").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("n1")).collect()
    words = found.select("toxic", "half", F.explode("words").alias("word")).groupBy("half", "word").agg(F.count(F.lit(1)).alias("df"), F.sum("toxic").alias("df1"))
    # two rows per bucket at most, whatever the corpus
    held = words.filter("df1 > 0").toArrow()
    df, df1 = np.zeros((2, BUCKETS)), np.zeros((2, BUCKETS))
    at = held["half"].to_numpy(), held["word"].to_numpy()
    df[at], df1[at] = held["df"].to_numpy(), held["df1"].to_numpy()
    n, n1 = ([sum(r[c] for r in sums if r["half"] == h) for h in range(2)] for c in ("n", "n1"))

    def mask(df, df1, n, n1):
        base = (n1 + 0.5) / (n + 1.0)
        z = (df1 - df * base) / np.sqrt(np.maximum(df * base * (1 - base), 1e-12))
        return (df1 >= MIN_DOCS) & (z >= MIN_Z)

    halves = [mask(df[h], df1[h], n[h], n1[h]) for h in range(2)]
    return mask(df.sum(0), df1.sum(0), sum(n), sum(n1)), halves, (sum(n1) + 0.5) / (sum(n) + 1.0), sum(n)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_FIT_ROWS) -> Model:
    """Learn from at most `max_rows` labelled documents, chosen by a hash of the id. Without toxic rows or words that tell them, severity is the base rate for all.

    Of rows that repeat an id in `labels`, the most toxic one counts; documents with the same words count once, as toxic if one of them is. Null labels
    and ids are left out. Texts are read whole, null as empty.
    """
    chosen = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label_col).cast("int").alias("toxic"))
        .orderBy(F.xxhash64(F.col("_id").cast("string")), "_id")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_text"))
    # `chosen` has at most max_rows rows of 12 bytes
    rows = texts.join(F.broadcast(chosen), F.col("_i") == F.col("_id")).select("toxic", "_text")
    found = rows.mapInArrow(_features, "toxic int, words array<long>, counts array<long>")
    # copies of one text must not speak as many documents
    found = found.groupBy("words", "counts").agg(F.max("toxic").alias("toxic"))
    found = materialize(found.select("toxic", F.pmod(F.xxhash64("words", "counts"), F.lit(2)).cast("int").alias("half"), "words", "counts"), "toxic-words")
    mask, halves, base, n = _telling(found)
    buckets = np.flatnonzero(mask)
    if len(buckets) == 0:
        return Model(buckets, np.zeros(0), np.log((1 - base) / base) + np.arange(GRADES - 1, dtype=float))
    wanted = found.sparkSession.sparkContext.broadcast(mask | halves[0] | halves[1])
    # at most max_rows rows, with the few words that tell
    entries = found.mapInArrow(_entries(wanted), "toxic int, half int, words array<long>, counts array<long>").toArrow()
    toxic, half = (entries[c].to_numpy() for c in ("toxic", "half"))
    lists = entries["words"].combine_chunks()
    row = np.repeat(np.arange(len(toxic)), lists.value_lengths().to_numpy())
    word, count = lists.flatten().to_numpy(), entries["counts"].combine_chunks().flatten().to_numpy()
    graded = np.where(half[row] == 0, halves[1][word], halves[0][word])
    held = np.bincount(row, weights=count * graded, minlength=len(toxic))
    some = held[(toxic == 1) & (held > 0)]
    cuts = np.quantile(some, [1 / 3, 2 / 3]) if len(some) else np.zeros(2)
    grade = np.where(toxic == 1, 1 + (held > cuts[0]) + (held > cuts[1]), 0)
    own = mask[word]
    weights, thresholds = fit_ordinal(row[own], np.searchsorted(buckets, word[own]), np.log1p(count[own].astype(float)), grade, len(buckets))
    return Model(buckets, weights, thresholds)


def signals(model: Model, column: pa.Array) -> np.ndarray:
    """w.x of each text."""
    out = np.zeros(len(column))
    if len(model.buckets) == 0:
        return out
    index = np.full(BUCKETS, -1, np.int32)
    index[model.buckets] = np.arange(len(model.buckets))
    for first, end, buckets, starts in word_buckets(column):
        at = index[buckets]
        hit = np.flatnonzero(at >= 0)
        row = np.searchsorted(starts, hit, "right") - 1
        key, counts = np.unique(row * len(model.buckets) + at[hit], return_counts=True)
        out[first:end] = np.bincount(key // len(model.buckets), weights=model.weights[key % len(model.buckets)] * np.log1p(counts), minlength=end - first)
    return out


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = model.exceed(signals(model, batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(above.sum(1)), pa.array((above >= 0.5).sum(1).astype(np.int32)), pa.array(above[:, 0])],
                ["_id", "severity", "grade", "p_toxic"],
            )

    return run


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, severity (expected grade, 0 to 3), grade (median), p_toxic = P(grade > 0) and flagged.

    Null, empty and wordless texts have no features and get the severity of such a text, never flagged on their own.
    Repeated rows and equal texts get equal values; a null id is kept. A text of any length is read whole, in one piece. An empty table gives an empty result.
    Other columns are ignored.
    """
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(_score(model), f"_id {kind}, severity double, grade int, p_toxic double")
    return out.select(F.col("_id").alias(id_col), "severity", "grade", "p_toxic", (F.col("severity") >= FLAG_AT).alias("flagged"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, labels))
