"""Language identification as a mixture: each document has proportions over languages.

Training counts hashed byte n-grams per language; every text then gets its proportions by expectation-maximisation over
its distinct n-grams, with languages added one by one while the penalised likelihood grows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import U, mix64, slices

N = 4
BUCKETS = 1 << 15
#: Rows to learn from, at most about so many, chosen by a hash of the id.
MAX_TRAIN_ROWS = 60_000
SMOOTHING = 0.5
#: A language is added if it raises the log-likelihood by more than this times log(n-grams).
PENALTY = 8.0
#: A text's language can't be told if its mixture makes its n-grams less likely than equal chances for all buckets, by this much per n-gram (natural logarithm).
UNTOLD = -2.0
#: Texts with fewer n-grams aren't judged by their likelihood.
MIN_NGRAMS = 20
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")

# letters in lower case, bytes of other alphabets as they are, all else as space
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def ngram_buckets(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The buckets of the n-grams of each text: as many as it has bytes, from the byte before each, with spaces put around.

    Those of text i are at offsets[i] + i (N - 1) and after; so many spaces lie between two texts that no n-gram has bytes of both.
    """
    size = np.diff(offsets)
    b = np.full(len(data) + (N - 1) * len(size) + 1, 32, np.uint32)
    b[np.arange(1, len(data) + 1) + np.repeat((N - 1) * np.arange(len(size)), size)] = _FOLD[data]
    code = b[: len(b) - N + 1].copy()
    for j in range(1, N):
        code = (code << np.uint32(8)) | b[j : len(b) - N + 1 + j]
    return (mix64(code.astype(U)) >> U(64 - 15)).astype(np.int32)


def document_counts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their counts, per text; n-grams don't cross texts, so equal texts have equal counts."""
    for _, _, data, offsets in slices(column):
        grams = ngram_buckets(data, offsets)
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
            counts = np.bincount(grams[a + i * (N - 1) : b + i * (N - 1)], minlength=BUCKETS)
            at = np.flatnonzero(counts)
            yield at, counts[at].astype(np.float64)


def _count_by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, (at, counts) in zip(batch.column(0).to_pylist(), document_counts(batch.column(1))):
            own = total.setdefault(lang, np.zeros(BUCKETS))
            own[at] += counts
    for lang, own in total.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at].astype(np.int64))], ["lang", "bucket", "n"]
        )


class Model:
    """Languages and their n-gram probabilities: languages x BUCKETS floats, whatever the training data."""

    def __init__(self, languages: list[str], probabilities: np.ndarray):
        self.languages, self.p, self.log_p = languages, probabilities, np.log(probabilities)

    def proportions(self, at: np.ndarray, counts: np.ndarray) -> dict[int, float]:
        """The language set and its proportions."""
        total = counts.sum()
        if not self.languages or total == 0:
            return {}
        single = self.log_p[:, at] @ counts
        chosen = [int(np.argmax(single))]
        best, share = float(single[chosen[0]]), np.ones(1)
        p = self.p[:, at]
        penalty = PENALTY * np.log(total + 1)
        while len(chosen) < len(self.languages):
            now = share @ p[chosen]
            # the gain of a little of each other language, to first order, orders the candidates
            slope = (p / now) @ counts / total
            slope[chosen] = -np.inf
            rest = np.argsort(-slope)
            found = None
            for c in rest[: len(self.languages) - len(chosen)]:
                if slope[c] <= 1:  # concave: no mixture with it is likelier
                    break
                tried, value = self._em(p[[*chosen, c]], counts, np.append(share * 0.9, 0.1))
                if value - best > penalty and (found is None or value > found[2]):
                    found = (int(c), tried, value)
            if found is None:
                break
            chosen.append(found[0])
            share, best = found[1], found[2]
        return dict(zip(chosen, share.tolist()))

    def knows(self, at: np.ndarray, counts: np.ndarray) -> bool:
        """Whether the text is likely enough under its mixture: `UNTOLD` or more per n-gram against a background of equal chances."""
        total = counts.sum()
        if not self.languages or total < MIN_NGRAMS:
            return True
        share = self.proportions(at, counts)
        mixed = np.array(list(share.values())) @ self.p[np.ix_(list(share), at)]
        return bool(np.log(mixed * BUCKETS) @ counts >= UNTOLD * total)

    @staticmethod
    def _em(p: np.ndarray, counts: np.ndarray, share: np.ndarray, steps: int = 40) -> tuple[np.ndarray, float]:
        total = counts.sum()
        for _ in range(steps):
            weighted = share[:, None] * p
            new = (weighted / weighted.sum(0)) @ counts / total
            moved = np.abs(new - share).max()
            share = new
            if moved < 1e-4:
                break
        return share, float(np.log(share @ p) @ counts)


def train(df: DataFrame, text_col: str, lang_col: str, id_col: str, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Learn from the rows with a language; of more than `max_rows`, about so many by a hash of the id."""
    rows = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = rows.count()
    if n > max_rows:
        rows = rows.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_003)) < int(1_000_003 * max_rows / n))
    found = (
        rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
        .mapInArrow(_count_by_language, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names = found["lang"].to_numpy(zero_copy_only=False)
    languages = sorted(set(names))
    counts = np.zeros((len(languages), BUCKETS))
    np.add.at(counts, (np.searchsorted(languages, names) if languages else np.zeros(0, int), found["bucket"].to_numpy()), found["n"].to_numpy())
    counts += SMOOTHING
    return Model(languages, counts / counts.sum(1, keepdims=True))


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, parts = [], [], []
            texts = batch.column(1)
            for text, (at, counts) in zip(texts, document_counts(texts)):
                share = model.proportions(at, counts) if text.is_valid and _LETTER.search(text.as_py()) else {}
                ranked = sorted(share.items(), key=lambda x: (-x[1], x[0]))
                lang.append(model.languages[ranked[0][0]] if ranked else UNDETERMINED)
                score.append(min(1.0, ranked[0][1]) if ranked else 0.0)
                parts.append([{"lang": model.languages[i], "share": s} for i, s in ranked])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(parts, kind)],
                ["_id", "lang_pred", "score", "languages"],
            )

    return run


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score (share of that language) and languages (the set, with shares).

    Null texts and texts without a letter are `und` with score 0 and no languages, as is everything if the model has
    learned none. Rows that repeat each other get equal rows; ties go to the language first in code-point order. A text of any length is one
    document, counted whole. An empty table gives an empty result. Only the id and the text are read.
    """
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(_predict(model), f"_id {kind}, lang_pred string, score double, languages array<struct<lang:string,share:double>>")
    return out.withColumnRenamed("_id", id_col)


def held_out(row_id):
    """Whether a document is kept from training; false for a null id."""
    return F.coalesce(F.crc32(row_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_known(df: DataFrame) -> DataFrame:
    """The rows of `df` (doc_id, text, lang and any others) whose language can be told, with their columns; learned from all rows that have a language.

    Null texts and texts without a letter go. Of the others, a text goes if the likeliest mixture of the learned languages fits it worse than a
    background model in which all n-grams have equal chances (`Model.knows`), such as one in a script that no labelled row has. Texts of fewer than `MIN_NGRAMS`
    n-grams stay, as do all if no row has a language; the fewer n-grams there are to learn from (some millions are enough), the fewer texts go.
    Rows that repeat each other stay or go together, whatever their ids, null ones too. A text of any length is judged whole. An empty table gives an empty one.
    """
    model = train(df, "text", "lang", "doc_id")
    schema = df.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text"))
            known = [
                bool(t.is_valid and _LETTER.search(t.as_py()) and model.knows(*c)) for t, c in zip(texts, document_counts(texts))
            ]
            yield batch.filter(pa.array(known, pa.bool_()))

    return df.mapInArrow(keep, schema)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(~held_out(F.col("doc_id"))), "text", "lang", "doc_id")
    out = identify(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
    shares = F.transform("languages", lambda x: F.concat(x["lang"], F.lit(":"), F.round(x["share"], 4).cast("string")))
    return out.select("doc_id", "held_out", "lang_pred", "score", F.concat_ws(",", shares).alias("languages"))
