"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

The texts are read and normalised once, into a slim table of a row per document: length, prefix hash and SHA-256. Each level then
keeps only the rows whose key occurs more than once, by a bitmap that is broadcast; collisions in a bitmap only let a row
through to the next level, and the last one decides by the digest of the whole text. No text is shuffled: what
crosses the network is keys, counts and 32-byte digests, summed map-side first, so a group that holds a
third of all rows costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_bits, collapse_spaces, flag_in_bitmap, key_bitmap, materialize, once_each, row_key, without_rows

PREFIX_CHARS = 64


def _repeated(keyed: DataFrame, key: str) -> DataFrame:
    return keyed.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")


def slim(df: DataFrame, id_col: str, text_col: str, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """(_id, _row, _k1, _k2, _digest): hashes of length, of length and prefix, and the digest of each normalised text, written to the shared folder."""
    rows = df.select(F.col(id_col).alias("_id"), row_key(F.col(id_col), F.col(text_col)).alias("_row"), collapse_spaces(F.col(text_col)).alias("_norm"))
    return materialize(
        rows.select(
            "_id",
            "_row",
            F.xxhash64(F.length("_norm")).alias("_k1"),
            F.xxhash64(F.length("_norm"), F.substring("_norm", 1, prefix_chars)).alias("_k2"),
            F.unhex(F.sha2(F.col("_norm").cast("binary"), 256)).alias("_digest"),
        ),
        "exact-slim",
    )


def _refine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that share neither length nor prefix with another, and rows that may; bitmaps of the keys that repeat, level by level."""
    bits = bitmap_bits(rows.count())
    lengths = key_bitmap(_repeated(rows.select("_k1"), "_k1"), "_k1", bits)
    by_length = flag_in_bitmap(rows, "_k1", lengths, "_same_length", bits)
    prefixes = key_bitmap(_repeated(by_length.filter("_same_length").select("_k2"), "_k2"), "_k2", bits)
    # a prefix key holds the length, so rows that the first level ruled out are ruled out again
    marked = flag_in_bitmap(rows, "_k2", prefixes, "_survives", bits)
    return marked.filter("NOT _survives"), marked.filter("_survives")


def _groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _row, _keep, _n, _digest) of each row."""
    alone, survivors = _refine(slim(df, id_col, text_col))
    groups = (
        survivors.groupBy("_digest")
        .agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
        # another expression than the grouping key: both join sides get an exchange that AQE can split
        .select(F.expr("concat(_digest, X'')").alias("_of"), "_keep", "_n")
    )
    found = survivors.join(groups, F.expr("concat(_digest, X'')") == F.col("_of")).select("_id", "_row", "_keep", "_n", "_digest")
    return alone.select("_id", "_row", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_n"), "_digest").unionByName(found)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, and text_sha256 (of the normalised text).

    Texts are equal when they are identical after each run of white space became one space; the smallest
    id of a group stays.

    Null text counts as empty, and empty texts equal each other. A null id is never the smallest unless all of the group
    are null. Rows that repeat an id and its text stay as often as they came, and each counts towards group_size. A text of any length is one
    value of one row, read whole. An empty table gives an empty result. Other columns of `df` are ignored, whatever their names.
    """
    return _groups(df, id_col, text_col).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` that stay, with their columns, whatever their names: one of each group of equal texts.

    Decisions hold for an id with its text: of rows that repeat an id with different texts, each goes or stays by its own text; of rows
    that repeat both, one stays. A row with a null id goes if another row has its text, and one such row stays if there is no other.
    """
    marks = materialize(_groups(df, id_col, text_col).filter("_n > 1").select("_id", "_row", F.col("_id").eqNullSafe(F.col("_keep")).alias("_kept"), "_digest"), "exact-marks")
    out = without_rows(df, id_col, text_col, marks.filter("NOT _kept").select("_id", "_row"))
    # rows that repeat the id that stays; texts that differ in white space alone count as the same
    again = marks.filter("_kept").groupBy("_id", "_digest").agg(F.count(F.lit(1)).alias("_times"), F.min("_row").alias("_row")).filter("_times > 1")
    again = materialize(again.select("_id", "_row", "_digest"), "exact-again")
    if again.isEmpty():
        return out
    other = marks.filter("_kept").join(again.select(F.col("_id").alias("_i"), F.col("_digest").alias("_d"), F.col("_row").alias("_first")), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_digest") == F.col("_d")))
    other = materialize(other.filter("_row != _first").select("_id", "_row"), "exact-again")
    return once_each(without_rows(out, id_col, text_col, other), id_col, text_col, again.select("_id", "_row"))


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op6_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
}
