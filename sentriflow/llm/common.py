"""Helpers shared by the corpus operators: shared storage, text columns and bounded key bitmaps."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_dir, shared_dir
from ..storage import written as materialize

#: White space that separates words: space and \x09-\x0D.
SPACES = "\t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Bits of a key bitmap: `BITS_PER_KEY` for each key, within these bounds (512 KB and 32 MB).
MIN_BITS, MAX_BITS = 1 << 22, 1 << 28
BITS_PER_KEY = 32
_SLICE = 1 << 15
#: Partitions over which lists of files are dealt out, at most.
MAX_TASKS = 20_000


def spread(files: DataFrame) -> DataFrame:
    """A list of files (a written table) dealt out to a task each, or evenly to `MAX_TASKS`; left to itself, Spark would put short rows into one task."""
    return files.repartition(max(1, min(MAX_TASKS, files.count())))


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def arrow_rows(spark: SparkSession, rows: int) -> AbstractContextManager[None]:
    """Within it, tasks hand so many rows at a time to Python: less memory where a row holds whole texts or sets."""
    return _set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def scanned_rows(spark: SparkSession, rows: int) -> AbstractContextManager[None]:
    """Within it, tasks decode so many rows of a Parquet file at a time: less memory where a row is a block of 1 MB."""
    return _set(spark, "spark.sql.parquet.columnarReaderBatchSize", str(rows))


def unused(df: DataFrame, stem: str) -> str:
    """A column name that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def collapse_spaces(text: Column) -> Column:
    """Text with each run of white space replaced by one space; null counts as empty."""
    flat = F.coalesce(text, F.lit(""))
    for space in SPACES:
        flat = F.replace(flat, F.lit(space), F.lit(" "))
    return F.when(F.instr(flat, "  ") > 0, F.regexp_replace(flat, " {2,}", " ")).otherwise(flat)


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    flat = F.trim(collapse_spaces(text))
    spaces = F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit("")))
    return F.when(flat == "", 0).otherwise(spaces + 1).cast("long")


def bitmap_bits(keys: int) -> int:
    """Bits of a bitmap for so many keys: enough that 3 % of other keys pass it; at `MAX_BITS` more do, which costs time alone."""
    return min(MAX_BITS, max(MIN_BITS, 1 << max(1, BITS_PER_KEY * keys - 1).bit_length()))


def _bit(key: Column, bits: int) -> Column:
    return F.pmod(key, F.lit(bits)).cast("int")


def key_bitmap(keys: DataFrame, key: str, bits: int = MIN_BITS) -> DataFrame:
    """A bitmap over the hashed long column `key`: bits / 32,768 rows of 4 KB, 32 MB at most, so it may be broadcast."""
    bit = _bit(F.col(key), bits)
    return keys.groupBy(F.shiftright(bit, 15).alias("_slice")).agg(
        F.bitmap_construct_agg(bit.bitwiseAND(_SLICE - 1).cast("long")).alias("_bits")
    )


def flag_in_bitmap(df: DataFrame, key: str, bitmap: DataFrame, flag: str, bits: int = MIN_BITS) -> DataFrame:
    """Add the boolean `flag`: whether the bit of `key` is set in a bitmap of so many bits.

    False is certain absence; true may be a collision, so an exact step must follow.
    """
    pos = _bit(F.col(key), bits).bitwiseAND(_SLICE - 1)
    byte = F.conv(F.hex(F.expr("substring(_bits, _pos div 8 + 1, 1)")), 16, 10).cast("int")
    return (
        df.withColumns({"_slice": F.shiftright(_bit(F.col(key), bits), 15), "_pos": pos})
        .join(F.broadcast(bitmap), "_slice", "left")
        .withColumn(flag, F.coalesce(F.getbit(byte, F.pmod(F.col("_pos"), F.lit(8))) == 1, F.lit(False)))
        .drop("_slice", "_pos", "_bits")
    )


def row_key(row_id: Column, text: Column) -> Column:
    """A hash that tells apart rows that repeat an id with other texts."""
    return F.xxhash64(row_id.cast("string"), text)


def split_by_keys(df: DataFrame, id_col: str, text_col: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`df` in two: rows that aren't in `keys` (_id, _row) for certain, with their columns, and those that may be, with two columns more, named second.

    `keys` is a written table. A bitmap of its keys keeps the texts of most rows from being shuffled by the join that follows.
    """
    bits = bitmap_bits(keys.count())
    inside = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_in"), row_key(df[id_col], df[text_col]).alias("_row"))
    flagged = flag_in_bitmap(inside, "_row", key_bitmap(keys.select("_row"), "_row", bits), "_maybe", bits)
    return flagged.filter("NOT _maybe").select("_in.*"), flagged.filter("_maybe").select("_in", F.col(f"_in.`{id_col}`").alias("_key"), "_row")


def without_rows(df: DataFrame, id_col: str, text_col: str, keys: DataFrame) -> DataFrame:
    """The rows of `df`, with their columns, whose id and text are not those of a row of `keys` (_id, _row: a written table)."""
    rest, maybe = split_by_keys(df, id_col, text_col, keys)
    gone = keys.select(F.col("_id").alias("_gone"), F.expr("_row ^ 1").alias("_gone_row"))
    kept = maybe.join(gone, F.col("_key").eqNullSafe(F.col("_gone")) & (F.expr("_row ^ 1") == F.col("_gone_row")), "left_anti")
    return rest.unionByName(kept.select("_in.*"))


def once_each(df: DataFrame, id_col: str, text_col: str, keys: DataFrame) -> DataFrame:
    """`df` with one row for each id and text of `keys` (_id, _row: a written table), and all of its other rows."""
    rest, maybe = split_by_keys(df, id_col, text_col, keys)
    again = keys.select(F.col("_id").alias("_again"), F.expr("_row ^ 1").alias("_again_row"), F.lit(True).alias("_hit")).distinct()
    marked = maybe.join(again, F.col("_key").eqNullSafe(F.col("_again")) & (F.expr("_row ^ 1") == F.col("_again_row")), "left")
    single = marked.filter("_hit").dropDuplicates(["_key", "_row"])
    return rest.unionByName(marked.filter("_hit IS NULL").select("_in.*")).unionByName(single.select("_in.*"))


__all__ = [
    "SPACES", "WORD_PATTERN", "arrow_rows", "bitmap_bits", "collapse_spaces", "flag_in_bitmap", "fresh_dir", "key_bitmap", "materialize", "once_each", "row_key",
    "scanned_rows", "shared_dir", "split_by_keys", "spread", "unused", "without_rows", "word_count",
]
