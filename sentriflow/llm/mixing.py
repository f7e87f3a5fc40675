"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key -ln(u) / w, with u from a keyed hash of its id and w its quality weight; the documents of
a source in ascending key order are a weighted sample without replacement of every length. A source is taken in
whole epochs first, and the rest of its budget goes to the documents with the smallest keys, by prefix sums.

Prefix sums over a source that holds a third of all rows would need one task. Keys are therefore cut into
`BUCKETS` ranges: sums by range find the one range in which the budget ends, and only the
documents of that range are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, row_key, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKETS = 2048
SEED = "mix-1"
#: Characters that lower a document's quality weight.
NOISE = "0123456789#$%&*|<>{}[]=_~^"


def quality_weight(text: Column) -> Column:
    """0.1 to 1: the share of characters that aren't digits or symbols, squared."""
    clean = F.length(F.translate(text, NOISE, "")) / F.greatest(F.length(text), F.lit(1))
    return F.lit(0.1) + F.lit(0.9) * F.coalesce(clean * clean, F.lit(0.0))


def uniform_key(row_id: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from the row's id."""
    bits = F.conv(F.substring(F.md5(F.concat(row_id.cast("string"), F.lit(":" + seed))), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) with `target`: shares of all words by weight, none above `max_epochs` times its source.

    Sharing the excess again by weight until none is above ends at one level L with target = min(cap, weight * L).
    With the sources in ascending order of cap / weight, each prefix of capped sources gives a candidate for L, and
    the largest candidate is it.
    """
    ordered = Window.orderBy(F.col("_source").asc_nulls_last())
    by_ratio = Window.orderBy("_ratio", F.col("_source").asc_nulls_last())
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int")
    )
    cap = F.col("source_size") * F.lit(float(max_epochs))
    capped_before = F.sum("_cap").over(by_ratio) - F.col("_cap")
    weight_left = F.sum("_w").over(whole) - F.sum("_w").over(by_ratio) + F.col("_w")
    level = (F.sum("source_size").over(whole) - capped_before) / weight_left
    return (
        sizes.withColumn("_w", weight)
        .withColumn("_cap", cap)
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_level", level)
        .withColumn("target", F.least("_cap", F.col("_w") * F.max("_level").over(whole)))
        .select("_source", "source_size", "target")
    )


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    quality=quality_weight,
) -> DataFrame:
    """One row per document: id, size, source_size, target, epochs (whole copies), extra (words of one more, partial
    copy) and taken (all words the mix takes of it).

    `quality` maps the text column to a weight above 0. Null or empty texts have size 0 and nothing is taken of them. A
    null source is a source of its own, the last one. Equal keys are ordered by id, then by a hash of the text; rows that repeat an id share
    its random number and are each taken on their own. A text of any length counts with all its words. An empty table gives an empty result. Other columns of
    `df` are ignored.
    """
    return _mix(df, id_col, text_col, source_col, weights, max_epochs, seed, quality).withColumnRenamed("_id", id_col).drop("_row")


def _mix(df, id_col, text_col, source_col, weights=WEIGHTS, max_epochs=MAX_EPOCHS, seed=SEED, quality=quality_weight) -> DataFrame:
    """The rows of `mix`, with _id and _row (`row_key`)."""
    text = F.col("_text")
    rows = materialize(
        df.select(
            F.col(id_col).cast("long").alias("_id"), F.col(source_col).alias("_source"), F.col(text_col).alias("_text"), row_key(F.col(id_col), F.col(text_col)).alias("_row")
        ).select(
            "_id",
            "_row",
            "_source",
            word_count(text).alias("size"),
            (-F.log(F.coalesce(uniform_key(F.col("_id"), seed), F.lit(0.5))) / quality(text)).alias("_key"),
        ),
        "mix",
    ).withColumn("_bucket", F.floor((1 - F.exp(-F.col("_key"))) * BUCKETS).cast("int"))

    budget = F.floor(F.col("target") + 1e-6).cast("long")
    plan = (
        source_targets(rows.groupBy("_source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("_rest", budget - F.col("epochs") * F.col("source_size"))
    )
    filled = Window.partitionBy("_source").orderBy("_bucket")
    edges = (
        rows.groupBy("_source", "_bucket")
        .agg(F.sum("size").alias("_words"))
        .withColumn("_before", F.sum("_words").over(filled) - F.col("_words"))
    )
    at = plan["_source"].eqNullSafe(edges["_source"]) & (edges["_before"] <= plan["_rest"])
    plan = materialize(
        plan.join(edges, at, "left")
        .groupBy(plan["_source"], "source_size", "target", "epochs", "_rest")
        .agg(F.max(F.struct("_bucket", "_before")).alias("_edge")),
        "mix-plan",
    )
    joined = rows.alias("r").join(plan.alias("p"), F.expr("r._source <=> p._source")).select(
        "r._id", "r._row", "r._source", "size", "_key", "_bucket", "source_size", "target", "epochs", "_rest", "_edge"
    )
    on_edge = F.coalesce(F.col("_bucket") == F.col("_edge._bucket"), F.lit(False))
    inside = F.coalesce(F.col("_bucket") < F.col("_edge._bucket"), F.lit(False))
    in_order = Window.partitionBy("_source").orderBy("_key", "_id", "_row").rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("_edge._before") + F.sum("size").over(in_order) - F.col("size")
    whole = joined.filter(~on_edge).withColumn("extra", F.when(inside, F.col("size")).otherwise(0).cast("long"))
    split = joined.filter(on_edge).withColumn(
        "extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - before)).cast("long")
    )
    return whole.unionByName(split).select(
        "_id",
        "_row",
        "size",
        "source_size",
        "target",
        "epochs",
        "extra",
        (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"),
    )


def repeat_to_targets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: each row of `df` as often as the mix takes it, with its columns, whatever their names.

    A copy is never cut: of the one document per source at which the budget ends, the partial copy becomes whole
    when the budget holds half of it or more, else it is left out. Decisions hold for an id with its text, null ids too; rows that repeat
    both are all taken as often as the one taken most. A null text has no words and is never taken. An empty table gives an empty result. An id that isn't a number is an error.
    """
    extra = F.when((F.col("extra") > 0) & (F.col("extra") * 2 >= F.col("size")), 1).otherwise(0)
    copies = _mix(df, id_col, text_col, source_col, **options).groupBy("_id", "_row").agg(F.max(F.col("epochs") + extra).alias("_copies")).filter("_copies > 0")
    inside = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_in"), df[id_col].cast("long").alias("_key"), row_key(df[id_col], df[text_col]).alias("_row"))
    out = inside.join(copies.select("_id", F.expr("_row ^ 1").alias("_of"), "_copies"), F.col("_key").eqNullSafe(F.col("_id")) & (F.expr("_row ^ 1") == F.col("_of")))
    return out.select("_in", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_in.*")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op8_mixing": rf"""
WITH d AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    -ln((('0x' || substr(md5(doc_id::VARCHAR || ':{SEED}'), 1, 13))::BIGINT + 0.5e0) / 4503599627370496e0)
      / (0.1e0 + 0.9e0 * coalesce(power(length(translate(text, '{NOISE}', ''))::DOUBLE / greatest(length(text), 1), 2), 0e0)) AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5e0, 2e0, 1e0][((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source
), l AS (
  SELECT *, 3e0 * source_size AS cap,
    ((sum(source_size) OVER ())::DOUBLE - (sum(3e0 * source_size) OVER o - 3e0 * source_size)) / (sum(w) OVER () - sum(w) OVER o + w) AS level
  FROM s WINDOW o AS (ORDER BY 3e0 * source_size / w, source NULLS LAST)
), t AS (
  SELECT source, source_size, least(cap, w * max(level) OVER ()) AS target FROM l
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 1e-6)::BIGINT // source_size ELSE 0 END AS epochs FROM t
), m AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs,
    floor(target + 1e-6)::BIGINT - epochs * source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS UNBOUNDED PRECEDING)::BIGINT - d.size AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, epochs, greatest(0, least(size, rest - before)) AS extra,
  epochs * size + greatest(0, least(size, rest - before)) AS taken
FROM m
""".replace(' COLLATE "C"', "")
}
