"""The corpus pipeline: documents to encoded training rows, in five stages.

Each stage reads what the stage before has written as Parquet. A stage that filters keeps whole rows with the columns of `documents`; the
last one returns the token ids of each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentriflow.llm import exact_dedup, language_id, mixing, near_dedup, pieces
from sentriflow.llm.common import materialize


def few_rows(spark: SparkSession) -> None:
    """Rows hold whole texts, and executors run all stages one after another: hand fewer of them to Python at a time than Spark does by default."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts, texts without letters and texts that no mixture of the learned languages explains go."""
    few_rows(spark)
    return language_id.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space, the document with the smallest id."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more over five-word shingles, the one with the smallest id."""
    return near_dedup.drop_near_copies(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeat_to_targets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row (doc_id, tokens), with their number and CRC, the digest of the text they decode to, and whether it is the row's."""
    few_rows(spark)
    return pieces.encode_checked(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: Language mixtures, sketches and dropout can't be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


__all__ = ["ORACLE_SQL", "STAGES", "run"]
