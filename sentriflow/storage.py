"""Intermediate tables in storage that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`. Where it is unset, a single-machine session gets a temporary folder, and a cluster's an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/sentriflow/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again; cuts the lineage and survives lost executors."""
    path = fresh_dir(df.sparkSession, tag)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """`df` dealt out by its keys over partitions of about `rows` rows at most: their number grows with the table, and their size doesn't. Meant for tables as read, whose rows cost little to count."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *keys)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add a running number from 1 in the order of the columns, without bringing all rows to one task.

    Rows are range-partitioned and numbered within; a table of one row per partition gives the numbers before it.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "numbered")
    parts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(parts, "_part").withColumn(name, F.col("_before") + inside).drop("_part", "_before")
