"""Rows of several streams in order of time: a buffer behind a watermark.

The watermark is the highest time so far less the delay. A row earlier than the watermark of the micro-batches before is late: it is let out at once, with a flag. All others wait until the
watermark has passed them, and come out by time and, among equal times, by arrival. What waits is bounded by the delay; it lies in the shared folder, a table per micro-batch,
with the watermark, so a micro-batch that runs again does the same again. Rows are put in order by ranges, not by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks
from ..storage import numbered


class ReleaseBuffer:
    """Ordered release below `folder`: released/batch=N, waiting/batch=N and marks/batch=N.

    Released rows have, beside their own columns, is_late and `position`, their number within the micro-batch. Rows without a time are late. Columns named `_arrival`, `is_late` or
    `position` aren't allowed.
    """

    def __init__(self, spark: SparkSession, folder: str, time: str = "timestamp", delay: float = 2.0):
        self.spark, self.folder, self.time, self.delay = spark, folder.rstrip("/"), time, delay

    def take(self, batch: DataFrame, number: int) -> None:
        """One micro-batch; for `foreachBatch`."""
        before = self._last(number)
        fresh = batch.withColumn("_arrival", F.struct(F.lit(number).cast("long").alias("batch"), F.monotonically_increasing_id().alias("row")))
        arrived = f"{self.folder}/arrived/batch={number}"
        fresh.write.mode("overwrite").parquet(arrived)
        fresh = self.spark.read.schema(fresh.schema).parquet(arrived)
        low = before["watermark"] if before else None
        late = F.col(self.time).isNull() if low is None else F.col(self.time).isNull() | (F.col(self.time) < low)
        marked = fresh.withColumn("is_late", late)
        if before:
            marked = marked.unionByName(self.spark.read.schema(fresh.schema).parquet(f"{self.folder}/waiting/batch={before['batch']}").withColumn("is_late", F.lit(False)))
        high = fresh.agg(F.max(self.time)).first()[0]
        mark = max((x for x in (low, None if high is None else high - self.delay) if x is not None), default=None)
        out = F.col("is_late") if mark is None else F.col("is_late") | (F.col(self.time) <= mark)
        self._write(numbered(marked.filter(out), [self.time, "_arrival"], "position").drop("_arrival"), "released", number)
        self._write(marked.filter(~out).drop("is_late"), "waiting", number)
        self._write(self.spark.createDataFrame([(mark,)], "watermark double"), "marks", number)

    def flush(self) -> None:
        """Let out what still waits, at the end of the streams."""
        last = self._last(None)
        if last:
            rest = self.spark.read.parquet(f"{self.folder}/waiting/batch={last['batch']}").withColumn("is_late", F.lit(False))
            self._write(numbered(rest, [self.time, "_arrival"], "position").drop("_arrival"), "released", last["batch"] + 1)

    def released(self) -> DataFrame:
        """All rows let out so far; their order is (batch, position)."""
        return self.spark.read.parquet(f"{self.folder}/released")

    def late_rows(self) -> int:
        return self.released().filter("is_late").count()

    def _write(self, df: DataFrame, name: str, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={number}")

    def _last(self, number: int | None):
        """The watermark and number of the last micro-batch before `number`."""
        if not sinks._exists(self.spark, f"{self.folder}/marks"):
            return None
        marks = self.spark.read.parquet(f"{self.folder}/marks")
        marks = marks if number is None else marks.filter(F.col("batch") < number)
        return marks.orderBy(F.desc("batch")).first()


def release_in_order(stream: DataFrame, folder: str, time: str = "timestamp", delay: float = 2.0, every: str | None = None):
    """Start a query that takes a stream to the released rows below `folder`; several streams are united before (`stateful.merge_streams` without watermark, or `logs.merge_logs`)."""
    buffer = ReleaseBuffer(stream.sparkSession, folder, time, delay)
    writer = stream.writeStream.foreachBatch(buffer.take).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start(), buffer
