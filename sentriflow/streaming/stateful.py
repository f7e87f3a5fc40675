"""Stateful operators on streams: flow sessions, merged logs with late rows, sliding counts and alert runs.

State is per key and ends by event time: a flow's with its timeout, a window's with its width.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..storage import fresh_dir


def with_lateness(df: DataFrame, time: str = "ts", delay: str = "2 seconds") -> DataFrame:
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def merge_streams(streams: list[DataFrame], time: str = "ts", delay: str = "2 seconds") -> DataFrame:
    """The rows of several streams under one watermark, which is that of the slowest."""
    out = with_lateness(streams[0], time, delay)
    for s in streams[1:]:
        out = out.unionByName(with_lateness(s, time, delay), allowMissingColumns=True)
    return out


def mark_late(batch: DataFrame, high: float | None, delay: float, time: str = "seconds") -> tuple[DataFrame, float | None]:
    """A micro-batch with `is_late` (before the highest time of earlier batches less the delay) and the highest time so far.

    Late rows go on with the flag, as the batch merge lets them through; stateful operators behind a watermark would drop them.
    """
    late = F.lit(False) if high is None else F.col(time) < high - delay
    top = batch.agg(F.max(time)).first()[0]
    return batch.withColumn("is_late", late), top if high is None else max(high, top if top is not None else high)


SESSION = "key string, session_no long, start double, last double, rows long, total double, closed boolean"


def flow_sessions(events: DataFrame, gap: float) -> DataFrame:
    """Running sessions of a stream (key string, ts timestamp with watermark, seconds, seq, amount, closes), as SESSION rows.

    Each update gives a session's current row, so the one with most `rows` counts; `closed` rows are final. A session ends with a row that closes,
    by a silence of more than `gap`, or when the watermark has passed its end.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, start, last, n, total, open_ = state.get if state.exists else (0, 0.0, 0.0, 0, 0.0, False)
        out: dict[int, tuple] = {}
        if state.hasTimedOut:
            if open_:
                out[number] = (key[0], number, start, last, n, total, True)
            state.update((number, start, last, n, total, False))
        else:
            rows = pd.concat(list(frames)).sort_values(["seconds", "seq"])
            for t, amount, closes in zip(rows["seconds"], rows["amount"], rows["closes"]):
                if open_ and t - last > gap:
                    out[number] = (key[0], number, start, last, n, total, True)
                    open_ = False
                if not open_:
                    number, start, n, total, open_ = number + 1, float(t), 0, 0.0, True
                last, n, total, open_ = float(t), n + 1, total + float(amount), not closes
                out[number] = (key[0], number, start, last, n, total, bool(closes))
            state.update((number, start, last, n, total, open_))
            until = int((last + gap) * 1000) + 1
            if until > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(until)
        if out:
            yield pd.DataFrame(list(out.values()), columns=[c.split()[0] for c in SESSION.split(", ")])

    keep = "number long, start double, last double, n long, total double, open boolean"
    return events.groupBy("key").applyInPandasWithState(step, SESSION, keep, "update", GroupStateTimeout.EventTimeTimeout)


def alert_runs(alerts: DataFrame, seconds: int = 30) -> DataFrame:
    """Runs of a stream of alerts (dedup_key, ts with watermark, score): count and best score of each session window."""
    return alerts.groupBy("dedup_key", F.session_window("ts", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("occurrences"), F.max("score").alias("score"))


def window_counts(events: DataFrame, key: str, width: str, slide: str | None = None) -> DataFrame:
    """Rows per key and event-time window of a stream with a watermark."""
    return events.groupBy(key, F.window("ts", width, slide) if slide else F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"))


def drain(stream: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its sources hold now, and return the rows it has put out. State and output lie in the shared folder."""
    spark = stream.sparkSession
    out, state = fresh_dir(spark, f"{tag}-out"), fresh_dir(spark, f"{tag}-state")
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces its own folder
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(schema).option("basePath", out)
    try:
        return found.parquet(f"{out}/batch=*").select(schema.names)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def read_table_stream(spark, folder: str, name: str, files_per_trigger: int = 100) -> DataFrame:
    """The Parquet table `name` of a folder as a stream of its files."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    # a table is a file or a folder of files
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if _is_file(spark, path) else reader.parquet(path)


def _is_file(spark, path: str) -> bool:
    return [f.rstrip("/").rsplit("/", 1)[-1] for f in spark.read.parquet(path).inputFiles()] == [path.rsplit("/", 1)[-1]]
