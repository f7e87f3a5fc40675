import pytest
from pyspark.sql import functions as F

from sentriflow.streaming import stateful


@pytest.fixture()
def stream(spark, tmp_path):
    def make(*batches):
        for i, rows in enumerate(batches):
            df = spark.createDataFrame([(k, F_ts(t), t, n, 1.0, c) for n, (k, t, c) in enumerate(rows)], "key string, ts timestamp, seconds double, seq long, amount double, closes boolean")
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return make


def F_ts(t):
    import datetime

    return datetime.datetime.fromtimestamp(t, datetime.timezone.utc)


def test_sessions_end_by_flag_silence_and_watermark(stream):
    s = stateful.with_lateness(stream([("a", 100.0, False), ("a", 101.0, True), ("a", 102.0, False)], [("a", 300.0, False), ("b", 5000.0, False)], [("b", 5001.0, False)]), "ts", "1 second")
    rows = stateful.drain(stateful.flow_sessions(s, 120.0), "test", "update").collect()
    best = {}
    for r in rows:
        k = (r["key"], r["session_no"])
        best[k] = max(best.get(k, (0, False)), (r["rows"], r["closed"]))
    assert best[("a", 1)] == (2, True) and best[("a", 2)] == (1, True) and best[("a", 3)][0] == 1 and best[("b", 1)][0] == 2


def test_late_rows_are_marked_not_dropped(spark):
    a = spark.createDataFrame([(100.0,), (109.0,)], "seconds double")
    b = spark.createDataFrame([(99.0,), (115.0,)], "seconds double")
    first, high = stateful.mark_late(a, None, 2.0)
    second, high = stateful.mark_late(b, high, 2.0)
    assert [r["is_late"] for r in first.collect()] == [False, False] and [r["is_late"] for r in second.orderBy("seconds").collect()] == [True, False] and high == 115.0


def test_window_counts_and_merge(stream):
    s = stream([("a", 100.0, False), ("a", 130.0, False)])
    merged = stateful.merge_streams([s, s])
    rows = stateful.drain(stateful.window_counts(merged, "key", "1 minute"), "windows", "update").collect()
    assert sorted(r["n"] for r in rows) == [2, 2]
    assert stateful.alert_runs(merged.select("ts", F.col("key").alias("dedup_key"), F.col("amount").alias("score"))).isStreaming
