"""Streams of several days with keyed state against the batch plan."""

import random

import pytest
from pyspark.sql import functions as F

from sentriflow import schemas
from sentriflow.config import config
from sentriflow.operators import baselines, windows
from sentriflow.plans import pipeline
from sentriflow.streaming import engine, keyed

CFG = config(
    flow={"windows": (10, 600)}, recon={"min_connections": 2, "fan": 2, "pairs": 2, "subnets": 2}, tunnel={"min_queries": 2, "window": 900, "rate": (0.0001, 0.01), "length": 10, "entropy": 2.0},
    c2={"min_flows": 3, "min_repeat": 3, "records": 12}, ewma={"warm_total": 30}, exfil={"known": 5, "insufficient": 8, "warming": 20, "burst": 100.0, "burst_ratio": 1.5, "day_ratio": 1.2},
    alert={"min_score": 0.1, "min_confidence": 0.1},
)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def events(spark, n=200, days=4):
    """Packets of a few hosts over days: flows that FIN ends, flows that silence ends, beacons, names and handshakes."""
    r = random.Random(7)
    rows = []
    for i in range(n):
        t = round(1_700_000_000 + i * days * 86_400 / n + r.random() * 300, 6)
        port = r.choice([53, 443, 80, 8080])
        name = "".join(r.choice("abcdefghij0123") for _ in range(14)) + ".net"
        dns = (name, "TXT" if i % 3 else "A", None, "NXDOMAIN" if i % 2 else "NOERROR", 0, True, None, None) if port == 53 else None
        tls = ("TLS 1.0" if i % 3 else "TLS 1.3", None if i % 2 else name, *[None] * 9) if port == 443 else None
        rows.append((t, f"10.0.0.{r.randrange(4)}", f"172.16.{r.randrange(3)}.{r.randrange(9)}", 4, 1000 + i % 3, port, 17 if port == 53 else 6, 60 + i % 900, r.choice([2, 16, 17, 24]), dns, tls, False, i))
        for k in range(r.randrange(3)):
            rows.append((round(t + 0.5 * (k + 1), 6), *rows[-1][1:6], rows[-1][6], 200 + k, 16, None, None, False, 10_000 * (k + 1) + i))
    kind = f"timestamp double, source_ip string, destination_ip string, ip_version int, source_port int, destination_port int, protocol int, packet_length int, tcp_flags int, dns {schemas.DNS}, tls {schemas.TLS}, is_aggregated boolean, event_id long"
    some = spark.createDataFrame(rows, kind)
    names = [c.split()[0] for c in ("timestamp", "source_ip", "destination_ip", "ip_version", "source_port", "destination_port", "protocol", "packet_length", "tcp_flags", "dns", "tls", "is_aggregated", "event_id")]
    whole = spark.createDataFrame([], schemas.EVENT + ", event_id long")
    return whole.unionByName(some.select(*names), allowMissingColumns=True).select(*whole.columns)


def test_a_stream_of_days_gives_the_features_and_alerts_of_the_batch(spark, tmp_path):
    all_events = events(spark)
    low, high = all_events.agg(F.min("timestamp"), F.max("timestamp")).first()
    state = None
    for i in range(2):  # a restart for each
        part = all_events.filter((F.col("timestamp") >= low + i * (high - low) / 2) & ((F.col("timestamp") < low + (i + 1) * (high - low) / 2) | (i == 1)))
        part.repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        run, state = engine.run(spark.readStream.schema(all_events.schema).parquet(str(tmp_path / "in")), str(tmp_path / "state"), CFG)
        run.awaitTermination()
    assert run.late == 0 and state.features().count() > 60
    state.flush()
    got = {r["flow_id"]: r.asDict(True) for r in state.features().collect()}
    want = {r["flow_id"]: r.asDict(True) for r in pipeline.featurise(all_events, CFG).collect()}
    assert got.keys() == want.keys() and len(want) > 100
    close = lambda x: pytest.approx(x, rel=1e-9, abs=1e-9) if isinstance(x, float) else x
    for f, row in want.items():
        for c, v in row.items():
            assert got[f][c] == close(v), (f, c)
    key = ["detector", "source_ip", "destination_ip", "timestamp", "sub_type"]
    alerts = sorted(map(str, state.alerts().select(*key).collect()))
    assert alerts == sorted(map(str, pipeline.detect(all_events, CFG).select(*key).collect()))
    assert len({r["detector"] for r in state.alerts().collect()}) >= 3
    # a micro-batch releases its own flows alone
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "state" / "features")).groupBy("batch").count().collect()]
    assert len(sizes) >= 2 and max(sizes) < len(want)


def test_histories_of_rows_that_come_in_any_order(spark, tmp_path):
    """Nulls, equal times, rows that come twice: features as by the batch operators, whatever the micro-batches."""
    r = random.Random(2)
    rows = [(str(i), r.choice(["a", "b", None]), r.choice(["x", "y", "z", None]), r.choice([80, 443, None]), float(r.randrange(90)), r.randrange(9), r.choice([0.0, 1.5]), float(t), t * 1_000_000, None if i % 3 else f"n{i % 7}.com", "TXT" if i % 2 else "A") for i, t in enumerate(sorted(r.randrange(100, 190_000) for _ in range(150)))]
    kind = "flow_id string, src string, dst string, dport int, bytes double, packets long, duration double, seconds double, us long, qname string, qtype string"
    df = spark.createDataFrame(rows, kind)
    cfg = config(flow={"windows": (900, 20_000)}, tunnel={"window": 30_000}, c2={"records": 4, "expire": 40_000.0, "min_flows": 2, "ici": (1.0, 30_000.0)}, exfil={"known": 2, "insufficient": 4, "warming": 9})
    for a in range(0, 150, 50):
        some = rows[a : a + 50] + rows[max(0, a - 1) : a + 1]  # one is written again
        r.shuffle(some)
        spark.createDataFrame(some, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("end", "q", "q", 1, 0.0, 0, 0.0, 5e8, 5 * 10**14, None, None)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("flow", F.col("flow_id"))
    with keyed.rocksdb(spark):
        found = keyed.histories(stream, "10 hours", cfg)
        query = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = {x["flow_id"]: x.asDict() for x in keyed.joined_histories(spark.read.parquet(str(tmp_path / "out")), cfg).collect()}
    batch = baselines.host_baseline(windows.destination_features(windows.source_features(df, (900, 20_000)), (900, 20_000)), ["seconds", "flow_id"], cfg)
    batch = baselines.beacon_features(batch, ["seconds", "flow_id"], cfg=cfg)
    queries = windows.dns_window(df.select("src", "us", "qname", "qtype", F.col("flow_id").alias("_f")), 30_000).select("_f", *windows.DNS)
    want = {x["flow_id"]: x.asDict() for x in batch.join(queries, F.col("flow_id") == F.col("_f"), "left").collect()}
    assert got.keys() == want.keys()
    for f, row in got.items():
        for c, v in row.items():
            if c != "flow":
                assert v == (pytest.approx(want[f][c], rel=1e-9, abs=1e-9) if isinstance(v, float) else want[f][c]), (f, c)
