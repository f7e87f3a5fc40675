"""Streams of logs to alerts, captures in blocks, training preparation, incident sink and model checks."""

import json
import math
import struct

import pytest
from pyspark.sql import functions as F

from sentriflow.config import config
from sentriflow.functions import lexical  # noqa: F401
from sentriflow.operators import features, models, serving
from sentriflow.plans import pipeline
from sentriflow.sources import logs, pcap, sinks
from sentriflow.streaming import engine

CFG = config(flow={"windows": (10, 60)}, recon={"min_connections": 5, "fan": 5, "pairs": 5, "subnets": 2})


def log_lines(start, n):
    """A scan of many hosts, JSON connection lines."""
    return [json.dumps({"ts": start + i * 0.5, "uid": f"C{start}{i}", "id.orig_h": "10.0.0.1", "id.orig_p": 4000 + i, "id.resp_h": f"10.1.{i % 5}.{i}", "id.resp_p": 80, "proto": "tcp", "duration": 0.1, "orig_bytes": 10, "resp_bytes": 0, "orig_pkts": 1, "resp_pkts": 0}) for i in range(n)]


@pytest.fixture()
def two_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_folder_of_logs_becomes_alerts_once(spark, tmp_path, two_partitions):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join([*log_lines(1_000.0, 12), "{broken"]))
    state = None
    for name, start in ((None, None), ("b.json", 1_010.0), ("c.json", 5_000.0)):
        if name:
            (folder / name).write_text("\n".join(log_lines(start, 12)))
        query, state = engine.run(logs.stream_log(spark, str(folder), "conn"), str(tmp_path / "state"), CFG, cold=True)
        query.awaitTermination()
    before_end = state.alerts().count()
    state.flush()
    state.flush()
    got = state.alerts()
    everything = logs.read_json_log(spark, str(folder), "conn")
    want = pipeline.detect(everything, CFG, cold=True)
    key = ["detector", "source_ip", "destination_ip", "timestamp"]
    assert want.count() > 5 and before_end < got.count()
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))


def test_tab_separated_logs_stream(spark, tmp_path):
    (tmp_path / "conn.log").write_text("#fields\tts\tuid\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\torig_bytes\thistory\n1.5\tC\ta\t1\tb\t2\ttcp\t5\tS\n")
    stream = logs.stream_log(spark, str(tmp_path), "conn", "tsv")
    query = stream.writeStream.format("memory").queryName("tsv_rows").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r["timestamp"], r["source_ip"], r["tcp_flags"]) for r in spark.table("tsv_rows").collect()] == [(1.5, "a", 2)]


def block(order, kind, body):
    body += b"\0" * (-len(body) % 4)
    return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)


@pytest.mark.parametrize("order", ["<", ">"])
def test_captures_in_blocks(spark, tmp_path, order):
    frame = pcap.frame("1.2.3.4", "5.6.7.8", 1, 2, 6, b"xyz", 2)
    head = struct.pack(order + "I", 0x0A0D0D0A) + struct.pack(order + "IIHHqI", 28, 0x1A2B3C4D, 1, 0, -1, 28)
    nano = block(order, 1, struct.pack(order + "HHI", 1, 0, 0) + struct.pack(order + "HHB3x", 9, 1, 9) + struct.pack(order + "HH", 0, 0))
    micro = block(order, 1, struct.pack(order + "HHI", 1, 0, 0))
    ticks = 1_500_000_000
    enhanced = block(order, 6, struct.pack(order + "IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(frame), len(frame)) + frame)
    second = block(order, 6, struct.pack(order + "IIIII", 1, 0, 2_500_000, len(frame), len(frame)) + frame)
    simple = block(order, 3, struct.pack(order + "I", len(frame)) + frame)
    data = head + nano + micro + enhanced + block(order, 5, b"stat") + second + simple
    assert [(round(t, 6), link, f) for t, link, f in pcap.packets(data)] == [(1.5, 1, frame), (2.5, 1, frame), (2.5, 1, frame)]
    assert pcap.count_packets(data + b"\x06\0") == {"format": "pcapng", "packets": 3} and len(list(pcap.packets(data, 1))) == 1
    (tmp_path / "x.pcapng").write_bytes(data)
    rows = logs.open_source(spark, str(tmp_path / "x.pcapng")).collect()
    assert [(r["source_ip"], r["tcp_flags"], r["payload_length"]) for r in rows] == [("1.2.3.4", 2, 3)] * 3


def test_training_rows(spark, tmp_path):
    (tmp_path / "cic.csv").write_text(" Total Fwd Packets, Total Backward Packets,Packet Length Mean,Packet Length Std,Flow IAT Mean,Flow IAT Std,Flow Duration, Label\n3,4,0.5,2,50,200,3000000,BENIGN\nx,1,1,1,1,1,1,Bot\n1,1,10,5,1000000,500000,1,Bot\n")
    rows = logs.cic_training(logs._csv(spark, str(tmp_path))).collect()
    assert [(r["packet_count"], r["byte_count"], r["pkt_size_cv"], r["iat_cv"], r["flow_duration"], r["label"]) for r in rows] == [(7.0, 0.0, 2.0, pytest.approx(2.0), 3.0, 0), (2.0, 0.0, 0.5, pytest.approx(0.5), 1e-6, 1)]
    (tmp_path / "prep").mkdir()
    (tmp_path / "prep" / "a.csv").write_text("a,label\n1.5,1\n,0\n")
    got = logs.read_training(spark, str(tmp_path / "prep"), ("a", "splt_size_0")).collect()
    assert sorted(((r["a"], r["splt_size_0"], r["label"]) for r in got), key=str) == sorted([(1.5, 0.0, 1), (None, 0.0, 0)], key=str)
    r = spark.createDataFrame([("Ab-1.com",)], "d string").select(*[c.alias(k) for k, c in features.training_name_columns(F.col("d")).items()]).first()
    grams = ["ab", "b-", "-1", "1.", ".c", "co", "om"]
    assert (r["dns_query_length"], r["dns_unique_char_count"], r["dns_digit_ratio"], r["dns_hyphen_ratio"], r["dns_alpha_ratio"]) == (8, 8, 0.125, 0.125, 0.625)
    assert r["dns_ngram_entropy"] == pytest.approx(math.log2(len(grams)))


def test_incidents_are_saved_in_versions(spark, tmp_path):
    kind = "incident_id string, first_seen double, last_seen double, status string"
    folder = str(tmp_path / "s")
    sinks.save_incidents(spark, spark.createDataFrame([("I1", 1.0, 2.0, "NEW"), ("I2", 1.0, 2.0, "NEW")], kind), spark.createDataFrame([("I1", "a"), ("I1", "b")], "incident_id string, id string"), folder)
    sinks.save_incidents(spark, spark.createDataFrame([("I1", 9.0, 9.0, "INVESTIGATING"), ("I3", 3.0, 4.0, "NEW")], kind), spark.createDataFrame([("I1", "b"), ("I3", "c")], "incident_id string, id string"), folder)
    assert sorted(map(tuple, sinks.latest_incidents(spark, folder).select("incident_id", "first_seen", "last_seen", "status").collect())) == [("I1", 1.0, 9.0, "INVESTIGATING"), ("I2", 1.0, 2.0, "NEW"), ("I3", 3.0, 4.0, "NEW")]
    assert spark.read.parquet(f"{folder}/links").count() == 3


def test_a_save_writes_its_changes_and_lost_writers_leave_no_trace(spark, tmp_path):
    kind = "incident_id string, first_seen double, last_seen double"
    rows = lambda *r: spark.createDataFrame(list(r), kind)
    log = sinks.IncidentLog(spark, str(tmp_path))
    assert log.rows() is None and log.compact() is None
    seen = lambda: sorted(map(tuple, log.rows().select("incident_id", "first_seen", "last_seen").collect()))
    assert log.save(rows(*[(f"I{i}", 1.0, 2.0) for i in range(50)])) == 0
    assert log.save(rows(("I1", 5.0, 6.0), ("J", 5.0, 6.0))) == 1
    sizes = {c["number"]: spark.read.parquet(f"{tmp_path}/data/{c['data']}").count() for c in log.commits()}
    assert sizes == {0: 50, 1: 2} and ("I1", 1.0, 6.0) in seen() and len(seen()) == 51
    rows(("LOST", 0.0, 0.0)).write.parquet(f"{tmp_path}/data/lost")  # no commit
    assert len(seen()) == 51
    # a writer that saw the same commits: its number is taken, it gets the next one, and both count
    other = sinks.IncidentLog(spark, str(tmp_path))
    before = other.commits()
    log.save(rows(("I2", 9.0, 9.0)))
    other.commits = lambda: before
    assert other.save(rows(("I3", 9.0, 9.0))) == 3
    want = seen()
    assert ("I2", 1.0, 9.0) in want and ("I3", 1.0, 9.0) in want
    # a save between what a compaction has read and its commit
    late = sinks.IncidentLog(spark, str(tmp_path))
    read = late.commits()
    log.save(rows(("I4", 9.0, 9.0)))
    late.commits = lambda: read
    assert late.compact() == 5 and len(log.commits()) == 2
    assert seen() == sorted([x if x[0] != "I4" else ("I4", 1.0, 9.0) for x in want])
    log.save(spark.createDataFrame([("K", 1.0, 2.0, "NEW")], kind + ", status string"))
    assert {r["incident_id"]: r["status"] for r in log.rows().collect()} == {**{x[0]: None for x in want}, "K": "NEW"}


def test_changed_model_files_are_not_loaded(spark, tmp_path):
    from pyspark.ml.functions import array_to_vector

    rows = spark.createDataFrame([(float(i % 2), float(i)) for i in range(40)], "label double, v double")
    vec = array_to_vector(F.array(F.col("label") * 3))
    m = models.train_boosted(rows, vec, rounds=2, depth=2)
    reg = models.Registry(spark, str(tmp_path))
    assert reg.status("m") == "NOT_AVAILABLE"
    reg.save("m", "1", m)
    reg.promote("m", "1")
    assert reg.status("m") == "VALID" and reg.load("m") is not None
    victim = next(p for p in (tmp_path / "m" / "1" / "model").rglob("part-*") if p.suffix != ".crc")
    (victim.parent / f"part-99999{victim.suffix}").write_bytes(b"more")
    assert reg.status("m") == "INVALID" and reg.load("m") is None
    scores = spark.createDataFrame([(i, 0.5 + (i % 2) * 0.1 if i < 50 else 0.9) for i in range(60)], "i int, model_score double")
    d = models.score_drift(scores, ["i"], last=10).first()
    assert (d["n"], d["mean"]) == (10, pytest.approx(0.9)) and d["drift"] > 5


def test_versions_are_taken_over_between_registries(spark, tmp_path):
    from pyspark.ml.functions import array_to_vector

    rows = spark.createDataFrame([(float(i % 2), float(i)) for i in range(40)], "label double, v double")
    there, here = models.Registry(spark, str(tmp_path / "there")), models.Registry(spark, str(tmp_path / "here"))
    assert not here.sync(there, "m", "1") and here.versions("m") == []
    there.save("m", "1", models.train_boosted(rows, array_to_vector(F.array(F.col("label") * 3)), rounds=2, depth=2))
    assert here.sync(there, "m", "1") and here.sync(there, "m", "1") and here.versions("m") == ["1"]
    here.promote("m", "1")
    assert here.status("m") == "VALID" and here.load("m") is not None
    broken = next(p for p in (tmp_path / "here" / "m" / "1" / "model").rglob("part-*") if p.suffix != ".crc")
    (broken.parent / "part-99999.parquet").write_bytes(b"more")
    assert here.status("m") == "INVALID" and here.sync(there, "m", "1") and here.status("m") == "VALID"
    victim = next(p for p in (tmp_path / "there" / "m" / "1" / "model").rglob("part-*") if p.suffix != ".crc")
    (victim.parent / "part-99999.parquet").write_bytes(b"more")
    third = models.Registry(spark, str(tmp_path / "third"))
    assert not third.sync(there, "m", "1") and third.versions("m") == [] and not list((tmp_path / "third").rglob(".sync-*"))


def test_running_latency(spark):
    xs = [float((i * 37) % 101) for i in range(1500)]
    got = serving.running_latency(spark.createDataFrame(list(enumerate(xs)), "i int, latency double").repartition(3), ["i"]).first()
    mean = xs[0]
    for x in xs[1:]:
        mean = mean * 0.9 + x * 0.1
    ring = sorted(xs[-1000:])
    assert (got["flows"], got["latency"], got["latency_p50"], got["latency_p95"], got["latency_p99"]) == (1500, pytest.approx(mean), ring[500], ring[950], ring[990])
