import json
import struct

import pytest

from sentriflow.operators import models, serving
from sentriflow.sources import logs, pcap, sinks


def test_capture_round_trip(spark, tmp_path):
    hello = b"\x16\x03\x01\x00\x50\x01\x00\x00\x4c\x03\x03" + b"\0" * 32 + b"\0" + b"\x00\x02\x13\x01" + b"\x01\x00"
    name = b"example.com"
    sni = struct.pack(">HHHBH", 0, len(name) + 5, len(name) + 3, 0, len(name)) + name
    hello += struct.pack(">H", len(sni)) + sni
    query = b"\x00\x07\x01\x00\x00\x01\x00\x00\x00\x00\x00\x00\x03www\x03com\x00\x00\x10\x00\x01"
    frames = [(1_000_000, pcap.frame("1.2.3.4", "5.6.7.8", 1, 443, 6, hello, 24)), (2_500_000, pcap.frame("1.2.3.4", "8.8.8.8", 2, 53, 17, query)), (3_000_000, b"\0" * 12 + b"\x08\x06" + b"\0" * 30)]
    (tmp_path / "x.pcap").write_bytes(pcap.capture(frames))
    rows = logs.open_source(spark, str(tmp_path / "x.pcap")).orderBy("timestamp").collect()
    assert [r["timestamp"] for r in rows] == [1.0, 2.5]
    assert (rows[0]["tls"]["version"], rows[0]["tls"]["sni"], rows[0]["payload_length"]) == ("TLS 1.2", "example.com", len(hello))
    assert (rows[1]["dns"]["query_name"], rows[1]["dns"]["query_type"], rows[1]["dns"]["is_query"]) == ("www.com", "TXT", True)
    caps = spark.read.format("binaryFile").load(str(tmp_path))
    assert pcap.count_frames(caps).first().asDict() == {"packets": 3, "events": 2, "skipped": 1, "errors": 0}
    assert pcap.inspect(caps).first()["packets"] == 3 and pcap.read_pcap(spark, str(tmp_path), 1).count() == 1
    with pytest.raises(ValueError):
        list(pcap.packets(b"nonsense"))


def test_tsv_logs(spark, tmp_path):
    fields = "ts uid id.orig_h id.orig_p id.resp_h id.resp_p proto orig_bytes history".split()
    body = ["1700000000.000 C1 192.168.1.1 54321 10.0.0.1 80 tcp 512 ShADadfF", "1700000001.000 C2 192.168.1.2 12345 8.8.8.8 53 udp 50 -", "1700000002.000 - - - - - tcp - -", "- C4 a 1 b 2 tcp 5 S"]
    (tmp_path / "conn.log").write_text("#separator \\x09\n#fields\t" + "\t".join(fields) + "\n" + "\n".join(x.replace(" ", "\t") for x in body) + "\n\n")
    rows = logs.open_source(spark, str(tmp_path / "conn.log")).orderBy("timestamp").collect()
    assert [r["tcp_flags"] for r in rows] == [0x13, None, None] and rows[2]["source_ip"] is None and rows[0]["payload_length"] == 512
    with pytest.raises(ValueError):
        logs.open_source(spark, str(tmp_path / "http.txt"))


def test_json_logs(spark, tmp_path):
    base = {"uid": "C", "id.orig_h": "a", "id.orig_p": 1, "id.resp_h": "b", "id.resp_p": 2, "proto": "tcp"}
    conn = [base | {"ts": 100.0, "duration": 5.0, "orig_bytes": 1000, "resp_bytes": 5000, "orig_pkts": 10, "resp_pkts": 15}, base, base | {"ts": 1.0, "id.resp_h": None}]
    (tmp_path / "conn.json").write_text("\n".join(map(json.dumps, conn)) + "\n{broken\n")
    (tmp_path / "dns.json").write_text("\n".join(json.dumps(base | x) for x in ({"ts": 1.0, "query": "q"}, {"ts": 2.0})))
    (tmp_path / "ssl.json").write_text("\n".join(json.dumps(base | x) for x in ({"ts": 1.0, "version": "TLSv12"}, {"ts": 2.0})))
    c = logs.open_source(spark, str(tmp_path / "conn.json")).collect()
    assert len(c) == 1 and (c[0]["aggregated_packet_count"], c[0]["aggregated_byte_count"], c[0]["is_aggregated"]) == (25, 6000, True)
    merged = logs.merge_logs(*[logs.open_source(spark, str(tmp_path / f"{k}.json")) for k in ("conn", "dns", "ssl")])
    assert merged.count() == 3


def test_vectors_and_labels(spark, tmp_path):
    (tmp_path / "v.jsonl").write_text('{"flow_id": "f", "features": {"a": 1.5, "b": true, "c": null, "d": "x"}}\n\n{oops\n')
    good, bad = logs.read_vectors(spark, str(tmp_path / "v.jsonl"))
    assert {r["name"]: r["value"] for r in logs.numeric_features(good).collect()} == {"a": 1.5, "b": 1.0} and bad.count() == 1
    (tmp_path / "cic").mkdir()
    (tmp_path / "cic" / "a.csv").write_text("Flow ID, Source IP, Source Port, Destination IP, Destination Port, Protocol, Flow Duration, Total Fwd Packets, Total Backward Packets,Total Length of Fwd Packets, Total Length of Bwd Packets, Label\nf,1.1.1.1,10,2.2.2.2,80,6,2000000,3,4,100,200,DDoS\nf,1.1.1.1,x,2.2.2.2,80,6,1,3,4,1,2,BENIGN\n")
    rows = logs.read_labelled(spark, str(tmp_path / "cic"), "cic").collect()
    assert [(r["duration"], r["packet_count"], r["byte_count"], r["label"]) for r in rows] == [(2.0, 7, 300, "DDOS")]
    assert logs.read_labelled(spark, str(tmp_path / "none"), "cic").count() == 0


def test_saving_alerts_twice_adds_nothing(spark, tmp_path):
    a = spark.createDataFrame([("1", "C2", [("f", 1.0)]), ("2", "DDoS", [])], "id string, threat_class string, evidence array<struct<feature:string,score:double>>")
    for _ in range(2):
        sinks.save_alerts(spark, a, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "alerts")).count() == 2 and spark.read.parquet(str(tmp_path / "s" / "evidence")).count() == 1


def test_upsert_keeps_first_seen(spark):
    old = spark.createDataFrame([("a", 1, 5), ("b", 2, 6)], "k string, first_seen int, x int")
    new = spark.createDataFrame([("b", 9, 7), ("c", 3, 8)], "k string, first_seen int, x int")
    assert sorted(map(tuple, sinks.upsert(old, new, "k").collect())) == [("a", 1, 5), ("b", 2, 7), ("c", 3, 8)]


def test_reports_and_fan_out(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    for form in ("json", "csv", "markdown"):
        sinks.write_report(df, str(tmp_path / form), form)
    assert "| 1 | x |" in [r[0] for r in spark.read.text(str(tmp_path / "markdown")).collect()]
    seen = []
    assert sinks.fan_out(df, [lambda d: seen.append(d.count()), lambda d: 1 / 0]).keys() and seen == [1]


def test_paging(spark):
    a = spark.createDataFrame([(str(i), float(i), "HIGH" if i % 2 else "LOW", "1.1.1.1", "C2") for i in range(10)], "id string, timestamp double, severity string, source_ip string, threat_class string")
    assert [r["id"] for r in serving.recent_alerts(a, severity="HIGH", limit=2, offset=1).collect()] == ["7", "5"]


def test_isolation_forest_and_registry(spark, tmp_path):
    import numpy as np

    r = np.random.default_rng(0)
    x = np.vstack([r.normal(0, 1, (400, 3)), [[9, 9, 9]]])
    s = models.IsolationForest(x, trees=30).score(x)
    assert s[-1] == s.max() and np.mean(s > 0.5) < 0.1
    rows = spark.createDataFrame([(float(i % 2), float(i)) for i in range(40)], "label double, v double")
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    vec = array_to_vector(F.array(F.col("label") * 3))
    m = models.train_forest(rows, vec, trees=3, depth=2)
    reg = models.Registry(spark, str(tmp_path))
    assert reg.load("m") is None
    reg.save("m", "1", m)
    reg.save("m", "2", m)
    reg.promote("m", "1")
    reg.promote("m", "2")
    assert reg.rollback("m") == "1"
    out = models.add_score(rows, reg.load("m"), vec).groupBy("label").agg(F.avg("model_score").alias("s")).collect()
    assert {r["label"]: round(r["s"]) for r in out} == {0.0: 0, 1.0: 1}


def test_logs_without_a_header_and_what_becomes_of_rows(spark, tmp_path):
    (tmp_path / "x.log").write_text("#close\n1.5\ta\tb\n2.5\tc\n\n")
    assert [tuple(r) for r in logs.read_tsv(spark, str(tmp_path / "x.log")).orderBy("`0`").collect()] == [("1.5", "a", "b"), ("2.5", "c", None)]
    (tmp_path / "none.log").write_text("#close\n")
    assert logs.read_tsv(spark, str(tmp_path / "none.log")).count() == 0
    rows = logs.read_tsv(spark, str(tmp_path / "x.log"), ["ts", "uid", "id.orig_h"])
    assert tuple(logs.tsv_counters(rows).first()) == (2, 2, 0, 0)
    bad = spark.createDataFrame([("1.0", "80"), ("x", "80"), ("-", "80"), ("2.0", "http"), ("3.0", "-")], "ts string, `id.orig_p` string")
    assert tuple(logs.tsv_counters(bad).first()) == (5, 2, 1, 2)
    ends = '"id.orig_h": "a", "id.resp_h": "b"'
    lines = spark.createDataFrame([(x,) for x in ('{"ts": 1.0, %s, "query": "q"}' % ends, '{"ts": 1.0, %s}' % ends, '{"query": "q", %s}' % ends, "{broken", " ", "")], "value string")
    assert tuple(logs.json_counters(lines, "dns").first()) == (4, 1, 2, 1) and tuple(logs.json_counters(lines, "conn").first()) == (4, 2, 1, 1)
    assert tuple(logs.json_counters(lines.filter("false"), "conn").first()) == (0, 0, 0, 0)
