"""Sources that are read in parts or while they grow, and rows let out in order."""

import json
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from sentriflow.sources import capture_splits, logs, pcap, tail
from sentriflow.streaming import ordered


def frames(n, seed=1):
    """Frames of many sizes; some payloads look like captures themselves."""
    r = random.Random(seed)
    inner = pcap.capture([(i * 10, b"x" * 40) for i in range(8)])
    return [(1_700_000_000_000_000 + i * 1000, pcap.frame("1.2.3.4", "5.6.7.8", i % 60000, 80, r.choice([6, 17]), inner if i % 9 == 0 else r.randbytes(r.randrange(900)), i % 32)) for i in range(n)]


def block(kind, body):
    body += b"\0" * (-len(body) % 4)
    return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)


def block_capture(some):
    head = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0))
    out = [head]
    for i, (us, f) in enumerate(some):
        out.append(block(6, struct.pack("<IIIII", 0, us >> 32, us & 0xFFFFFFFF, len(f), len(f)) + f))
        if i % 10 == 3:
            out.append(block(3, struct.pack("<I", len(f)) + f))  # without a time: that of the packet before
    return b"".join(out)


@pytest.mark.parametrize("make", [pcap.capture, block_capture])
def test_parts_of_a_capture_are_the_whole(spark, tmp_path, make):
    data = make(frames(300))
    (tmp_path / "a.pcap").write_bytes(data)
    key = lambda r: (r["timestamp"], r["source_port"], r["payload_length"])
    want = sorted(map(key, pcap.read_pcap(spark, str(tmp_path / "a.pcap")).collect()))
    for parts in (1, 4, 16):
        split = -(-len(data) // parts)
        held = capture_splits.read_parts(spark, str(tmp_path / "a.pcap"), split)
        assert held.count() == parts and held.agg(F.max(F.length("content"))).first()[0] <= split + 2000
        for look_back in (3000, 1 << 19):
            assert sorted(map(key, capture_splits.read_captures(spark, str(tmp_path), split, look_back).collect())) == want
    counted = capture_splits.capture_counters(spark, f"file://{tmp_path}", 5000).first()
    assert (counted["packets"], counted["events"], counted["errors"]) == (len(want), len(want), 0)


def test_cut_off_and_foreign_captures(spark, tmp_path):
    data = pcap.capture(frames(60))
    (tmp_path / "cut.pcap").write_bytes(data[:-7])
    assert capture_splits.read_captures(spark, str(tmp_path / "cut.pcap"), 2000).count() == 59
    (tmp_path / "empty.pcap").write_bytes(data[:24])
    assert capture_splits.read_captures(spark, str(tmp_path / "empty.pcap"), 2000).count() == 0
    (tmp_path / "x.pcap").write_bytes(b"no capture at all" * 9)
    with pytest.raises(Exception, match="not a packet capture"):
        capture_splits.read_captures(spark, str(tmp_path / "x.pcap"), 50).count()
    late = block_capture(frames(20)) + block(1, struct.pack("<HHI", 1, 0, 0))
    (tmp_path / "late.pcapng").write_bytes(late)
    with pytest.raises(Exception, match="split 0"):
        capture_splits.read_captures(spark, str(tmp_path / "late.pcapng"), 3000).count()
    assert capture_splits.read_captures(spark, str(tmp_path / "late.pcapng"), 0).count() == 22


def line(ts, **more):
    return json.dumps({"ts": ts, "uid": f"C{ts}", "id.orig_h": "1.1.1.1", "id.orig_p": 1, "id.resp_h": "2.2.2.2", "id.resp_p": 2, "proto": "tcp", **more}) + "\n"


def test_a_growing_log_loses_and_repeats_no_line(spark, tmp_path):
    """Appends, half lines, rotation, truncation, restarts: each run goes on from the checkpoint of the one before."""
    log = tmp_path / "conn.log"

    def take():
        stream = tail.tail_log(spark, str(log), "conn", split=150)
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r["timestamp"] for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()) if (tmp_path / "out").exists() else []

    assert take() == []
    with log.open("a") as f:
        f.write(line(1.0) + "{broken\n\n" + line(2.0) + line(3.0)[:20])
    assert take() == [1.0, 2.0]
    with log.open("a") as f:
        f.write(line(3.0)[20:] + line(4.0))
    assert take() == [1.0, 2.0, 3.0, 4.0] == take()
    with log.open("a") as f:
        f.write(line(5.0))
    os.rename(log, tmp_path / "conn.log.1")
    log.write_text(line(6.0))
    assert take() == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    with log.open("a") as f:
        f.write(line(7.0))
    assert take()[-1] == 7.0
    log.write_text(line(8.0))  # truncated: shorter than what was read
    assert take() == [float(i) for i in range(1, 9)]


def test_pieces_of_a_log_hold_each_line_once(tmp_path):
    text = "".join(f"line {i} {'x' * (i % 37)}\n" for i in range(200))
    (tmp_path / "a.log").write_text(text)
    for split in (1, 13, 64, 10_000):
        reader = tail.TailReader(str(tmp_path / "a.log"), split)
        end = reader.latestOffset()
        rows = [r[0] for p in reader.partitions(reader.initialOffset(), end) for r in reader.read(p)]
        assert rows == text.splitlines() and end["byte"] == len(text)


def test_three_logs_come_out_in_order(spark, tmp_path):
    """Rows wait for the watermark and come by time and arrival; late ones come at once, with a flag."""
    kind = "timestamp double, name string"
    r = random.Random(4)
    streams = [spark.createDataFrame(sorted(((float(t), f"{s}{t}") for t in r.sample(range(100, 160), 30)), key=lambda x: x[0] + r.random() * 5), kind) for s in "abc"]
    buffer = ordered.ReleaseBuffer(spark, str(tmp_path / "o"), delay=8.0)
    rows = [s.collect() for s in streams]
    for n in range(6):
        some = [x for s in rows for x in s[n * 5 : n * 5 + 5]]
        buffer.take(spark.createDataFrame(some, kind).coalesce(1), n)
        buffer.take(spark.createDataFrame(some, kind).coalesce(1), n)  # a batch that runs again
    buffer.flush()
    got = buffer.released().orderBy("batch", "position").collect()
    assert sorted(x["name"] for x in got) == sorted(x["name"] for s in rows for x in s)
    on_time = [x["timestamp"] for x in got if not x["is_late"]]
    assert on_time == sorted(on_time)


def test_late_rows_come_at_once(spark, tmp_path):
    kind = "timestamp double, name string"
    buffer = ordered.ReleaseBuffer(spark, str(tmp_path / "o"), delay=1.0)
    for n, rows in enumerate(([(100.0, "a"), (109.0, "b")], [(99.0, "c"), (115.0, "d"), (None, "e")], [(109.0, "f"), (101.0, "g")])):
        buffer.take(spark.createDataFrame(rows, kind).coalesce(1), n)
    got = [(x["timestamp"], x["name"], x["is_late"]) for x in buffer.released().orderBy("batch", "position").collect()]
    assert got == [(100.0, "a", False), (None, "e", True), (99.0, "c", True), (109.0, "b", False), (101.0, "g", True), (109.0, "f", True)]
    assert buffer.late_rows() == 4
    buffer.flush()
    assert buffer.released().count() == 7
    folder = tmp_path / "in"
    spark.createDataFrame([(3.0, "x"), (1.0, "y")], kind).write.parquet(str(folder))
    query, other = ordered.release_in_order(spark.readStream.schema(kind).parquet(str(folder)), str(tmp_path / "p"), delay=0.0)
    query.awaitTermination()
    assert [x["name"] for x in other.released().orderBy("batch", "position").collect()] == ["y", "x"]


def test_logs_of_several_kinds_merge(spark, tmp_path):
    (tmp_path / "ssl.log").write_text(line(102.0, version="TLS 1.2"))
    (tmp_path / "conn.log").write_text(line(100.0) + line(105.0))
    (tmp_path / "dns.log").write_text(line(101.0, query="a.com") + line(101.0, query="b.com"))
    merged = logs.merge_logs(*[logs.read_json_log(spark, str(tmp_path / f"{k}.log"), k) for k in ("ssl", "conn", "dns")])
    buffer = ordered.ReleaseBuffer(spark, str(tmp_path / "o"), delay=1.0)
    buffer.take(merged.coalesce(1), 0)
    got = buffer.released().orderBy("batch", "position").collect()
    assert [(x["timestamp"], x["dns"] and x["dns"]["query_name"]) for x in got] == [(100.0, None), (101.0, "a.com"), (101.0, "b.com"), (102.0, None)]
