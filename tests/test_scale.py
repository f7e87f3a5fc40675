"""Operators whose keys may be hot, and those that hold what plain Python says on the same rows."""

import collections
import ipaddress
import math
import random

import pytest
from pyspark.sql import functions as F

from sentriflow.config import DEFAULTS, config
from sentriflow.functions import lexical
from sentriflow.operators import alerts as A
from sentriflow.operators import baselines, evaluation, windows
from sentriflow.plans import views


def observations(n, seed=1, hosts=5):
    r = random.Random(seed)
    return [(i, r.randrange(0, 40) * 1_000_000, r.choice(["a", "a", "b", None]), r.choice([*map(str, range(hosts)), None, ""]), r.choice([80, 443, None]), float(r.randrange(100)), r.randrange(5), r.choice([0.0, 1.5, None])) for i in range(n)]


KIND = "id long, us long, src string, dst string, dport int, bytes double, packets long, duration double"


def entropy(values):
    n = len(values)
    return -sum(c / n * math.log2(c / n) for c in collections.Counter(values).values())


@pytest.mark.parametrize("chunk", [100_000, 7])
def test_windows_against_plain_python(spark, monkeypatch, chunk):
    monkeypatch.setattr(windows, "CHUNK_ROWS", chunk)
    rows = observations(150)
    df = spark.createDataFrame(rows, KIND).repartition(3)
    got = {r["id"]: r for r in windows.source_features(df, (3, 10)).collect()}
    back = {r["id"]: r for r in windows.destination_features(df, (3, 10)).collect()}
    assert len(got) == len(back) == len(rows)
    for i, us, src, dst, *_ in rows:
        for w in (3, 10):
            own = [x for x in rows if x[2] == src and us - w * 1_000_000 <= x[1] <= us]
            r, hosts, ports = got[i], [x[3] or "" for x in own], [x[4] or 0 for x in own]
            longer = [x[7] for x in own if x[7]]
            assert (r[f"src_conn_count_{w}s"], r[f"src_uniq_dst_hosts_{w}s"], r[f"src_uniq_dst_ports_{w}s"], r[f"src_uniq_host_port_pairs_{w}s"]) == (len(own), len(set(hosts)), len(set(ports)), len(set(zip(hosts, ports))))
            assert r[f"src_bytes_out_{w}s"] == pytest.approx(sum(x[5] for x in own)) and r[f"src_pkts_out_{w}s"] == sum(x[6] for x in own)
            assert r[f"src_avg_flow_dur_{w}s"] == (pytest.approx(sum(longer) / len(longer)) if longer else None)
            assert r[f"src_dst_entropy_{w}s"] == pytest.approx(entropy(hosts), abs=1e-9)
            to = [x[2] or "" for x in rows if x[3] == dst and us - w * 1_000_000 <= x[1] <= us]
            share = entropy(to) / math.log2(len(set(to))) if len(set(to)) > 1 else 0.0
            b = back[i]
            assert (b[f"dst_conn_count_{w}s"], b[f"dst_uniq_src_hosts_{w}s"]) == (len(to), len(set(to))) and b[f"dst_src_concentration_{w}s"] == pytest.approx(1 - min(1.0, share), abs=1e-9)


@pytest.mark.parametrize("parts, chunk", [(1, 100_000), (3, 5), (8, 20)])
def test_windows_with_odd_values(spark, monkeypatch, parts, chunk):
    """Null times, infinities and very large values, clashing names, however the keys are dealt out."""
    monkeypatch.setattr(windows, "CHUNK_ROWS", chunk)
    inf = float("inf")
    rows = [(i, None if i % 9 == 4 else (i * 37 % 50) * 1_000_000, "abcz"[i % 4], str(i % 5), 80, [1e20, inf, -inf, 0.25, 0.5, float("nan"), None, 1e-3][i * 7 % 8], i % 5, [inf, 1.5, None][i % 3], 1, "x", 3.0, 4) for i in range(120)]
    df = spark.createDataFrame(rows, KIND + ", _own int, _slice string, _net double, _row int").repartition(parts)
    found = windows.source_features(df, (5, 20))
    got = {r["id"]: r for r in found.collect()}
    counts = {r["id"]: (r["src_conn_count_5s"], r["src_conn_count_20s"]) for r in windows.source_features(df, (5, 20), ["src_conn_count"]).collect()}
    assert len(got) == len(rows) == found.count() and found.columns[: len(df.columns)] == df.columns and {r["_slice"] for r in got.values()} == {"x"}
    for i, us, src, *_ in rows:
        for k, w in enumerate((5, 20)):
            r, own = got[i], [x for x in rows if us is not None and x[1] is not None and x[2] == src and us - w * 1_000_000 <= x[1] <= us]
            if us is None:
                assert {r[f"{n}_{w}s"] for n in windows.SOURCE} == {None} and counts[i][k] is None
                continue
            total, longer = math.fsum(x for x in (y[5] for y in own) if x is not None and math.isfinite(x)), [x[7] for x in own if x[7]]
            ends = {x[5] for x in own} & {inf, -inf}
            assert r[f"src_bytes_out_{w}s"] == (None if len(ends) == 2 else ends.pop() if ends else pytest.approx(total))
            assert r[f"src_conn_count_{w}s"] == counts[i][k] == len(own) and r[f"src_avg_flow_dur_{w}s"] == (inf if inf in longer else 1.5 if longer else None)
    rate = {r["id"]: r["rate"] for r in windows.burst_rate(df, "src", "us", 5).collect()}
    assert rate == {i: None if c is None else c / 5 for i, (c, _) in counts.items()}


def test_windows_of_nothing(spark):
    assert windows.source_features(spark.createDataFrame([], KIND)).collect() == []


def test_a_source_with_most_rows(spark):
    """20,000 rows of one source within ten seconds: the windows take in all of them."""
    df = spark.range(20_000).select("id", (F.col("id") * 500).alias("us"), F.lit("a").alias("src"), (F.col("id") % 100).cast("string").alias("dst"), F.lit(80).alias("dport"), F.lit(1.0).alias("bytes"), F.lit(1).alias("packets"), F.lit(1.0).alias("duration"))
    last = windows.source_features(df, (60,)).orderBy(F.desc("id")).first()
    assert (last["src_conn_count_60s"], last["src_uniq_dst_hosts_60s"], last["src_bytes_out_60s"]) == (20_000, 100, 20_000.0) and last["src_dst_entropy_60s"] == pytest.approx(math.log2(100))


def test_host_baselines_in_order_whatever_the_batches(spark):
    rows = [("a" if i % 3 else "b", f"d{i % 4}", float(i % 7), i * 7_000.0, i) for i in range(400)]
    df = spark.createDataFrame(rows, "src string, dst string, bytes double, seconds double, id long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        got = {r["id"]: r for r in baselines.host_baseline(df, ["seconds", "id"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for s in "ab":
        size, day, today, began, known = 0.0, 0.0, 0.0, None, set()
        for n, (_, dst, b, t, i) in enumerate([x for x in rows if x[0] == s], 1):
            size = b if size == 0 else 0.05 * b + 0.95 * size
            began = t if began is None else began
            if t - began > 86_400:
                day, today, began = (today if day == 0 else 0.05 * today + 0.95 * day), 0.0, t
            today += b
            want = (pytest.approx(size), pytest.approx(day), pytest.approx(today), dst not in known, "BASELINE_" + ("INSUFFICIENT" if n < 50 else "WARMING" if n < 150 else "AVAILABLE"))
            known.add(dst)
            r = got[i]
            assert (r["avg_flow_size_bytes"], r["avg_daily_bytes"], r["current_day_bytes"], r["is_destination_novel"], r["baseline_state"]) == want


def plain_incidents(rows):
    """Incidents by the greedy rule over all alerts in order, as lists of (id, strength or None)."""
    c, order = DEFAULTS["correlation"], DEFAULTS["correlation"]["order"]
    open_: list = []
    everything = []
    for i, t, threat, src, dst in sorted(rows, key=lambda x: (x[1], x[0])):
        open_ = [x for x in open_ if t - x["last"] <= c["expire"]]
        twin = next((x for x in open_ if any(abs(t - u) <= c["dedup"] for u in x["seen"].get((threat, src, dst), []))), None)
        if twin:
            twin["last"] = max(twin["last"], t)
            twin["ids"].append((i, None))
            continue
        best, top = None, 0.0
        for x in open_:
            gap = abs(t - x["last"])
            near = 1.0 if gap <= c["near"] else 0.0 if gap >= c["window"] else 1 - (gap - c["near"]) / (c["window"] - c["near"])
            before = threat in order and any(y in order and order.index(y) < order.index(threat) for y in x["threats"])
            stage = 1.0 if before else 0.5 if threat in order and threat not in x["threats"] else 0.0
            score = min(1.0, 0.35 * (src in x["sources"]) + 0.30 * (dst in x["destinations"]) + 0.20 * near + 0.15 * stage)
            if score > top:
                best, top = x, score
        ok = best is not None and top >= c["merge"] and (not src or src in best["sources"] or top >= c["multi_host"])
        if not ok:
            best, top = {"ids": [], "seen": {}, "sources": set(), "destinations": set(), "threats": set(), "last": t}, 1.0
            open_.append(best)
            everything.append(best)
        best["last"] = max(best["last"], t)
        best["sources"].add(src)
        best["destinations"].add(dst)
        best["threats"].add(threat)
        best["seen"].setdefault((threat, src, dst), []).append(t)
        best["ids"].append((i, top))
    return everything


def compare_incidents(alerts, **how):
    rows = [(r["id"], r["timestamp"], r["threat_class"], r["source_ip"], r["destination_ip"]) for r in alerts.collect()]
    got = collections.defaultdict(dict)
    for r in A.correlate(alerts, **how).collect():
        got[r["incident_key"]][r["id"]] = r["correlation_strength"]
    want = [dict(x["ids"]) for x in plain_incidents(rows)]
    key = lambda x: min(x)
    for a, b in zip(sorted(got.values(), key=key), sorted(want, key=key), strict=True):
        assert a == {i: s if s is None else pytest.approx(s) for i, s in b.items()}


@pytest.mark.parametrize("slice_rows", [200_000, 300])
def test_incidents_of_the_test_table_against_one_plain_fold(spark, sf, slice_rows):
    """The table is one component: whole, and in slices of which no task has more than one."""
    compare_incidents(views.alerts(spark, sf).withColumn("id", F.col("id").cast("string")), slice_rows=slice_rows)


def test_incidents_of_close_alerts_against_one_plain_fold(spark):
    r = random.Random(5)
    kinds = [*DEFAULTS["correlation"]["order"], "DDoS"]
    rows = [(f"{i:04d}", r.choice([100.0, 3000.0, 90_000.0]) * r.random() + i * 200.0, r.choice(kinds), r.choice("abc"), r.choice("xyz")) for i in range(250)]
    df = spark.createDataFrame(rows, "id string, timestamp double, threat_class string, source_ip string, destination_ip string")
    compare_incidents(df)
    compare_incidents(df, slice_rows=40)
    with pytest.raises(ValueError):
        A.correlate(df, config(correlation={"merge": 0.3}))


@pytest.mark.parametrize("chars", ["2001:db8::1", "2001:DB8:0:1:2:3:4:5", "::1", "fe80::1:2:3:4", "1:0:0:2:3:4:5:6", "0:0:0:1::", "::ffff:1.2.3.4", "1::2::3", "12345::", "a:b", "::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "10.1.2.3", "10.1.2.300", "x", ":::"])
def test_subnets_are_canonical(spark, chars):
    try:
        want = str(ipaddress.ip_network(f"{chars}/{24 if '.' in chars and ':' not in chars else 64}", strict=False))
    except ValueError:
        want = chars
    assert spark.createDataFrame([(chars,)], "ip string").select(lexical.subnet(F.col("ip"))).first()[0] == want


def test_versions_and_fields(spark):
    old = ["TLS 1.0", "TLS 1.1", "SSL 3.0", "SSL3.0", "TLSv1", "TLSv1.0", "TLSv1.1", "SSLv3"]
    names = {**dict.fromkeys(old, "old"), **dict.fromkeys(["TLS 1.2", "TLSv1.2", "TLSv12", "tls1.2"], "tls12"), **dict.fromkeys([" tls 1.3 ", "TLSv1.3", "TLSv13", "TLS1.3"], "tls13"), **dict.fromkeys(["SSLv2", "tlsv11", "tls1.1", "tls1.0", "x", None])}
    df = spark.createDataFrame([(n,) for n in names], "v string")
    assert {r["v"]: r["k"] for r in df.select("v", lexical.tls_class(F.col("v")).alias("k")).collect()} == names
    fields = spark.createDataFrame([(" - ",), ("(empty)\\t".replace("\\t", "\t"),), (" a b ",), ("",), (None,)], "v string")
    assert [r[0] for r in fields.select(lexical.null_field(F.col("v"))).collect()] == [None, None, "a b", None, None]


def test_truth_by_address_composition_and_counters(spark):
    pairs = {("203.0.113.9", "x"): "DDoS", ("192.168.1.50", "103.45.67.89"): "C2_Beacon", ("192.168.1.50", "10.0.0.10"): "Reconnaissance", ("192.168.1.50", "8.8.8.8"): "DNS_DGA", ("192.168.1.52", None): "Encrypted_Anomaly", ("192.168.1.53", "103.45.67.89"): "Exfiltration", (None, None): "Benign", ("203.0.1139", "y"): "Benign"}
    df = spark.createDataFrame(list(pairs), "s string, d string").withColumn("truth", evaluation.address_truth(F.col("s"), F.col("d")))
    assert {(r["s"], r["d"]): r["truth"] for r in df.collect()} == pairs
    assert {r["truth"]: (r["n"], r["share"]) for r in evaluation.composition(df, "truth").collect()}["Benign"] == (2, 0.25)
    calls = spark.createDataFrame([("A", 1.0, True), ("A", 3.0, False), ("A", 2.0, None), ("B", None, None)], "detector string, latency_ms double, is_tp boolean")
    assert sorted(map(tuple, evaluation.detector_counters(calls).collect())) == [("A", 3, 2.0, 1, 1), ("B", 1, 0.0, 0, 0)]


def test_area_under_the_curve(spark):
    r = random.Random(2)
    rows = [(r.randrange(20) / 20 + 0.2 * y, y) for y in (r.randrange(2) for _ in range(300))]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    got = evaluation.roc_auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    assert (got["positives"], got["negatives"], got["auc"]) == (len(pos), len(neg), pytest.approx(want))
    assert evaluation.roc_auc(spark.createDataFrame([(0.5, 1)], "s double, y int"), "s", "y").first()["auc"] is None


def test_explanations(spark):
    df = spark.createDataFrame([("HIGH", ["s"], ["A", "B"], True, True, False), ("LOW", ["s", "t"], [], False, False, True), ("LOW", ["s"], ["A", "B", "C"], False, True, False)], "level string, sources array<string>, kinds array<string>, t boolean, c boolean, p boolean")
    text = [r[0] for r in df.select(A.risk_explanation(*[F.col(c) for c in df.columns])).collect()]
    assert text == [
        "High risk was assigned because a single internal source generated A, and B. These events occurred within a tightly correlated time window and flagged by multiple independent detectors. The observed indicators form a potentially related sequence of high-risk behavior.",
        "Low risk was assigned because multiple internal sources generated suspicious network behavior. The sequence of these indicators is consistent with potentially malicious multi-stage activity.",
        "Low risk was assigned because a single internal source generated A, B, and C. These events occurred flagged by multiple independent detectors.",
    ]


@pytest.mark.parametrize("parts", [1, 7])
def test_ranks_by_ranges_of_values(spark, parts):
    """The value at int(n q) of the sorted ones, of a group that holds nearly all rows."""
    r = random.Random(8)
    rows = [("a" if i % 50 else r.choice(["b", None]), r.choice([r.random(), 0.5, None, 1.0])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(parts)
    got = {x["k"]: x for x in evaluation.nearest_rank(df, ["k"], "x", (0.0, 0.5, 0.9, 1.0)).collect()}
    for k in ("a", "b", None):
        own = sorted(x for g, x in rows if g == k and x is not None)
        want = [own[min(len(own) - 1, int(len(own) * q))] for q in (0.0, 0.5, 0.9, 1.0)]
        assert [got[k][f"p{q}"] for q in (0, 50, 90, 100)] == want and (got[k]["n"], got[k]["min"], got[k]["max"]) == (len(own), own[0], own[-1]) and got[k]["mean"] == pytest.approx(sum(own) / len(own))
    whole = evaluation.nearest_rank(df, [], "x").first()
    own = sorted(x for _, x in rows if x is not None)
    assert (whole["n"], whole["p50"], whole["p99"]) == (len(own), own[len(own) // 2], own[int(len(own) * 0.99)])
    assert evaluation.nearest_rank(df.filter("false"), ["k"], "x").collect() == []


def test_sketches_merge(spark):
    xs = [float((i * 7919) % 10_007) for i in range(10_007)]
    df = spark.createDataFrame([(i % 3, x, i // 2000) for i, x in enumerate(xs)], "k int, x double, day int")
    days = evaluation.latency_sketches(df, ["k", "day"], "x")
    assert days.count() == 18
    got = {r["k"]: r for r in evaluation.merged_quantiles(days, ["k"], (0.5, 0.95)).collect()}
    for k in range(3):
        own = sorted(x for i, x in enumerate(xs) if i % 3 == k)
        assert got[k]["n"] == len(own) and all(abs(sum(x <= got[k][f"p{p}"] for x in own) / len(own) - p / 100) < 0.02 for p in (50, 95))
