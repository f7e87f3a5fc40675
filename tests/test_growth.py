"""What a task holds or reads doesn't grow with the table, and costly columns are computed once."""

import math
import random
import struct
from collections import Counter

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sentriflow.functions import lexical
from sentriflow.operators import models, windows
from sentriflow.sources import pcap
from sentriflow.storage import dealt


def test_fitting_computes_its_features_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def feature(i):
        seen.add(1)
        return float(i % 7)

    rows = spark.range(0, 200, 1, 4).withColumns({"label": (F.col("id") % 2).cast("int"), "x": feature("id")})
    models.train_forest(rows, array_to_vector(F.array("x")), trees=2, depth=2)
    assert seen.value == 200
    models.train_boosted(rows, array_to_vector(F.array("x")), rounds=2, depth=2)
    assert seen.value == 400


def test_dealt_partitions_keep_their_size(spark):
    for n in (1_000, 10_000):
        found = dealt(spark.range(n).withColumn("k", F.col("id") % (n // 4)), ["k"], 500)
        sizes = found.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("k")).collect()
        assert sum(r["n"] for r in sizes) == n and max(r["n"] for r in sizes) < 1_000 and sum(r["k"] for r in sizes) == n // 4


def test_captures_of_one_key_are_cut_at_a_size(spark):
    key = F.when(F.col("id") % 3 > 0, F.concat(F.lit("10.0.0."), (F.col("id") % 3).cast("string")))
    e = spark.range(90).select(key.alias("host"), (F.lit(1_000_000) * (F.lit(100) - F.col("id"))).alias("us"), F.lit("10.0.0.9").alias("source_ip"), F.lit("10.0.0.8").alias("destination_ip"), F.lit(1).alias("source_port"), F.lit(80).alias("destination_port"), F.lit(6).alias("protocol"), F.lit(2).alias("tcp_flags"), F.lit(b"xy").alias("payload"))
    found = pcap.to_captures(e, "host", 300)
    rows = found.collect()
    # a record of 72 bytes: five of them reach the size
    assert [sum(1 for r in rows if r["host"] == h) for h in (None, "10.0.0.1", "10.0.0.2")] == [6, 6, 6]
    for r in rows:
        times = [t for t, _, _ in pcap.packets(bytes(r["content"]))]
        assert len(times) == 5 and times == sorted(times) and struct.unpack_from("<I", r["content"])[0] == 0xA1B2C3D4
    assert sorted(r["timestamp"] for r in pcap.decode_captures(found).collect()) == [float(100 - i) for i in range(89, -1, -1)]
    assert [r["content"] for r in pcap.to_captures(e.filter("host = '10.0.0.1'"), "host").collect()][0][24:] == b"".join(bytes(r["content"])[24:] for r in sorted((r for r in rows if r["host"] == "10.0.0.1"), key=lambda r: next(pcap.packets(bytes(r["content"])))[0]))


def test_traffic_rates_deal_their_rows_out_once(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (2, 1_000_000, None), (3, 1_000_000, "a"), (4, 2_000_001, ""), (5, None, "b")], "id int, us long, src string")
    found = windows.traffic_rates(rows, seconds=1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Window" not in plan
    assert [(r["flows_per_second"], r["unique_sources"]) for r in found.orderBy("id").collect()] == [(1.0, 1), (3.0, 2), (3.0, 2), (1.0, 1), (None, None)]


def test_entropy_of_names_compares_no_pairs_of_characters(spark):
    r = random.Random(1)
    names = ["", None, "a", "aaaa", "aab", "abab.abab", "\U0001f600x\U0001f600", "\u00c4\u00e4.$(^[", "..", *("".join(r.choices("0123456789abcdefXYZ-.", k=r.randrange(60))) for _ in range(200))]
    found = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, s string").withColumns({"h": lexical.string_entropy(F.col("s")), "g": lexical.ngram_count_entropy(F.col("s"))})
    assert "filter(" not in found.select("h")._jdf.queryExecution().optimizedPlan().toString()

    def bits(counts):
        return max(0.0, sum(-c / sum(counts) * math.log2(c / sum(counts)) for c in counts))

    for row in found.collect():
        low = (row["s"] or "").lower()
        grams = Counter(low[i : i + 3] for i in range(len(low) - 2))
        assert math.isclose(row["h"], bits(list(Counter(low).values())), abs_tol=1e-12)
        assert math.isclose(row["g"], bits(list(Counter(grams.values()).values())), abs_tol=1e-12)
