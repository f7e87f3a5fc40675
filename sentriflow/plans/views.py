"""The test tables seen as network data: observations, alerts, host names and captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import severity


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """events as observations: a user is a source, props.k a destination, the type a port, the value the bytes."""
    e = table(spark, folder, "events")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return e.select(
        F.col("event_id").alias("id"), us.alias("us"), (us / 1e6).alias("seconds"), F.col("user_id").alias("src"), F.get_json_object("props", "$.k").alias("dst"),
        F.col("event_type").alias("dport"), F.col("value").alias("bytes"), (F.col("event_id") % 10 + 1).alias("packets"), ((F.col("event_id") % 7) * 1.5).cast("double").alias("duration"), "ts",
    )


OBS = """obs AS (SELECT event_id AS id, epoch_us(ts) AS us, epoch_us(ts) / 1e6 AS seconds, user_id AS src, json_extract_string(props, '$.k') AS dst, event_type AS dport,
  value AS bytes, event_id % 10 + 1 AS packets, (event_id % 7) * 1.5e0 AS duration, ts FROM events)"""


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    """events as alerts: the type gives the threat, the id score and confidence."""
    o = observations(spark, folder)
    threat = F.element_at(F.create_map(*[F.lit(x) for x in ("click", "Reconnaissance", "error", "C2_Beacon", "purchase", "Exfiltration", "signup", "DDoS", "view", "DNS_DGA")]), F.col("dport"))
    score, confidence = (F.col("id") % 101) / 100.0, (F.col("id") % 89) / 88.0


    rows = o.select(
        "id", "us", "seconds", "ts", F.col("seconds").alias("timestamp"), threat.alias("threat_class"), F.lower(threat).alias("detector"), F.lit("").alias("sub_type"),
        F.col("src").cast("string").alias("source_ip"), F.col("dst").alias("destination_ip"), score.cast("double").alias("detection_score"), confidence.cast("double").alias("confidence"),
        (F.col("id") % 3 == 0).alias("ml_available"), F.col("bytes").alias("processing_latency"), (F.col("id") % 17).alias("_m"),
    )
    quality = F.when(F.col("_m") == 0, "BASELINE_INSUFFICIENT").otherwise("BASELINE_AVAILABLE")
    return rows.withColumns({"severity": severity(F.col("detection_score")), "baseline_quality": quality, "incident_key": F.concat_ws("-", "source_ip", (F.col("us") / 86_400_000_000).cast("long").cast("string"))}).drop("_m")


ALERTS = (
    OBS
    + """, al AS (SELECT id, us, seconds, ts, seconds AS timestamp,
  CASE dport WHEN 'click' THEN 'Reconnaissance' WHEN 'error' THEN 'C2_Beacon' WHEN 'purchase' THEN 'Exfiltration' WHEN 'signup' THEN 'DDoS' WHEN 'view' THEN 'DNS_DGA' END AS threat_class,
  src::VARCHAR AS source_ip, dst AS destination_ip, (id % 101) / 100e0 AS detection_score, (id % 89) / 88e0 AS confidence, id % 3 = 0 AS ml_available, bytes AS processing_latency,
  CASE WHEN (id % 101) >= 88 THEN 'CRITICAL' WHEN (id % 101) >= 70 THEN 'HIGH' WHEN (id % 101) >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN id % 17 = 0 THEN 'BASELINE_INSUFFICIENT' ELSE 'BASELINE_AVAILABLE' END AS baseline_quality,
  src::VARCHAR || '-' || (us // 86400000000)::VARCHAR AS incident_key FROM obs)"""
)


def hosts(spark: SparkSession, folder: str) -> DataFrame:
    """The host names in the addresses of pages, as queries with a type by the page."""
    p = table(spark, folder, "pages")
    kinds = F.array(*[F.lit(x) for x in ("A", "AAAA", "TXT", "MX", "NS", "NULL", "ANY", "SRV")])
    return p.select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("qname"), F.get(kinds, (F.col("page_id") % 8).cast("int")).alias("qtype"))


HOSTS = "hosts AS (SELECT page_id, split_part(url, '/', 3) AS qname, (['A','AAAA','TXT','MX','NS','NULL','ANY','SRV'])[(page_id % 8 + 1)::INT] AS qtype FROM pages)"


def addresses(o: DataFrame) -> DataFrame:
    """Observations with IPv4 addresses and ports in place of names."""
    k = F.col("dst").cast("int")
    flags = F.element_at(F.create_map(*[x for kv in (("click", 2), ("view", 16), ("purchase", 17), ("error", 4), ("signup", 18)) for x in map(F.lit, kv)]), F.col("dport"))
    return o.select(
        F.col("id").alias("event_id"), "us", "seconds", F.concat(F.lit("10.0."), (F.col("src") % 200).cast("string"), F.lit("."), (F.col("src") % 250).cast("string")).alias("source_ip"),
        F.concat(F.lit("172.16."), (k % 7).cast("string"), F.lit("."), k.cast("string")).alias("destination_ip"), (F.lit(40000) + F.col("src") % 100).cast("int").alias("source_port"),
        (F.lit(80) + k % 3).cast("int").alias("destination_port"), F.when(F.col("id") % 4 == 0, 17).otherwise(6).alias("protocol"), flags.alias("tcp_flags"), (F.col("id") % 50 + 60).cast("int").alias("packet_length"),
    )


ADDRESSES = (
    OBS
    + """, adr AS (SELECT id AS event_id, us, seconds, '10.0.' || (src % 200)::VARCHAR || '.' || (src % 250)::VARCHAR AS source_ip, '172.16.' || (dst::INT % 7)::VARCHAR || '.' || dst AS destination_ip,
  40000 + src % 100 AS source_port, 80 + dst::INT % 3 AS destination_port, CASE WHEN id % 4 = 0 THEN 17 ELSE 6 END AS protocol,
  CASE dport WHEN 'click' THEN 2 WHEN 'view' THEN 16 WHEN 'purchase' THEN 17 WHEN 'error' THEN 4 WHEN 'signup' THEN 18 END AS tcp_flags, id % 50 + 60 AS packet_length FROM obs)"""
)
