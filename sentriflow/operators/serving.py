"""Read queries over alert and incident tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

THREATS = ("DDoS", "Reconnaissance", "C2_Beacon", "DNS_DGA", "DNS_Tunnel", "EncryptedAnomaly", "Exfiltration")
PHASES = {"Reconnaissance": "Reconnaissance", "C2_Beacon": "Command & Control", "DNS_DGA": "Command & Control", "DNS_Tunnel": "Command & Control", "EncryptedAnomaly": "Command & Control", "Exfiltration": "Exfiltration", "DDoS": "Impact (DoS)"}


def recent_alerts(alerts: DataFrame, source_ip=None, severity=None, threat_class=None, limit: int = 50, offset: int = 0, tie: str = "id") -> DataFrame:
    """Alerts that meet all given conditions, the latest first, one page of them."""
    for column, value in (("source_ip", source_ip), ("severity", severity), ("threat_class", threat_class)):
        if value is not None:
            alerts = alerts.filter(F.col(column) == value)
    return alerts.orderBy(F.desc("timestamp"), tie).offset(offset).limit(limit)


def active_incidents(incidents: DataFrame, source_ip=None) -> DataFrame:
    rows = incidents.filter(F.col("status").isin("NEW", "INVESTIGATING"))
    return rows if source_ip is None else rows.filter(F.array_contains("sources", source_ip))


def top_incidents(incidents: DataFrame, limit: int = 100, offset: int = 0, by: str = "risk_score", tie: str = "incident_id") -> DataFrame:
    return incidents.orderBy(F.desc(by), tie).offset(offset).limit(limit)


def incident(incidents: DataFrame, incident_id: str, id_col: str = "incident_id") -> DataFrame:
    return incidents.filter(F.col(id_col) == incident_id)


def with_alerts(incidents: DataFrame, links: DataFrame, alerts: DataFrame, key: str = "incident_key") -> DataFrame:
    """Incidents with their alerts as an array by time."""
    members = links.join(alerts, "id").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("timestamp", "id", "threat_class", "severity", "detection_score"))).alias("alerts"))
    return incidents.join(members, key, "left")


def evidence_rows(alerts: DataFrame) -> DataFrame:
    """One row per piece of evidence."""
    return alerts.select(F.col("id").alias("alert_id"), F.explode("evidence").alias("e")).select("alert_id", "e.*")


def detector_stats(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("detector").agg(
        F.count(F.lit(1)).alias("detections"), F.avg("confidence").alias("avg_confidence"), F.avg("processing_latency").alias("avg_latency"), F.max(F.col("ml_available").cast("int")).alias("ml_available")
    )


def threat_counts(alerts: DataFrame, threats: tuple[str, ...] = THREATS) -> DataFrame:
    """Alerts per threat, 0 for those without; the list of threats is fixed and small."""
    spark = alerts.sparkSession
    names = spark.createDataFrame([(t,) for t in threats], "threat_class string")
    counts = alerts.groupBy("threat_class").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "threat_class", "left").select("threat_class", F.coalesce("n", F.lit(0)).alias("detections"))


def host_priority(alerts: DataFrame) -> DataFrame:
    """Per source: alerts, different behaviours, and threat and certainty scores of 99 at most; the most threatening first."""
    points = F.when(F.col("severity") == "CRITICAL", 30).when(F.col("severity") == "HIGH", 20).when(F.col("severity") == "MEDIUM", 10).otherwise(5)
    out = alerts.groupBy("source_ip").agg(
        F.count(F.lit(1)).alias("alerts"), F.count_distinct("threat_class").alias("behaviours"), F.least(F.lit(99), F.sum(points)).alias("threat"), F.least(F.lit(99.0), F.sum(15 * F.col("detection_score"))).alias("certainty")
    )
    return out.orderBy(F.desc("threat"), F.desc("certainty"), "source_ip")


def attack_phases(counts: DataFrame, phases: dict[str, str] = PHASES) -> DataFrame:
    """Detections per phase of an attack."""
    name = F.element_at(F.create_map(*[F.lit(x) for kv in phases.items() for x in kv]), F.col("threat_class"))
    return counts.withColumn("phase", name).filter("phase IS NOT NULL").groupBy("phase").agg(F.sum("detections").alias("detections"))


def timeline(alerts: DataFrame, unit: str = "minute", time: str = "ts") -> DataFrame:
    return alerts.groupBy(F.date_trunc(unit, time).alias("bucket"), "severity").agg(F.count(F.lit(1)).alias("alerts"))


def kpis(alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    a = alerts.agg(F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("severity") == "CRITICAL").alias("critical_alerts"))
    i = incidents.agg(F.count(F.lit(1)).alias("incidents"), F.count_if(F.col("status").isin("NEW", "INVESTIGATING")).alias("active_incidents"))
    return a.withColumn("_k", F.lit(1)).join(i.withColumn("_k", F.lit(1)), "_k").drop("_k")


def rates_per_minute(events: DataFrame, time: str = "ts", latency: str = "latency") -> DataFrame:
    """Tumbling one-minute rates and latency percentiles, as a metrics dashboard records them."""
    w = events.groupBy(F.window(time, "1 minute").alias("w")).agg((F.count(F.lit(1)) / 60.0).alias("per_second"), F.percentile_approx(latency, [0.95, 0.99]).alias("_p"))
    return w.select(F.col("w.start").alias("minute"), "per_second", F.get("_p", F.lit(0)).alias("p95"), F.get("_p", F.lit(1)).alias("p99"))


def running_latency(rows: DataFrame, order: list[str], latency: str = "latency", by: list[str] | None = None, last: int = 1000) -> DataFrame:
    """Per group: flows, the running latency average after its last row (0.9 old, 0.1 new; the first value sets it), and P50, P95 and P99 of the last `last` rows.

    A row's share in the average is below the last place of a double after so many more, so the last ones give it whole; the percentile is the value at index
    int(n * share) of the sorted ones.
    """
    by = by or []
    ranked = rows.filter(F.col(latency).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])))
    ring = ranked.filter(F.col("_r") <= last).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("r"), F.col(latency).cast("double").alias("x")))).alias("_l"))
    values = F.transform("_l", lambda e: e["x"])
    mean = F.aggregate(F.slice(values, 2, last), F.get(values, F.lit(0)), lambda m, x: m * 0.9 + x * 0.1)
    at = lambda q: F.get(F.array_sort(values), F.floor(F.size("_l") * q).cast("int"))
    found = ring.select(*by, mean.alias("latency"), *[at(q / 100).alias(f"latency_p{q}") for q in (50, 95, 99)])
    counts = rows.filter(F.col(latency).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("flows"))
    return found.join(counts, by) if by else found.withColumn("_k", F.lit(1)).join(counts.withColumn("_k", F.lit(1)), "_k").drop("_k")
