"""Detector evaluation: confusion counts, percentiles, ground-truth joins and error causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

CTU_PORTS = (80, 443, 6667, 8080, 8443)


def confusion(df: DataFrame, truth: Column, predicted: Column, by: list[str] | None = None, undefined: float | None = 0.0) -> DataFrame:
    """tp, fp, tn, fn and the usual ratios per group; `undefined` is what a ratio of nothing is."""
    t, p = F.coalesce(truth, F.lit(False)), F.coalesce(predicted, F.lit(False))
    counts = df.groupBy(*(by or [])).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))
    c = F.col
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(undefined).cast("double"))
    out = counts.withColumns({
        "precision": ratio(c("tp"), c("tp") + c("fp")), "recall": ratio(c("tp"), c("tp") + c("fn")), "accuracy": ratio(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")),
        "specificity": ratio(c("tn"), c("tn") + c("fp")), "fpr": ratio(c("fp"), c("fp") + c("tn")), "fnr": ratio(c("fn"), c("fn") + c("tp")),
    })
    return out.withColumn("f1", ratio(2 * c("precision") * c("recall"), c("precision") + c("recall")))


def false_positive_ratio(metrics: DataFrame, limit: float = 0.15) -> DataFrame:
    return metrics.withColumn("fp_ratio", 1 - F.col("precision")).withColumn("warn", F.col("fp_ratio") > limit)


def nearest_rank(df: DataFrame, by: list[str], value: str, shares: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Per group: n, min, max, mean, and the value at index int(n * share) of the sorted values, the last one at most. Nulls don't count; a null group is one.

    Values are counted by different values first, map-side. These are dealt out by ranges of group and value, so a group that holds all rows is many tasks: each has its own running counts, and a
    table of a row per task and group gives the counts before it. The groups' sums are joined back as whole rows a group.
    """
    keys = [F.struct(*[F.col(f"`{c}`") for c in by]).alias("_g") if by else F.struct(F.lit(0).alias("_0")).alias("_g")]
    counts = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v")).groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_c"))
    counts = written(counts.repartitionByRange("_g", "_v").sortWithinPartitions("_g", "_v").withColumn("_part", F.spark_partition_id()), "ranks")
    parts = counts.groupBy("_part", "_g").agg(F.sum("_c").alias("_s"))
    parts = parts.withColumn("_before", F.sum("_s").over(Window.partitionBy("_g").orderBy("_part")) - F.col("_s"))
    whole = counts.groupBy("_g").agg(F.sum("_c").alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean"))
    offsets = parts.join(whole.select(F.col("_g").alias("_w"), F.col("n").alias("_n")), F.col("_g").eqNullSafe(F.col("_w"))).select(F.col("_part").alias("_p"), F.col("_g").alias("_h"), "_before", "_n")
    inside = F.sum("_c").over(Window.partitionBy("_part", "_g").orderBy("_v"))
    ranked = counts.withColumn("_to", inside).join(offsets, (F.col("_part") == F.col("_p")) & F.col("_g").eqNullSafe(F.col("_h")))
    ranked = ranked.withColumn("_to", F.col("_to") + F.col("_before"))
    at = lambda q: F.least(F.floor(F.col("_n") * q), F.col("_n") - 1)
    pick = ranked.groupBy("_g").agg(*[F.min(F.when(F.col("_to") > at(q), F.col("_v"))).alias(f"p{round(q * 100)}") for q in shares])
    out = whole.join(pick.withColumnRenamed("_g", "_q"), F.col("_g").eqNullSafe(F.col("_q")))
    return out.select(*[F.col(f"_g.`{c}`").alias(c) for c in by], "n", "min", "max", "mean", *[f"p{round(q * 100)}" for q in shares])


def latency_sketches(df: DataFrame, by: list[str], value: str, size: int = 400) -> DataFrame:
    """Per group a quantile sketch (KLL) of its values, some kilobytes whatever their number: for running percentiles that are kept and merged later."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, by: list[str], shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Number of values and quantiles per group of kept sketches; at a size of 400 within a rank error of about 1 %."""
    whole = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("_s"))
    return whole.select(*by, F.kll_sketch_get_n_double("_s").alias("n"), *[F.kll_sketch_get_quantile_double("_s", F.lit(q)).alias(f"p{round(q * 100)}") for q in shares])


def interpolated(df: DataFrame, by: list[str], value: str, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Per group: mean, interpolated percentiles, and rows a second at this mean (values in milliseconds)."""
    pick = [F.percentile(value, q).alias(f"p{round(q * 100)}") for q in shares]
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), *pick, F.try_divide(F.lit(1000.0), F.avg(value)).alias("throughput"))


def botnet_class(proto: Column, sport: Column, dport: Column, packets: Column, size: Column, length: Column) -> Column:
    """The threat that a labelled botnet flow stands for, by its traffic."""
    p = F.lower(proto)
    return (
        F.when((p == "udp") & (packets > 100), "DDoS")
        .when((p == "tcp") & dport.isin(*CTU_PORTS) & (length > 0) & (packets < 100), "C2_Beacon")
        .when((p == "udp") & ((sport == 53) | (dport == 53)), "DNS_DGA")
        .when((p == "tcp") & (size > 1_000_000), "Exfiltration")
        .otherwise("UNCLASSIFIED")
    )


# Names of error causes.
ZERO_DURATION = "zero duration"
SPARSE_PACKETS = "sparse packet count"
PERIODICITY = "periodicity boundary (insufficient connections)"
WARM_UP = "schema incompatibility (synthetic short warmup traffic)"
UNKNOWN_CAUSE = "unknown"


def error_cause(detector: Column, kind: Column, length: Column, packets: Column) -> Column:
    """Why a detector was wrong: the first of the causes that holds. Null durations and packet counts hold none."""
    return (
        F.when(length == 0, ZERO_DURATION)
        .when(packets <= 3, SPARSE_PACKETS)
        .when(detector == "C2_Beacon", PERIODICITY)
        .when((detector == "Encrypted_Anomaly") & (kind == "FP"), WARM_UP)
        .otherwise(UNKNOWN_CAUSE)
    )


def error_causes(errors: DataFrame) -> DataFrame:
    """Counts by detector and cause, a column for false positives and one for false negatives."""
    return errors.groupBy("detector", "cause").pivot("kind", ["FP", "FN"]).agg(F.count(F.lit(1))).fillna(0, ["FP", "FN"])


def _pair(src: str, dst: str) -> Column:
    return F.struct(F.lower(F.trim(src)).alias("s"), F.lower(F.trim(dst)).alias("d"))


def matched(alerts: DataFrame, truth: DataFrame, how: str = "left_semi") -> DataFrame:
    """Alerts whose (source, destination) is in the ground truth, or isn't with how='left_anti'."""
    known = truth.select(_pair("source_ip", "destination_ip").alias("_k")).distinct()
    return alerts.withColumn("_k", _pair("source_ip", "destination_ip")).join(known, "_k", how).drop("_k")


def compare(a: DataFrame, b: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Two reports side by side, with differences b - a."""
    left = a.select(key, *[F.col(m).alias(f"{m}_a") for m in metrics])
    right = b.select(key, *[F.col(m).alias(f"{m}_b") for m in metrics])
    return left.join(right, key).withColumns({f"{m}_diff": F.col(f"{m}_b") - F.col(f"{m}_a") for m in metrics})


def duration_summary(flows: DataFrame, column: str = "flow_duration") -> DataFrame:
    return flows.agg(F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"), F.median(column).alias("median"), F.avg(F.when(F.col(column) == 0, 1.0).otherwise(0.0)).alias("zero_share"))


def label_profile(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(column).contains("flow=Botnet")).alias("botnet"), F.count_if(F.col(column).contains("flow=Normal")).alias("normal"), F.count_if(F.col(column).startswith("StartTime")).alias("headers"))


def dataset_status(packets: Column, labels: Column, botnet: Column, normal: Column) -> Column:
    return (
        F.when(packets.isNull() & labels.isNull(), "INVALID")
        .when(packets.isNull() | labels.isNull(), "PARTIALLY_AVAILABLE")
        .when((botnet > 0) & (normal > 0), "VALID")
        .when((botnet + normal) > 0, "AVAILABLE")
        .otherwise("INSUFFICIENT_DATA")
    )


# The roles of addresses in the demonstration capture; None stands for any address.
DEMO_TRUTH = (
    (r"^203\.0\.113\.", None, "DDoS"),
    (r"^192\.168\.1\.50$", r"^103\.45\.67\.89$", "C2_Beacon"),
    (r"^192\.168\.1\.50$", r"^10\.0\.0\.10$", "Reconnaissance"),
    (None, r"^8\.8\.8\.8$", "DNS_DGA"),
    (r"^192\.168\.1\.52$", None, "Encrypted_Anomaly"),
    (r"^192\.168\.1\.53$", r"^103\.45\.67\.89$", "Exfiltration"),
)


def address_truth(source: Column, destination: Column, rules: tuple = DEMO_TRUTH, other: str = "Benign") -> Column:
    """The class of the first rule (source pattern, destination pattern, class) that a flow's addresses match."""
    out, matches = F.lit(other), lambda c, p: F.lit(True) if p is None else F.coalesce(c, F.lit("")).rlike(p)
    for s, d, name in reversed(rules):
        out = F.when(matches(source, s) & matches(destination, d), name).otherwise(out)
    return out


def composition(df: DataFrame, label: str) -> DataFrame:
    """Rows of each class, and their share of all."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # over a row per class
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def detector_counters(detections: DataFrame, detector: str = "detector", latency: str = "latency_ms", hit: str = "is_tp") -> DataFrame:
    """Per detector: calls, mean latency, and true and false positives, which only calls with a verdict in `hit` count towards."""
    return detections.groupBy(detector).agg(
        F.count(F.lit(1)).alias("calls"), F.avg(F.coalesce(latency, F.lit(0.0))).alias("avg_latency_ms"), F.count_if(F.col(hit)).alias("true_positives"), F.count_if(~F.col(hit)).alias("false_positives")
    )


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """The area under the ROC curve: the share of pairs (positive, negative) in which the positive one scores higher, ties as half. Null without both classes.

    Rows are summed by score first; running sums go over different scores in ranges of them, not over rows in one task.
    """
    counts = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    counts = written(counts.repartitionByRange("s").sortWithinPartitions("s").withColumn("_part", F.spark_partition_id()), "roc")
    parts = counts.groupBy("_part").agg(F.sum("q").alias("_q"))
    parts = parts.select("_part", (F.sum("_q").over(Window.orderBy("_part")) - F.col("_q")).alias("_before"))
    below = F.sum("q").over(Window.partitionBy("_part").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)) - F.col("q") + F.col("_before")
    won = counts.join(F.broadcast(parts), "_part").withColumn("w", F.col("p") * (below + F.col("q") / 2))
    return won.agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.try_divide(F.sum("w"), F.sum("p").cast("double") * F.sum("q")).alias("auc"))
