"""Scores, bands and time functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULTS, Config


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def sigmoid(x: Column, steepness: float = 2.0) -> Column:
    return 1 / (1 + F.exp(-F.lit(steepness) * x))


def safe_divide(a: Column, b: Column, default=0.0) -> Column:
    return F.when(b == 0, F.lit(default)).otherwise(a / b)


def duration(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0.0))


def z_score(x: Column, mean: Column, variance: Column, count: Column, cfg: Config = DEFAULTS) -> Column:
    """Deviations from a baseline; null before it is warm. The deviation has a floor by the mean and one by itself."""
    e = cfg["ewma"]
    floor = F.greatest(F.abs(mean) * e["std_share"], F.lit(e["std_floor"]))
    return F.when(count >= e["warm_metric"], (x - mean) / F.greatest(F.sqrt(variance), floor))


def ratio_to(x: Column, mean: Column) -> Column:
    return F.when(mean > 0, x / mean)


def severity(score: Column, cfg: Config = DEFAULTS) -> Column:
    s = cfg["severity"]
    return F.when(score >= s["critical"], "CRITICAL").when(score >= s["high"], "HIGH").when(score >= s["medium"], "MEDIUM").otherwise("LOW")


def severity_rank(name: Column) -> Column:
    """Order of severities, UNCLASSIFIED lowest."""
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in ("LOW", "MEDIUM", "HIGH", "CRITICAL")]), name), F.lit(0)).cast("int")


def interval_periodicity(cv: Column, random_cv: float = DEFAULTS["c2"]["cv"]) -> Column:
    return F.when(cv.isNotNull(), clamp(1 - cv / random_cv))


def time_proximity(seconds: Column, cfg: Config = DEFAULTS) -> Column:
    c = cfg["correlation"]
    d = F.abs(seconds)
    return F.when(d <= c["near"], 1.0).when(d >= c["window"], 0.0).otherwise(1 - (d - c["near"]) / (c["window"] - c["near"]))


def sequence_match(threat: Column, seen: Column, cfg: Config = DEFAULTS) -> Column:
    """1 if the threat comes later in the usual order than one seen, 0.5 if it is another stage, else 0."""
    order = F.array(*[F.lit(x) for x in cfg["correlation"]["order"]])
    at = F.array_position(order, threat)
    earliest = F.array_min(F.filter(F.transform(seen, lambda s: F.array_position(order, s)), lambda i: i > 0))
    other = (F.size(seen) > 0) & ~F.array_contains(seen, threat)
    return F.when(F.coalesce(at, F.lit(0)) == 0, 0.0).when(earliest < at, 1.0).when(other, 0.5).otherwise(0.0)


def progression(seen: Column, cfg: Config = DEFAULTS) -> Column:
    """The stages seen, in their usual order."""
    return F.filter(F.array(*[F.lit(x) for x in cfg["correlation"]["order"]]), lambda s: F.array_contains(seen, s))


def pair_score(same_source: Column, same_destination: Column, seconds: Column, sequence: Column, cfg: Config = DEFAULTS) -> Column:
    w = cfg["correlation"]["weights"]
    parts = F.when(same_source, w[0]).otherwise(0.0) + F.when(same_destination, w[1]).otherwise(0.0)
    return F.least(F.lit(1.0), parts + time_proximity(seconds, cfg) * w[2] + sequence * w[3])


def risk_level(score: Column, cfg: Config = DEFAULTS) -> Column:
    """Bands without gaps: each begins where the one below ends."""
    out = F.when(F.lit(False), "")
    for low, name, _ in cfg["risk"]["levels"]:
        out = out.when(score >= low, name)
    return out.otherwise("INFORMATIONAL")


def risk_priority(score: Column, cfg: Config = DEFAULTS) -> Column:
    out = F.when(F.lit(False), "")
    for low, _, priority in cfg["risk"]["levels"]:
        out = out.when(score >= low, priority)
    return out.otherwise("P4")


def decayed(score: Column, last_seen: Column, as_of: Column, cfg: Config = DEFAULTS) -> Column:
    """The score after days without activity: less by a share a day from the second day on, not below the floor."""
    r, days = cfg["risk"], (as_of - last_seen) / 86_400.0
    return F.when(days > 1, F.greatest(F.lit(r["floor"]), score * F.greatest(F.lit(0.0), 1 - days * r["decay"]))).otherwise(score)


def risk_colour(score: Column) -> Column:
    return F.when(score >= 90, "critical").when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def iso_time(seconds: Column) -> Column:
    """Seconds since 1970 as UTC text, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
