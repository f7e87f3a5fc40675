"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a minimum per node and a join back, so a hub with very many neighbours is summed map-side and
split by AQE; O(log^2 n) steps suffice whatever the diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _with_minimum(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the smallest v of each u."""
    # re-keyed, so that both join sides get an exchange that AQE can split
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select((F.col("u") + F.lit(0)).alias("_u"), "m")
    least = least.withColumn("_u", F.expr("_u ^ 1"))
    return edges.join(least, F.expr("u ^ 1") == F.col("_u")).drop("_u")


def _pairs(edges: DataFrame, *ends: tuple) -> DataFrame:
    """For each row, the edges of the given (u, v) columns; one pass, however many there are."""
    e = F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ends]))
    return edges.select(e.alias("e")).select("e.u", "e.v").filter("u != v")


def _step(edges: DataFrame) -> DataFrame:
    large = _with_minimum(_pairs(edges, ("u", "v"), ("v", "u"))).filter("v > u")
    down = large.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u != v").distinct()
    return _pairs(_with_minimum(down), ("u", "m"), ("v", "m")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one root, which hangs on nothing."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("n")), F.struct(F.col("v").alias("node"), F.lit(0).alias("n"))))
    nodes = edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.n").alias("up"), F.min("e.n").alias("least"))
    return nodes.filter("up > 1 OR (up = 1 AND least = 0)").isEmpty()


def connected_components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (u, v: longs); the component is the smallest node reachable."""
    now = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    for _ in range(max_steps):
        now = materialize(_step(now), "cc")
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
    raise RuntimeError(f"components didn't settle in {max_steps} steps")
