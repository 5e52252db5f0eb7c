"""Connected components of a link table, by alternating large and small stars.

Each round is two aggregations (minimum per node, with map-side combine) and
two joins; no neighbour list is ever collected, so a hub with very many links
is only a skewed join side, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
                 .first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return (both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    inner = edges.join(low, "a").filter("b > m").select(F.col("b").alias("a"),
                                                        F.col("m").alias("b"))
    return inner.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs, in any direction, loops and repeats allowed ->
    ``(node, component)`` for every node that has a link to another node;
    ``component`` is the smallest node that can be reached."""
    now = materialize(edges.filter("a <> b")
                      .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .distinct())
    state = _fingerprint(now)
    while True:
        now = materialize(_small_star(_large_star(now)))
        new_state = _fingerprint(now)
        if new_state == state:
            break
        state = new_state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
