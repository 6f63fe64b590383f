"""Connected components of a distributed set of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """Columns node and component, the smallest node reachable; one row for each node with an edge.

    ``edges`` has the columns u and v of one ordered type; loops, repeated edges and nulls are ignored. The first
    round reads them several times, so they should be staged.
    Every round is written to the shared folder, and the last one is that which leaves stars. Minima are combined before the shuffle, and the joins back are inner
    joins, so the centre of a large star is split by adaptive execution. Rounds grow with the logarithm of the
    longest path.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _pairs(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("a"), "m", "u")
        now = staged(_pairs(
            small.filter("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v"))
            .unionAll(least.select("u", F.col("m").alias("v")))))
        if _stars(now):
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node that hangs on a lesser one hangs on that one alone, and none hangs on it. Nothing would change any more then."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 0 and up + down > 1").isEmpty()
