"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultloom.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    """Count and checksum: equal after a round means nothing moved."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).collect()[0])


def star_components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node that is not the smallest of its component.

    ``edges`` has bigint columns u and v in any direction. Each round costs
    two groupings and two joins on the nodes; rounds grow with the logarithm
    of the longest path. Every round is stored, so a lost executor costs at
    most one round, and only a count and a checksum reach the driver.
    """
    edges = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.x).filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.withColumnRenamed("u", "x"), F.col("u") == F.col("x")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    return edges.withColumnRenamed("v", "root")
