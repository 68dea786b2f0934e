"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges``, for nodes with an edge.

    Each round links neighbours to the smallest node nearby, so a path shrinks by half and
    the rounds grow with the logarithm of the longest path. Every round ends in a
    checkpoint; nothing but two emptiness tests comes to the driver. Loops and nulls are
    ignored; no edges give no rows. ``rows`` is a bound on the edges, if known.
    """
    e = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    while True:
        e = cut(e, rows)
        # done when each u has one edge and is no v
        ends = e.select("u", F.lit(1).alias("n")).unionByName(e.select(F.col("v").alias("u")).distinct().withColumn("n", F.lit(1)))
        if ends.groupBy("u").agg(F.sum("n").alias("n")).filter("n > 1").isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
