"""Breadth-first search with a depth bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def bfs(edges: DataFrame, seeds: DataFrame, depth: int = 3, most: int | None = None) -> DataFrame:
    """(node, depth) of all nodes within ``depth`` steps over (src, dst) from the seeds.

    Each step joins the frontier with the edges and takes away what has been seen; seen
    nodes are cut off in the checkpoint folder, so plans stay small and a lost executor
    costs one step. With ``most``, no step begins once so many nodes are seen.
    """
    frontier = cut(seeds.select(F.col(seeds.columns[0]).alias("node")).distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for step in range(1, depth + 1):
        if most is not None and seen.count() >= most:
            break
        found = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(step)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen
