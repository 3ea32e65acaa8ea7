"""Depth-limited traversal of a directed graph that may hold cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reach(edges: DataFrame, roots: DataFrame, depth: int, skip: list[str] | None = None) -> DataFrame:
    """``(root, node, depth, leaf, via)``: all nodes within ``depth`` steps, at their least depth.

    ``edges`` is ``(parent, child, leaf)``; leaves are found but not followed, nor are children that
    contain a pattern of ``skip`` in any case. ``via`` is the parent from which a node was found, of
    several at that depth the first. The number of joins is the depth, whatever the graph.
    """
    e = edges.select("parent", "child", F.col("leaf").alias("ends")).distinct()
    for p in skip or []:
        e = e.where(F.col("ends") | ~F.lower("child").contains(p.lower()))
    seen = front = roots.select(F.col("root"), F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(False).alias("leaf"), F.lit(None).cast("string").alias("via"))
    for d in range(1, depth + 1):
        step = front.where("not leaf").join(e, F.col("node") == F.col("parent")).groupBy("root", F.col("child").alias("node"), F.col("ends").alias("leaf")).agg(F.min("parent").alias("via"))
        front = step.join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(d).alias("depth"), "leaf", "via")
        seen = seen.unionByName(front)
    return seen
