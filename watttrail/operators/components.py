"""Connected components by hooking and contraction, with every step a distributed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watttrail.session import stage


def _jump(parents: DataFrame) -> DataFrame:
    """Replaces every parent by the root of its chain; the depth halves with each pass."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("upper"))
        nxt = stage(parents.join(up, "parent").select("node", F.col("upper").alias("parent"), (F.col("upper") != F.col("parent")).alias("moved")), "jump")
        parents = nxt.select("node", "parent")
        if nxt.where("moved").isEmpty():
            return parents


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the component's least node.

    Every round hooks each node to its least neighbour, follows the chains to their ends and
    replaces the edges by edges between those ends, so that a path of any length takes few
    rounds. Nodes with no edge to another do not appear.
    """
    both = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    left = stage(edges.select(*both).where("lo < hi").distinct(), "edges")
    labels = None
    while not left.isEmpty():
        ends = left.select(F.col("lo").alias("node"), F.col("hi").alias("other")).union(left.select("hi", "lo"))
        least = ends.groupBy("node").agg(F.min("other").alias("other"))
        parents = _jump(stage(least.select("node", F.least("node", "other").alias("parent")), "parents"))
        lo = parents.select(F.col("node").alias("lo"), F.col("parent").alias("new_lo"))
        hi = parents.select(F.col("node").alias("hi"), F.col("parent").alias("new_hi"))
        moved = left.join(lo, "lo").join(hi, "hi").where("new_lo <> new_hi")
        left = stage(moved.select(F.least("new_lo", "new_hi").alias("lo"), F.greatest("new_lo", "new_hi").alias("hi")).distinct(), "edges")
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("root"))
        else:
            step = parents.select(F.col("node").alias("root"), "parent")
            labels = stage(labels.join(step, "root", "left").select("node", F.coalesce("parent", "root").alias("root")), "labels")
    if labels is None:
        return left.select(F.col("lo").alias("node"), F.col("hi").alias("root"))
    return labels
