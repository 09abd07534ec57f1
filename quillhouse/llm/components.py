"""Connected components of a distributed edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillhouse.llm.common import table


def _least(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    return both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("low"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (columns ``a``, ``b``; any order, repeats and loops allowed).

    ``component`` is the smallest node reachable. Each round is a grouped minimum, which combines before the shuffle,
    and a join that adaptive execution can split at a hub. Rounds grow with the logarithm of the longest path. Nulls
    make no edge.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = table(now, "edges")
    while True:
        low = _least(now)
        # Large star: each larger neighbour of a node is tied to the least node around it.
        ends = now.select(F.col("b").alias("node"), F.col("a").alias("far"))
        large = ends.join(low, "node").select(F.col("far").alias("a"), F.col("low").alias("b"))
        small_edges = now.join(low, now.a == low.node).select(F.col("a"), F.col("low").alias("b"))
        step = large.unionByName(small_edges).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        # Small star: all smaller neighbours of a node are tied to the least of them.
        step = table(step, "edges")
        best = step.groupBy("a").agg(F.min("b").alias("low"))
        small = step.join(best, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*")
        after = table(small.where("a <> b").distinct(), "edges")
        # Done when every node has one neighbour below it and no such neighbour has one itself.
        more = after.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() or after.join(after.select(F.col("a").alias("x")), F.col("b") == F.col("x"), "left_semi").limit(1).count()
        now = after
        if not more:
            break
    tied = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return tied.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
