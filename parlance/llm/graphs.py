"""Connected components of an edge table, by contraction: each node points to the neighbour of least hash, and the graph of what
is pointed to is contracted again. In that order a round leaves a fixed share of the nodes, long chains too, so rounds are few.
Nothing but one row count comes to the driver in a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): nodes are connected if and only if they have one root, which is the root of itself.

    Loops are left out; repeated edges count once; an empty table gives an empty result.
    """
    left = cut(edges.select("a", "b").filter("a != b").distinct())
    found: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("b"))).alias("m"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("b"))
        parent = cut(least.select("a", F.when(F.col("m") < own, F.col("m.b")).otherwise(F.col("a")).alias("to")))
        # one jump more: what a node points to may itself point on
        up = parent.select(F.col("a").alias("to"), F.col("to").alias("up"))
        parent = cut(parent.join(up, "to").select(F.col("a").alias("node"), F.col("up").alias("root")))
        found.append(parent)
        a = parent.select(F.col("node").alias("a"), F.col("root").alias("x"))
        b = parent.select(F.col("node").alias("b"), F.col("root").alias("y"))
        left = cut(left.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a != b").distinct())
    if not found:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = found.pop()
    while found:
        lower = found.pop()
        above = out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = lower.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return cut(out)
