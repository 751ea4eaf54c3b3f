"""Connected components by contraction, with each round's tables cut from their lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import checkpoint

#: A key is crowded with more rows than this and than this share of all: so at most 1000 keys are.
CROWD, SHARE = 20_000, 0.001


def looked_up(df: DataFrame, key: str, table: DataFrame, how: str) -> DataFrame:
    """``df`` joined with ``table`` (one row a key). Rows of crowded keys, at most 1000 of them, meet theirs in a broadcast instead of one task."""
    counts = df.groupBy(key).agg(F.count("*").alias("__n"))
    size = counts.agg(F.sum("__n").alias("all"), F.max("__n").alias("most")).first()
    least = max(CROWD, SHARE * (size["all"] or 0))
    if (size["most"] or 0) <= least:
        return df.join(table, key, how)
    crowded = checkpoint(counts.filter(F.col("__n") > least).select(key))
    rest = df.join(F.broadcast(crowded), key, "left_anti").join(table, key, how)
    return rest.unionByName(df.join(F.broadcast(crowded.join(table, key, how)), key))


def rooted(step: DataFrame) -> DataFrame:
    """(node, to) with each node at the end of its chain of smaller and smaller ``to``: chains halve each round."""
    while True:
        further = checkpoint(looked_up(step, "to", step.select(F.col("node").alias("to"), F.col("to").alias("next")), "inner"))
        step = further.select("node", F.col("next").alias("to"))
        if further.filter("next <> to").isEmpty():
            return step


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (u, v); a component is named by its smallest node.

    Each round points every node to the smallest of its neighbours and itself, follows these pointers to their ends, and
    draws the edges between the ends. An end has at least one other node pointing to it, so nodes that still have edges at
    least halve, and rounds grow with the logarithm of the nodes, each of as many steps as the logarithm of its longest chain."""
    left = checkpoint(edges.filter("u <> v").distinct())
    labels = None
    while not left.isEmpty():
        both = left.select("u", "v").union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = rooted(checkpoint(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")).select("node", F.least("node", "low").alias("to"))))
        if labels is None:
            labels = step
        else:
            moved = looked_up(labels, "to", step.select(F.col("node").alias("to"), F.col("to").alias("next")), "left")
            labels = checkpoint(moved.select("node", F.coalesce("next", "to").alias("to")))
        at_u = looked_up(left, "u", step.select(F.col("node").alias("u"), F.col("to").alias("a")), "inner")
        at_v = looked_up(at_u, "v", step.select(F.col("node").alias("v"), F.col("to").alias("b")), "inner")
        left = checkpoint(at_v.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).limit(0)
    return labels.withColumnRenamed("to", "component")
