"""Connected components of an edge table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borehole.session import materialise

MAX_ROUNDS = 200


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of ``edges(a, b)``: the smallest node that can be reached.

    Alternating large-star and small-star rounds: every round writes its edges to the scratch
    folder, so lineage stays short and lost executors cost one round. A node of any degree is
    handled by partial aggregation and a join that adaptive execution may split. Loops and
    repeated edges are harmless, no edges give no rows.
    """
    same = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = materialise(same.distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        large = _star(now.select("u", "v").union(now.select(F.col("v"), F.col("u"))), larger=True)
        small = _star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), larger=False)
        now = materialise(small.where("u <> v").distinct(), "edges")
        mark = now.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")
        ).first()
        if mark == before or mark[0] == mark[2] and _flat(now):
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return nodes.union(roots).groupBy("node").agg(F.min("component").alias("component"))


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest among them and the node itself."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = pairs.join(least, "u")
    if larger:
        linked = linked.where("v > u")
        return linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(own).where("u <> v").distinct()


def _flat(edges: DataFrame) -> bool:
    """Whether no node has a parent that has a parent."""
    return not edges.alias("x").join(edges.alias("y"), F.col("x.v") == F.col("y.u"), "left_semi").take(1)
