"""Connected components by contraction, all on Spark.

Every node hooks onto its smallest neighbour, chains of hooks are shortened, and edges are rewritten
to the nodes hooked onto, until no edge is left.  Each round merges every node that has a smaller
neighbour, so rounds grow with the logarithm of a component's size.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomgraph.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b); nodes without one left out."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    live = materialize(both.where("a <> b").distinct(), "edges")
    label = None
    while not live.isEmpty():
        hook = live.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("up"))
        for _ in range(2):  # a hook's hook is still smaller
            upper = hook.select(F.col("a").alias("up"), F.col("up").alias("top"))
            hook = materialize(hook.join(upper, "up").select("a", F.col("top").alias("up")), "hooks")
        if label is None:
            label = hook.select(F.col("a").alias("node"), F.col("up").alias("component"))
        else:
            step = hook.select(F.col("a").alias("component"), "up")
            label = label.join(step, "component", "left").select(
                "node", F.coalesce("up", "component").alias("component"))
        label = materialize(label, "labels")
        other = hook.select(F.col("a").alias("b"), F.col("up").alias("up_b"))
        live = materialize(live.join(hook, "a").join(other, "b")
                           .select(F.col("up").alias("a"), F.col("up_b").alias("b"))
                           .where("a <> b").distinct(), "edges")
    if label is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    return label
