"""Subtree totals of a forest by parallel tree contraction.

Rounds alternate two steps.  *Rake* takes all leaves away and adds their totals to their parents.
*Compress* takes whole chains of nodes with one child away: pointers along a chain are doubled until
they meet its end, and the end then hangs on the chain's parent and brings the chain's sum along.
After a compress at least half of the nodes are leaves, so the rounds grow with the logarithm of the
forest, whatever its depth or fan-out; chains of any length cost the logarithm of that in joins.  At
the end the chains are expanded again, last round first: a chain node's total is its sum down to the
chain's end plus the total of that end.

A node with very many children is only ever the key of an aggregation, never a join's crowded side.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from loomgraph.session import materialize


def subtree_totals(tree: DataFrame, weights: list[str]) -> DataFrame:
    """(id, *weights): for every node of ``tree`` (id, parent, *weights) the sums over its subtree.

    A root's parent is null.  Weights are whole numbers that are not null; identifiers are unique,
    and every parent that is not null is a node.  No rows give no rows.
    """
    ups = [f"_up_{w}" for w in weights]
    # ``weight``: the node with all that was raked into it; ``up``: what it brings along for its parent
    alive = materialize(tree.select("id", "parent", *[F.col(w).cast("long").alias(w) for w in weights],
                                    *[F.lit(0).cast("long").alias(u) for u in ups]), "trie-alive")
    known: list[DataFrame] = []
    chains: list[DataFrame] = []
    while not alive.isEmpty():
        alive, leaves = _rake(alive, weights, ups)
        known.append(leaves)
        alive, chain = _compress(alive, weights, ups)
        if chain is not None:
            chains.append(chain)
    for chain in reversed(chains):
        ends = reduce(DataFrame.union, known).select(
            F.col("id").alias("end"), *[F.col(w).alias(f"_end_{w}") for w in weights])
        known.append(materialize(chain.join(ends, "end").select(
            "id", *[(F.col(w) + F.col(f"_end_{w}")).alias(w) for w in weights]), "trie-expanded"))
    return reduce(DataFrame.union, known) if known else alive.select("id", *weights)


def _rake(alive: DataFrame, weights: list[str], ups: list[str]) -> tuple[DataFrame, DataFrame]:
    """The nodes left when all leaves are gone, and those leaves."""
    parents = alive.where("parent IS NOT NULL").select(F.col("parent").alias("id")).distinct()
    state = materialize(alive.join(parents.withColumn("_inner", F.lit(True)), "id", "left"), "trie-state")
    leaves = state.where("_inner IS NULL")
    gifts = (leaves.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id"))
             .agg(*[F.sum(F.col(w) + F.col(u)).alias(f"_gift_{w}") for w, u in zip(weights, ups)]))
    zero = F.lit(0).cast("long")
    left = (state.where("_inner").join(gifts, "id", "left")
            .select("id", "parent", *[(F.col(w) + F.coalesce(F.col(f"_gift_{w}"), zero)).alias(w)
                                      for w in weights], *ups))
    return materialize(left, "trie-raked"), leaves.select("id", *weights)


def _compress(alive: DataFrame, weights: list[str], ups: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The nodes left when all chains are gone, and the chains' nodes (id, end, *sums), if any."""
    kids = (alive.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id"))
            .agg(F.count(F.lit(1)).alias("_kids"), F.min(F.col("id")).alias("_next"),
                 *[F.sum(u).alias(f"_kid{u}") for u in ups]))
    state = materialize(alive.join(kids, "id", "left"), "trie-state")
    unary = state.where("_kids = 1")
    if unary.isEmpty():
        return alive, None
    goes_on = unary.select(F.col("id").alias("_next"), F.lit(True).alias("_open"))
    links = materialize(unary.join(goes_on, "_next", "left").select(
        "id", "parent", "_next", F.coalesce("_open", F.lit(False)).alias("_open"),
        *[(F.col(w) + F.col(f"_kid{u}")).alias(w) for w, u in zip(weights, ups)], *ups), "trie-links")
    heads = links.join(links.where("_open").select(F.col("_next").alias("id")), "id", "left_anti").select(
        "id", F.col("parent").alias("_above"), *[F.col(u).alias(f"_head{u}") for u in ups])

    closed = [links.where("NOT _open").select("id", F.col("_next").alias("end"), *weights)]
    going = links.where("_open").select("id", "_next", *weights)
    while not going.isEmpty():
        # where the next node's pointer already meets the end, this one's does now; else it doubles
        step = reduce(DataFrame.union, [c.select("id", F.col("end").alias("_to"), *weights,
                                                 F.lit(False).alias("_open")) for c in closed])
        step = step.union(going.select("id", F.col("_next").alias("_to"), *weights, F.lit(True).alias("_open")))
        step = step.select(F.col("id").alias("_next"), "_to", "_open",
                           *[F.col(w).alias(f"_more_{w}") for w in weights])
        moved = materialize(going.join(step, "_next").select(
            "id", "_to", "_open", *[(F.col(w) + F.col(f"_more_{w}")).alias(w) for w in weights]), "trie-jumps")
        closed.append(moved.where("NOT _open").select("id", F.col("_to").alias("end"), *weights))
        going = moved.where("_open").select("id", F.col("_to").alias("_next"), *weights)
    chain = reduce(DataFrame.union, closed)

    # a chain's end takes the place of its head and brings the chain's sum along
    moves = heads.join(chain, "id").select(
        F.col("end").alias("id"), F.lit(True).alias("_moved"), "_above",
        *[(F.col(f"_head{u}") + F.col(w)).alias(f"_new{u}") for w, u in zip(weights, ups)])
    rest = state.where("_kids IS NULL OR _kids <> 1").join(moves, "id", "left")
    left = rest.select("id", F.when(F.col("_moved"), F.col("_above")).otherwise(F.col("parent")).alias("parent"),
                       *weights, *[F.when(F.col("_moved"), F.col(f"_new{u}")).otherwise(F.col(u)).alias(u)
                                   for u in ups])
    return materialize(left, "trie-compressed"), chain
