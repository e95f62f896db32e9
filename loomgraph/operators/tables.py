"""Table maintenance as pure functions: snapshot in, snapshot out.

Every group-wise step is an aggregate with a map-side partial (``max_by``, ``dropDuplicates``), so a
key that holds a large share of the rows shrinks to one row per map task before the shuffle.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.schema import EDGE_REFS, NODE_KEYS, edge_key, node_key


def latest(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """The last row per key in ``order_cols`` order."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*order_cols)
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
              .select(*keys, *[F.col("_r")[c].alias(c) for c in rest]))


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str], order_col: str,
           mode: str = "merge") -> DataFrame:
    """Apply a batch of node rows; within the batch the last row per key (``order_col``) wins.

    ``replace``: a batch row takes the place of the whole old row, columns it lacks become NULL.
    ``merge``: only the columns the batch has are changed (a NULL in the batch is a change).
    """
    if mode not in ("merge", "replace"):
        raise ValueError(f"unknown upsert mode: {mode}")
    unknown = set(batch.columns) - set(existing.columns) - {order_col}
    if unknown:
        raise ValueError(f"columns not in the table: {sorted(unknown)}")
    given = [c for c in batch.columns if c not in keys and c != order_col]
    new = latest(batch, keys, [order_col]).select(*keys, *given).withColumn("_hit", F.lit(True))
    old = existing.alias("o")
    joined = old.join(new.alias("n"), keys, "full_outer")
    types = {f.name: f.dataType for f in existing.schema.fields}

    def pick(name: str) -> Column:
        if name in keys:
            return F.col(name)
        if name in given:
            fresh = F.col(f"n.{name}").cast(types[name])
        elif mode == "merge":
            return F.col(f"o.{name}")
        else:
            fresh = F.lit(None).cast(types[name])
        return F.when(F.col("n._hit"), fresh).otherwise(F.col(f"o.{name}")).alias(name)

    return joined.select(*[pick(c) for c in existing.columns])


def upsert_edges(edges: DataFrame, batch: DataFrame, label: str) -> DataFrame:
    """Set union on the (source, target) pair of ``label``."""
    pair = list(edge_key(label))
    return edges.select(*pair).unionByName(batch.select(*pair)).dropDuplicates(pair)


def update_spec(stories: DataFrame, updates: DataFrame, insert_missing: bool = False,
                order_col: str | None = None) -> DataFrame:
    """Set ``verified_spec`` by story; an unknown story is ignored, or inserted as a stub row.

    ``order_col`` says which of several updates of one story is the last; without it each story
    must come once, and a second update of a story fails the job.
    """
    if order_col:
        updates = latest(updates.select("story_id", "verified_spec", order_col), ["story_id"], [order_col])
    else:
        several = F.raise_error(F.lit("several updates of one story need an order_col"))
        updates = updates.groupBy("story_id").agg(
            F.when(F.count(F.lit(1)) > 1, several.cast("string"))
            .otherwise(F.first("verified_spec")).alias("verified_spec"))
    fresh = updates.select("story_id", F.col("verified_spec").alias("_spec"),
                           F.lit(True).alias("_hit"))
    joined = stories.join(fresh, "story_id", "full_outer" if insert_missing else "left")
    spec = F.when(F.col("_hit"), F.col("_spec")).otherwise(F.col("verified_spec"))
    return joined.withColumn("verified_spec", spec).select(*stories.columns)


def delete_keys(df: DataFrame, gone: DataFrame, label: str) -> DataFrame:
    """Delete nodes by key; edges stay."""
    key = node_key(label)
    return df.join(gone.select(key), key, "left_anti")


def not_in(df: DataFrame, other: DataFrame, key: str, null_aware: bool = False) -> DataFrame:
    """Rows of ``df`` whose key is not in ``other``.

    ``null_aware`` gives SQL ``NOT IN``: one NULL in ``other`` empties the result, and a NULL key
    only passes when ``other`` is empty.  Both come from one scalar subquery, so the join itself
    stays an equi anti join (Spark's own ``NOT IN`` needs ``other`` broadcast whole).
    """
    kept = df.join(other.select(key), key, "left_anti")
    if not null_aware:
        return kept
    facts = other.agg(F.count_if(F.col(key).isNull()).alias("nulls"), F.count(F.lit(1)).alias("n"))
    nulls, size = facts.select("nulls").scalar(), facts.select("n").scalar()
    return kept.where((nulls == 0) & (F.col(key).isNotNull() | (size == 0)))


def prune_orphans(defs: DataFrame, binds: DataFrame,
                  null_aware: bool = False) -> tuple[DataFrame, DataFrame]:
    """Split definitions into (kept, pruned): pruned ones have no BINDS edge."""
    pruned = not_in(defs, binds, "definition_id", null_aware)
    if null_aware:
        kept = defs.join(pruned.select("definition_id"), "definition_id", "left_anti")
    else:
        kept = defs.join(binds.select("definition_id"), "definition_id", "left_semi")
    return kept, pruned


def integrity_report(nodes: dict[str, DataFrame], edges: dict[str, DataFrame]) -> DataFrame:
    """One row per constraint: (check, table, n violations)."""
    def as_rows(counts: DataFrame, table: str) -> DataFrame:
        """One row of counts to one row per rule."""
        return counts.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("check"), F.lit(table).alias("table"),
                     F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("n"))
            for c in counts.columns])))

    def key_rows(table: str, df: DataFrame, keys: list[str]) -> DataFrame:
        missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
        groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
        return as_rows(groups.agg(
            F.sum(F.when(missing, F.col("_c"))).alias("null_key"),
            F.count_if(~missing & (F.col("_c") > 1)).alias("duplicate_key")), table)

    out = []
    for label, df in nodes.items():
        out.append(key_rows(label, df, [NODE_KEYS[label]]))
    for label, df in edges.items():
        out.append(key_rows(label, df, list(edge_key(label))))
        for col, node in EDGE_REFS[label]:
            refs = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_c"))
            known = nodes[node].select(F.col(NODE_KEYS[node]).alias(col))
            dangling = refs.join(known, col, "left_anti").agg(F.sum("_c").alias(f"dangling_{col}"))
            out.append(as_rows(dangling, label))
    return reduce(DataFrame.unionByName, out)
