"""The prefix trie of conversations, with totals of every subtree by tree contraction.

A node is a distinct sequence of first turns.  Its key is the exclusive-or of two 64-bit hashes of
(place, SHA-256 of role and text) over these turns, so the keys of all prefixes are a running total,
made in slices (a conversation of any length is spread over several tasks), and a parent's key is the
child's without its last turn.  Members of a node are compared in parent and last turn, so two
different sequences under one key would be noticed and raise an error; texts are never shuffled.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.llm.tree_contraction import subtree_totals
from loomgraph.operators.scan import running, sliced
from loomgraph.session import materialize

#: Turns shared with the head of a block at most, and conversations in a block (fixed by the contract).
LEAD, BLOCK = 6, 100
#: Identifiers joined into one piece before they are hashed.
PIECE = 1 << 14
_ROOT = bytes(16)


def turn_table(conversations: DataFrame) -> DataFrame:
    """(conv_id, said, chars, pos): each turn as digest and length, in its place, without its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        # the role's length in front keeps (role, text) pairs apart
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("said"),
        F.length(text).cast("long").alias("chars"))
    cut = sliced(turns, ["conv_id"], ["turn", "said"], "turns")
    return running(cut, ["conv_id"], ["turn", "said"], {"pos": ("sum", F.lit(1))}).select(
        "conv_id", "said", "chars", "pos")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of their block's head: their turns, and those without any.

    The first is (conv_id, pos, said, chars, last), the second (conv_id).
    """
    lead = F.crc32(F.col("conv_id").cast("string").cast("binary")) % LEAD
    sizes = materialize(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size")), "conversation-sizes")
    head_sizes = sizes.where(F.col("conv_id") % BLOCK == 0).select(
        F.col("conv_id").alias("head"), F.col("size").alias("head_size"))
    convs = (sizes.withColumn("lead", lead).withColumn("head", F.col("conv_id") - F.col("conv_id") % BLOCK)
             .join(head_sizes, "head", "left")
             .withColumn("taken", F.least("lead", F.coalesce("head_size", F.lit(0).cast("long")))))
    head_turns = turns.where((F.col("conv_id") % BLOCK == 0) & (F.col("pos") < LEAD)).select(
        F.col("conv_id").alias("head"), "pos", "said", "chars")
    # at most five turns of a head, for at most 199 conversations of its block
    taken = convs.join(head_turns, "head").where("pos <= taken").select(
        "conv_id", "pos", "said", "chars",
        ((F.col("pos") == F.col("taken")) & (F.col("size") <= F.col("lead"))).alias("last"))
    own = turns.where(F.col("pos") > lead).join(
        convs.where("size > lead").select("conv_id", "lead", "taken", "size"), "conv_id").select(
        "conv_id", (F.col("pos") - F.col("lead") + F.col("taken")).alias("pos"), "said", "chars",
        (F.col("pos") == F.col("size")).alias("last"))
    return taken.union(own), convs.where("taken = 0 AND size <= lead").select("conv_id")


def _key(a: Column, b: Column) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in (a, b)]))


def _prefixes(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, pos, chars, last, check, a, b, up_a, up_b): the key of each prefix and of its parent."""
    lanes = {"a": F.xxhash64("said", "pos"), "b": F.xxhash64("pos", F.lit("b"), "said")}
    cut = sliced(rebuilt, ["conv_id"], ["pos"], "rebuilt")
    keyed = running(cut, ["conv_id"], ["pos"], {n: ("xor", c) for n, c in lanes.items()})
    up = {f"up_{n}": F.col(n).bitwiseXOR(c) for n, c in lanes.items()}
    return keyed.withColumns(up).select(
        "conv_id", "pos", "chars", "last", "a", "b", "up_a", "up_b",
        F.xxhash64("up_a", "up_b", "said", "pos").alias("check"))


def _nodes(prefixes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, parent, depth, conv_id, n_convs, chars), the root included."""
    same = F.min("check") == F.max("check")
    nodes = prefixes.groupBy("a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.max("chars").alias("chars"), F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"),
        F.when(same, F.max("pos")).otherwise(
            F.raise_error(F.lit("two sequences of turns share one key"))).alias("depth"))
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    return nodes.select(_key(F.col("a"), F.col("b")).alias("id"), _key(F.col("up_a"), F.col("up_b")).alias("parent"),
                        F.col("depth").cast("long").alias("depth"), "conv_id", "n_convs", "chars").union(
        root.select(F.lit(bytearray(_ROOT)), F.lit(None).cast("binary"), F.lit(0).cast("long"), "conv_id",
                    "n_convs", F.lit(0).cast("long")))


def _pieces(batches):
    """Identifiers that follow each other, joined by commas, at most PIECE to a piece."""
    def piece(node, ids):
        return {"id": node, "first": ids[0], "ids": ",".join(map(str, ids))}

    node, waiting = None, []
    for batch in batches:
        out = []
        for key, conv in zip(batch["id"].to_pylist(), batch["conv_id"].to_pylist()):
            if waiting and (key != node or len(waiting) >= PIECE):
                out.append(piece(node, waiting))
                waiting = []
            node = key
            waiting.append(conv)
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, _PIECES)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, _PIECES)
    if waiting:
        yield pa.RecordBatch.from_pylist([piece(node, waiting)], _PIECES)


_PIECES = pa.schema([("id", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
_ENDS = pa.schema([("id", pa.binary()), ("ends_sha256", pa.string())])


def _hashed(batches):
    """One digest per node over its pieces, which come in order; nothing but the digest is held."""
    node, sha = None, None
    for batch in batches:
        out = []
        for key, text in zip(batch["id"].to_pylist(), batch["ids"].to_pylist()):
            if key != node:
                if sha is not None:
                    out.append({"id": node, "ends_sha256": sha.hexdigest()})
                node, sha = key, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(text.encode())
        if out:
            yield pa.RecordBatch.from_pylist(out, _ENDS)
    if sha is not None:
        yield pa.RecordBatch.from_pylist([{"id": node, "ends_sha256": sha.hexdigest()}], _ENDS)


def _ends(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256) from (id, conv_id): the digest of a node's identifiers in rising order.

    The order is made by a range over (node, identifier), so the identifiers of one node, however
    many, are joined to pieces by many tasks.  SHA-256 itself goes through a text from front to back:
    the pieces of one node meet in one task, as a stream.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = (ends.repartitionByRange(parts, "id", "conv_id").sortWithinPartitions("id", "conv_id")
              .mapInArrow(_pieces, "id binary, first long, ids string"))
    return (pieces.repartition(parts, "id").sortWithinPartitions("id", "first")
            .mapInArrow(_hashed, "id binary, ends_sha256 string"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of ``conversations`` (conv_id, turn, role, text).

    Turns are put in order by ``turn`` (null first; equal ones by the SHA-256 of role and text), null
    role or text counts as empty, and each conversation begins with the first ``crc32(conv_id) % 6``
    turns of the conversation at the front of its hundred in place of its own.  Columns: conv_id
    (smallest member), depth, parent_conv_id (the parent's conv_id, null for the root), n_convs,
    n_children, n_leaves and saved_tokens (over the subtree), ends_sha256.

    Rows without conv_id belong to no conversation and are left out; repeated rows are turns of
    their own; further columns are ignored; no conversations give no rows, not even a root.
    """
    turns = materialize(turn_table(conversations), "turns")
    rebuilt, silent = rebuild(turns)
    prefixes = materialize(_prefixes(rebuilt), "prefixes")
    nodes = materialize(_nodes(prefixes, turns.select("conv_id").distinct()), "trie-nodes")
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(kids, "id", "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-counted")
    totals = subtree_totals(nodes.select(
        "id", "parent", F.when(F.col("n_children") == 0, 1).otherwise(0).alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    ends = prefixes.where("last").select(_key(F.col("a"), F.col("b")).alias("id"), "conv_id").union(
        silent.select(F.lit(bytearray(_ROOT)).alias("id"), "conv_id"))
    above = nodes.where("n_children > 0").select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(totals, "id").join(_ends(ends), "id", "left").join(above, "parent", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")))
