"""Exact de-duplication by a tree merge of sorted digest runs.

Every input partition leaves a run: its digests in order, one entry per digest with the identifier
that stays and the number of rows.  Runs meet in rounds: in each, ``fan_in`` neighbouring runs are
merged into one (a binomial tree for ``fan_in=2``), and again only one entry per digest stays.  A
run is cut into slices by the leading digest bits, so the last rounds still work in parallel and no
task holds more than a slice.  An entry is one text only if SHA-256, length and a second hash all
agree; entries that share a digest but fail that check stay apart at every level.

Copies of one text, however many, shrink to one entry per run before the first exchange.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.session import materialize

#: Digests a slice should hold when all runs have met.
SLICE_ROWS = 200_000
_ENTRY = ["slice", "run", "digest", "length", "proof"]


def digest_table(docs: DataFrame, text: Column, run_rows: int) -> DataFrame:
    """One row per document: digest, proof of equality, slice, and the run it is part of."""
    rows = docs.select(
        "doc_id", F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().cast("long").alias("run"),
        F.coalesce(text, F.lit("")).alias("text"))
    table = materialize(rows.select(
        "doc_id", "row", "run", F.unhex(F.sha2("text", 256)).alias("digest"),
        F.octet_length("text").alias("length"), F.xxhash64("text").alias("proof")), "digests")
    slices = max(1, -(-table.count() // run_rows))
    lead = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    return table.withColumn("slice", F.floor(lead * slices / F.lit(1 << 32)).cast("long"))


def _merge(runs: DataFrame) -> DataFrame:
    """Merge the sorted runs that carry the same number; the entries stay in digest order."""
    return (runs.groupBy(*_ENTRY)
            .agg(F.max("keep").alias("keep"), F.sum("size").alias("size")))


def merge_runs(entries: DataFrame, fan_in: int) -> DataFrame:
    """Rounds of merging until one run is left: one entry per distinct text."""
    runs = entries.agg(F.max("run")).first()[0]
    left = 1 if runs is None else runs + 1
    merged = entries
    while True:
        left = -(-left // fan_in)
        merged = merged.withColumn("run", F.floor(F.col("run") / fan_in))
        parts = max(1, int(merged.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        merged = _merge(merged.repartition(parts, "slice", "run").sortWithinPartitions(*_ENTRY))
        if left == 1:
            return merged
        merged = materialize(merged, "digest-runs")


def exact_duplicates(docs: DataFrame, keep: str = "smallest", text: Column | str = "text",
                     fan_in: int = 8, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of ``docs``.

    ``keep`` says which identifier of equal texts stays, ``"smallest"`` or ``"largest"``.  ``text``
    may be a column expression, for texts equal after normalising.  A null text counts as empty.  A
    null ``doc_id`` stays only where no other row has that text.  Rows that repeat both identifier
    and text count one by one in ``group_size``; exactly one row of a group is ``kept``.  No rows
    give no rows; other columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    text = F.col(text) if isinstance(text, str) else text
    table = digest_table(docs, text, slice_rows)
    rank = F.col("doc_id") if keep == "largest" else -F.col("doc_id")
    # greatest struct: any identifier beats null, then the wanted end, then the earliest row
    leaf = table.withColumn("keep", F.struct(
        F.col("doc_id").isNotNull().alias("known"), rank.alias("rank"),
        (-F.col("row")).alias("row"), F.col("doc_id").alias("doc_id"))).withColumn("size", F.lit(1))
    merged = merge_runs(leaf.select(*_ENTRY, "keep", "size"), fan_in)
    keepers = merged.select("digest", "length", "proof", F.col("keep.doc_id").alias("keep_id"),
                            (-F.col("keep.row")).alias("keep_row"),
                            F.col("size").alias("group_size"))
    return (table.join(keepers, ["digest", "length", "proof"])
            .select("doc_id", "keep_id", F.col("group_size").cast("long"),
                    (F.col("row") == F.col("keep_row")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))
