"""Continuous graph ingestion: every micro-batch appends what it changes, readers merge on read.

A batch writes its changes under ``changes/<table>/batch=<id>``, overwriting what an earlier try of
the same batch left there, so its cost does not grow with the graph.  ``read_graph`` merges base and
changes; ``compact`` writes the merged tables as a new base whenever the changes have piled up.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from loomgraph.operators.graph import StoryGraph
from loomgraph.operators.match import prepare_definitions
from loomgraph.plans.ingest import apply_changes, step_changes
from loomgraph.session import materialize
from loomgraph.sources.corpus import path_exists

TABLES = ("stories", "steps", "definitions", "implements", "binds", "depends_on")
# Column types of the change tables; the batch number is their partition column.
CHANGES = {
    "steps": "step_id string, step_type string, text string, ord bigint, batch bigint",
    "implements": "story_id string, step_id string, batch bigint",
    "binds": "step_id string, definition_id string, batch bigint",
}


def write_base(graph: StoryGraph, root: str) -> None:
    for name in TABLES:
        getattr(graph, name).write.parquet(f"{root}/base/{name}")


def read_base(spark: SparkSession, root: str) -> StoryGraph:
    return StoryGraph(**{name: spark.read.parquet(f"{root}/base/{name}") for name in TABLES})


def read_graph(spark: SparkSession, root: str) -> StoryGraph:
    """Base tables with all changes merged in, the later batch winning."""
    base = read_base(spark, root)
    if not path_exists(spark, f"{root}/changes/steps"):
        return base
    changes = {name: spark.read.schema(schema).parquet(f"{root}/changes/{name}")
               for name, schema in CHANGES.items()}
    changes["steps"] = changes["steps"].withColumn("when", F.struct("batch", "ord"))
    return apply_changes(base, changes, "when")


def compact(spark: SparkSession, root: str, new_root: str) -> None:
    """Write the merged graph as the base of a new root; the stream is then started on that."""
    write_base(read_graph(spark, root), new_root)


def start_ingest(stream: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Ingest step lines (story_id, step_id, step_type, text, ord); the base must exist."""
    # definitions do not change under the stream: vetted once, not once per batch
    defs = prepare_definitions(read_base(stream.sparkSession, root).definitions)

    def apply(batch: DataFrame, batch_id: int) -> None:
        lines = materialize(batch, "line_batch")  # read several times
        for name, rows in step_changes(lines, defs).items():
            rows.write.mode("overwrite").parquet(f"{root}/changes/{name}/batch={batch_id}")

    return (stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
