"""Graph ingestion: three text corpora to a property graph, and the per-batch form of it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.embedding import embed
from loomgraph.functions.text import FEATURE_RULES, base_name, route_feature
from loomgraph.operators.graph import StoryGraph
from loomgraph.operators.match import first_match
from loomgraph.operators.tables import latest, upsert, upsert_edges
from loomgraph.schema import DEPENDS_ON
from loomgraph.session import materialize
from loomgraph.sources.corpus import (definition_nodes, parse_definitions, parse_steps, read_corpus,
                                      step_nodes, story_nodes)

Embed = Callable[[DataFrame, str], DataFrame]


def ingest(spark: SparkSession, stories: str, definitions: str, features: str,
           seeds: DataFrame | None = None, rules=FEATURE_RULES,
           embed_fn: Embed = embed) -> StoryGraph:
    """Build the graph from the story, definition and feature folders."""
    story_files = read_corpus(spark, stories, "*.txt", required=True)
    return build_graph(story_files, read_corpus(spark, definitions, "*.rb"),
                       read_corpus(spark, features, "*.feature"), seeds, rules, embed_fn)


def build_graph(story_files: DataFrame, definition_files: DataFrame, feature_files: DataFrame,
                seeds: DataFrame | None = None, rules=FEATURE_RULES,
                embed_fn: Embed = embed) -> StoryGraph:
    """The same from (file_name, content) tables."""
    spark = story_files.sparkSession
    story_table = materialize(story_nodes(story_files, seeds), "stories")
    lines = materialize(parse_steps(feature_files), "step_lines")
    defs = materialize(definition_nodes(parse_definitions(definition_files)), "definitions")

    nodes = step_nodes(lines)
    implements = lines.select(route_feature(base_name(F.col("file_name")), rules).alias("story_id"),
                              "step_id").where("story_id IS NOT NULL").dropDuplicates()
    found = first_match(lines, defs, anchor="start", order_by=("file_name", "pos"))
    binds = nodes.select("step_id", "text").join(found, "text").select("step_id", "definition_id")
    return StoryGraph(
        stories=embed_fn(story_table, "description").select(
            "story_id", "title", "description", "embedding", "verified_spec"),
        steps=embed_fn(nodes, "text"),
        definitions=embed_fn(defs.select("definition_id", "expression", "code_block"), "expression"),
        implements=implements, binds=binds,
        depends_on=spark.createDataFrame([], DEPENDS_ON))


def step_changes(batch: DataFrame, defs: DataFrame) -> dict[str, DataFrame]:
    """What a batch of step lines (story_id, step_id, step_type, text, ord) adds to the graph.

    Step nodes, their IMPLEMENTS edges, and a BINDS edge where a definition matches.  The cost is
    that of the batch: no graph table but the definitions is read.
    """
    found = first_match(batch, defs, anchor="none", normalise=True)
    return {
        "steps": latest(batch.select("step_id", "step_type", "text", "ord"), ["step_id"], ["ord"]),
        "implements": batch.where("story_id IS NOT NULL").select("story_id", "step_id").dropDuplicates(),
        "binds": batch.join(found, "text").select("step_id", "definition_id").dropDuplicates(),
    }


def apply_changes(graph: StoryGraph, changes: dict[str, DataFrame], order_col: str) -> StoryGraph:
    """The graph with changes merged in; ``order_col`` orders several changes of one step."""
    steps = changes["steps"].select("step_id", "step_type", "text", order_col)
    return graph.with_tables(
        steps=upsert(graph.steps, steps, ["step_id"], order_col, mode="merge"),
        implements=upsert_edges(graph.implements, changes["implements"], "IMPLEMENTS"),
        binds=upsert_edges(graph.binds, changes["binds"], "BINDS"))


def ingest_steps(graph: StoryGraph, batch: DataFrame) -> StoryGraph:
    """Upsert a batch of step lines into the graph."""
    return apply_changes(graph, step_changes(batch, graph.definitions), "ord")
