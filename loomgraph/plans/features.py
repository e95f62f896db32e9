"""Feature report: resolve a batch of step lines, then reuse coverage and orphan definitions."""
from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import (DEFINITION_PREFIX, content_id, percent_text, widen,
                                      widen_code)
from loomgraph.operators.graph import StoryGraph
from loomgraph.operators.match import (first_match, generated_definitions, resolve_steps,
                                       reuse_coverage)
from loomgraph.operators.tables import prune_orphans, upsert_edges
from loomgraph.session import materialize


def resolve_in_order(resolved: DataFrame, lines: DataFrame, definitions: DataFrame) -> DataFrame:
    """``resolved`` with later lines reusing what earlier lines of the batch made or widened.

    ``lines`` have step_id, text and ``ord``, their order.  A line that no definition of the graph
    matches makes one (GENERATE) or widens one (EXPAND), unless one that an earlier line has made or
    widened matches its text already; then it reuses the first such.  Whether a line makes anything
    depends on the lines before it only, so the lines are settled in rounds: in each, every open line
    looks up the earliest line whose product would match it.  Without one before it, it acts itself; if
    that line is known to act, it reuses; otherwise it waits.  The first open line is always settled, and
    a round settles all lines that do not wait for one another.
    """
    nodes = lines.groupBy("step_id").agg(F.min("ord").alias("ord"), F.min("text").alias("text"))
    expand = F.col("action") == "EXPAND"
    open_ = materialize(
        resolved.where("action <> 'REUSE'").join(nodes, "step_id")
        .join(definitions.select("definition_id", "expression"), "definition_id", "left")
        .select("step_id", "ord", "text", F.when(expand, widen(F.col("expression"))).otherwise(F.col("text")).alias("expression"),
                F.when(expand, F.col("definition_id")).otherwise(content_id(F.col("text"), DEFINITION_PREFIX)).alias("made")),
        "open-lines")
    acting: list[DataFrame] = []
    reusing: list[DataFrame] = []
    while not open_.isEmpty():
        makers = reduce(DataFrame.union, [d.withColumn("acts", F.lit(True)) for d in acting]
                        + [open_.withColumn("acts", F.lit(False))])
        found = first_match(open_, makers.select(F.col("step_id").alias("definition_id"), "expression", "ord"),
                            "none", True, order_by=("ord",))
        earliest = found.join(makers.select(F.col("step_id").alias("definition_id"), F.col("ord").alias("made_at"),
                                            F.col("made").alias("reused"), "acts"), "definition_id").drop("definition_id")
        settled = materialize(open_.join(earliest, "text", "left").withColumn(
            "turn", F.when(F.col("made_at").isNull() | (F.col("made_at") >= F.col("ord")), F.lit("acts"))
            .when(F.col("acts"), F.lit("reuses")).otherwise(F.lit("waits"))), "settled-lines")
        acting.append(settled.where("turn = 'acts'").select(*open_.columns))
        reusing.append(settled.where("turn = 'reuses'").select("step_id", "reused"))
        open_ = settled.where("turn = 'waits'").select(*open_.columns)
    if not reusing:
        return resolved
    again = reduce(DataFrame.union, reusing)
    hit = F.col("reused").isNotNull()
    return resolved.join(again, "step_id", "left").select(
        "step_id", F.when(hit, F.lit("REUSE")).otherwise(F.col("action")).alias("action"),
        F.coalesce("reused", "definition_id").alias("definition_id"),
        F.when(~hit, F.col("similarity")).alias("similarity"))


class FeatureReport:
    """The parts of a report, each made when it is first asked for."""

    def __init__(self, lines: DataFrame, graph: StoryGraph, by: list[str] | None, in_order: bool):
        self._lines, self._before, self._by, self._in_order = lines, graph, by, in_order
        self._nodes = lines.select("step_id", "text", "embedding").dropDuplicates(["step_id"])

    @cached_property
    def resolved(self) -> DataFrame:
        """step_id, action, definition_id, similarity."""
        graph = self._before
        found = materialize(resolve_steps(self._nodes, graph.steps, graph.binds, graph.definitions), "resolved_steps")
        if not self._in_order:
            return found
        return materialize(resolve_in_order(found, self._lines, graph.definitions), "ordered_steps")

    @cached_property
    def _made(self) -> DataFrame:
        return generated_definitions(self.resolved, self._nodes).withColumn("code_block", F.lit(None).cast("string"))

    @cached_property
    def _definitions(self) -> DataFrame:
        grown = self.resolved.where("action = 'EXPAND'").select("definition_id").dropDuplicates()
        kept = ["definition_id", "expression", "code_block"]
        widened = (self._before.definitions.select(*kept)
                   .join(grown.withColumn("_grow", F.lit(True)), "definition_id", "left")
                   .select("definition_id",
                           F.when(F.col("_grow"), widen(F.col("expression")))
                           .otherwise(F.col("expression")).alias("expression"),
                           F.when(F.col("_grow"), widen_code(F.col("code_block"), F.col("expression")))
                           .otherwise(F.col("code_block")).alias("code_block")))
        fresh = self._made.join(widened.select("definition_id"), "definition_id", "left_anti")
        return materialize(widened.unionByName(fresh.select(*kept)), "mapped_definitions")

    @cached_property
    def _binds(self) -> DataFrame:
        new_edges = self.resolved.where("definition_id IS NOT NULL").select("step_id", "definition_id")
        made_edges = (self._nodes.join(self.resolved.where("action = 'GENERATE'").select("step_id"), "step_id",
                                       "left_semi").select("step_id", "text")
                      .join(self._made.select("definition_id", F.col("expression").alias("text")), "text")
                      .select("step_id", "definition_id"))
        return upsert_edges(self._before.binds, new_edges.unionByName(made_edges), "BINDS")

    @cached_property
    def _pruning(self) -> tuple[DataFrame, DataFrame]:
        return prune_orphans(self._definitions, self._binds)

    @cached_property
    def coverage(self) -> DataFrame:
        """The grouping columns, matched, total, coverage, coverage_text, after the mapping."""
        found = reuse_coverage(self._lines, self._definitions, self._by)
        return found.withColumn("coverage_text", percent_text(F.col("coverage")))

    @cached_property
    def graph(self) -> StoryGraph:
        """With the new definitions and edges, orphans pruned."""
        return self._before.with_tables(definitions=self._pruning[0], binds=self._binds)

    @cached_property
    def pruned(self) -> DataFrame:
        """Definitions without any edge."""
        return self._pruning[1]


def feature_report(lines: DataFrame, graph: StoryGraph, by: list[str] | None = None,
                   in_order: bool = False) -> FeatureReport:
    """``lines``: step_id, step_type, text, embedding and the grouping columns; one row per line.

    Reused and expanded definitions get a BINDS edge, expanded ones a widened expression, and steps
    without any match a new definition, so that coverage is measured after the mapping.  ``in_order``:
    lines, in the order of their column ``ord``, see what earlier lines made (:func:`resolve_in_order`).
    """
    return FeatureReport(lines, graph, by, in_order)
