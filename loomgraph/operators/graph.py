"""The labelled property graph: views, pattern joins, dependents and the impact map."""
from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.text import relation
from loomgraph.schema import EDGE_KEYS, NODE_KEYS, edge_key, node_key
from loomgraph.session import materialize, shared_path, write_bucketed

BUCKET_ROWS = 1_000_000


@dataclass(frozen=True)
class StoryGraph:
    """Three node tables and three edge tables."""

    stories: DataFrame
    steps: DataFrame
    definitions: DataFrame
    implements: DataFrame
    binds: DataFrame
    depends_on: DataFrame

    def with_tables(self, **tables: DataFrame) -> "StoryGraph":
        return replace(self, **tables)

    def node_table(self, label: str) -> DataFrame:
        node_key(label)
        return {"UserStory": self.stories, "GherkinStep": self.steps,
                "RubyDefinition": self.definitions}[label]

    def edge_table(self, label: str) -> DataFrame:
        edge_key(label)
        return {"IMPLEMENTS": self.implements, "BINDS": self.binds,
                "DEPENDS_ON": self.depends_on}[label.upper()]

    def all_steps(self) -> DataFrame:
        return self.steps.select("step_id", "step_type", "text")

    def all_definitions(self) -> DataFrame:
        return self.definitions.select("definition_id", "expression", "code_block")

    def nodes(self) -> DataFrame:
        parts = [self.node_table(label).select(F.col(key).alias("id"), F.lit(label).alias("label"))
                 for label, key in NODE_KEYS.items()]
        return reduce(DataFrame.unionByName, parts)

    def edges(self) -> DataFrame:
        parts = [self.edge_table(label).select(F.col(src).alias("src"), F.col(dst).alias("dst"),
                                               F.lit(label).alias("label"))
                 for label, (src, dst) in EDGE_KEYS.items()]
        return reduce(DataFrame.unionByName, parts)

    def load_summary(self) -> DataFrame:
        return self.nodes().groupBy("label").agg(F.count(F.lit(1)).alias("n"))

    def match(self, label: str) -> DataFrame:
        """Rows of the two-node pattern over one edge label."""
        label = label.upper()
        if label == "IMPLEMENTS":
            return (self.implements
                    .join(self.stories.select("story_id", "title", "description"), "story_id")
                    .join(self.all_steps(), "step_id")
                    .select("story_id", "title", "description", "step_id", "step_type", "text"))
        if label == "BINDS":
            return (self.binds.join(self.steps.select("step_id", "text"), "step_id")
                    .join(self.all_definitions(), "definition_id")
                    .select("step_id", "text", "definition_id", "expression", "code_block"))
        edge_key(label)
        left = self.stories.select("story_id", F.col("title").alias("story_title"))
        right = self.stories.select(F.col("story_id").alias("depends_on_id"),
                                    F.col("title").alias("depends_on_title"))
        return (self.depends_on.withColumnRenamed("depends_on_story_id", "depends_on_id")
                .join(left, "story_id").join(right, "depends_on_id")
                .select("story_id", "story_title", "depends_on_id", "depends_on_title"))


def direct_dependents(stories: DataFrame, depends_on: DataFrame, targets: DataFrame) -> DataFrame:
    """Stories with at least one DEPENDS_ON edge to a target (``targets.story_id``)."""
    wanted = targets.select(F.col("story_id").alias("depends_on_story_id"))
    sources = depends_on.join(wanted, "depends_on_story_id", "left_semi").select("story_id")
    return stories.select("story_id", "title").join(sources, "story_id", "left_semi")


def impact_map(stories: DataFrame, depends_on: DataFrame, targets: DataFrame,
               max_depth: int | None = None, through_missing: bool = False,
               bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All transitive dependents of every target with their least depth.

    Breadth first for all targets at once: one join per level against an edge table that is written
    once.  Beyond ``bucket_rows`` edges it is hash-bucketed on the followed column, so that no level
    shuffles the edges again, and nodes with more than ``bucket_rows`` dependents are cut into slices.
    There are at most as many buckets as shuffle partitions, unless one would exceed ``BUCKET_ROWS`` edges.
    The pairs seen so far are one table, hash-bucketed on (target, story); each level is laid out the
    same way, meets its bucket there and is added to it, so what was seen is never shuffled again and all
    levels together shuffle in proportion to the result.  A pair is entered once, so cycles end and
    the target itself is returned when a cycle leads back to it.

    ``through_missing``: walk through ids that have no story row (they are never returned);
    otherwise such dependents end the walk.
    """
    titles = stories.select("story_id", "title")
    edges = depends_on.select("story_id", F.col("depends_on_story_id").alias("node")).dropDuplicates()
    if not through_missing:
        edges = edges.join(titles.select("story_id"), "story_id", "left_semi")
    spark = stories.sparkSession
    edges = materialize(edges, "impact_edges")
    n_edges = edges.count()
    bucketed = heavy = None
    keys = ["node"]
    if n_edges > bucket_rows:
        # a node with very many dependents is cut into slices, each about one bucket's worth
        heavy = materialize(
            edges.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / bucket_rows).cast("int").alias("slices"))
            .where("slices > 1"), "impact_heavy")
        if heavy.isEmpty():
            heavy = None
        else:
            keys = ["node", "slice"]
            cut = F.pmod(F.xxhash64("story_id"), F.coalesce("slices", F.lit(1))).cast("int")
            sliced = edges.join(heavy, "node", "left").withColumn("slice", cut).drop("slices")
        # a bucket is a task of every level: no more of them than shuffle partitions while they stay small enough
        buckets = max(math.ceil(n_edges / max(bucket_rows, BUCKET_ROWS)),
                      min(math.ceil(n_edges / bucket_rows), int(spark.conf.get("spark.sql.shuffle.partitions"))))
        bucketed = write_bucketed(edges if heavy is None else sliced, "impact_edges", keys, buckets)

    frontier = targets.select(F.col("story_id").alias("target"),
                              F.col("story_id").alias("node")).dropDuplicates()
    schema = frontier.schema
    seen = SeenPairs(spark, schema)
    depth = 0
    while max_depth is None or depth < max_depth:
        # many targets on one node: a plain join, whose two shuffled sides Spark can split by itself
        if bucketed is None or _largest_group(frontier, "node") > bucket_rows:
            step = frontier.join(edges, "node")
        else:
            if heavy is not None:
                every = F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)
                frontier = frontier.join(heavy, "node", "left").withColumn("slice", F.explode(every))
            step = frontier.join(spark.table(bucketed), keys)
        depth += 1
        frontier = seen.add(seen.fresh(step.select("target", F.col("story_id").alias("node"))), depth)
        if frontier.isEmpty():
            break
    seen.close()
    if bucketed:
        spark.sql(f"DROP TABLE {bucketed}")  # every level is a written table of its own
    if depth:
        leveled = T.StructType(schema.fields + [T.StructField("depth", T.IntegerType())])
        found = spark.read.schema(leveled).parquet(seen.path)
    else:
        found = frontier.withColumn("depth", F.lit(0)).where(F.lit(False))
    return (found.withColumnRenamed("node", "story_id").join(titles, "story_id")
            .select("target", "story_id", "title", "depth", relation(F.col("depth")).alias("relation")))


class SeenPairs:
    """The (target, node) pairs entered so far, by depth, in buckets of (target, node)."""

    KEYS = ["target", "node"]

    def __init__(self, spark: SparkSession, schema: T.StructType):
        self.spark, self.schema = spark, schema
        self.path = shared_path(spark, "impact_levels")
        self.table = f"impact_levels_{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.entered = False

    def fresh(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs that are new, once each: one shuffle, of the given pairs only."""
        once = pairs.repartition(self.buckets, *self.KEYS).dropDuplicates(self.KEYS)
        if not self.entered:
            return once
        return once.join(self.spark.table(self.table).select(*self.KEYS), self.KEYS, "left_anti")

    def add(self, pairs: DataFrame, depth: int) -> DataFrame:
        """Enter pairs that are laid out in buckets already; returns them, read back."""
        (pairs.withColumn("depth", F.lit(depth)).write.partitionBy("depth").bucketBy(self.buckets, *self.KEYS)
         .option("path", self.path).format("parquet").mode("append").saveAsTable(self.table))
        self.entered = True
        return self.spark.table(self.table).where(F.col("depth") == depth).select(*self.KEYS)

    def close(self) -> None:
        """Forget the table's name; its files stay and are read by path."""
        if self.entered:
            self.spark.sql(f"DROP TABLE {self.table}")


def _largest_group(df: DataFrame, key: str) -> int:
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def impact_summary(impact: DataFrame) -> DataFrame:
    """Dependents per target: how many, how many direct ones, and how deep."""
    return impact.groupBy("target").agg(
        F.count(F.lit(1)).alias("dependents"),
        F.count_if(F.col("depth") == 1).alias("direct"),
        F.max("depth").alias("max_depth"))


def impact_context(impact: DataFrame, lines_per_page: int = 1000) -> DataFrame:
    """Warning text per (target, depth, page), one line per dependent in id order.

    A target with very many dependents is cut into pages of ``lines_per_page`` lines that follow each
    other in id order.  Places are counted in ranges of ids, so no task holds all lines of one target.
    """
    label = F.when(F.col("depth") == 1, F.lit("Direct")).otherwise(
        F.concat(F.lit("Indirect (Depth "), F.col("depth").cast("string"), F.lit(")")))
    line = F.concat(F.lit("- ["), label, F.lit("] "), F.col("story_id"), F.lit(" ("),
                    F.col("title"), F.lit(")"))
    placed = materialize(
        impact.select("target", "depth", "story_id", line.alias("line"))
        .repartitionByRange("target", "depth", "story_id").withColumn("_range", F.spark_partition_id()),
        "impact-lines")
    by_range = Window.partitionBy("target", "depth").orderBy("_range")
    sizes = placed.groupBy("target", "depth", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("target", "depth", "_range", (F.sum("_n").over(by_range) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("target", "depth", "_range").orderBy("story_id", "line")) - 1
    page = F.floor((F.col("_before") + F.col("_place")) / lines_per_page).cast("bigint")
    return (placed.withColumn("_place", place).join(before, ["target", "depth", "_range"])
            .select("target", "depth", page.alias("page"), "story_id", "line")
            .groupBy("target", "depth", "page")
            .agg(F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct("story_id", "line"))),
                lambda x: x["line"]), "\n").alias("context"),
                F.count(F.lit(1)).alias("n_lines")))
