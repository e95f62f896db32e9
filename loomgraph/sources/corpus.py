"""Text corpora: whole-file scans and what is parsed out of them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import (DEFINITION_PREFIX, STEP_KEYWORDS, STEP_PREFIX, content_id,
                                      step_pattern, strip, title_of)

FILES = "file_name string, content string"
# Fixed value: one definition block - keyword, expression, optional block arguments, body.
DEFINITION_PATTERN = r"(?s)(Given|When|Then)\(\/\^(.*?)\$\/\) do( \|.*?\|)?\n(.*?)\nend"


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def read_corpus(spark: SparkSession, path: str, glob: str, required: bool = False) -> DataFrame:
    """(file_name, content) of the files in ``path`` whose name fits ``glob``.

    A missing folder is an error when ``required``, else an empty set.
    """
    if not path_exists(spark, path):
        if required:
            raise FileNotFoundError(f"Dataset directory {path} does not exist.")
        return spark.createDataFrame([], FILES)
    return (spark.read.text(path, wholetext=True, pathGlobFilter=glob)
            .select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("content")))


def story_nodes(files: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """UserStory rows; ``seeds`` (story_id, verified_spec) gives some files a verified spec."""
    nodes = files.select(F.col("file_name").alias("story_id"),
                         title_of(F.col("file_name")).alias("title"),
                         F.col("content").alias("description"))
    if seeds is None:
        return nodes.withColumn("verified_spec", F.lit(None).cast("string"))
    return nodes.join(seeds.select("story_id", "verified_spec"), "story_id", "left")


def parse_steps(files: DataFrame, keywords=STEP_KEYWORDS) -> DataFrame:
    """Step lines (file_name, line_no, step_type, text, step_id); other lines are dropped."""
    lines = files.select("file_name", F.posexplode(F.split("content", "\n")).alias("line_no", "raw"))
    line = lines.select("file_name", F.col("line_no").cast("bigint").alias("line_no"),
                        strip(F.col("raw")).alias("line"))
    pattern = F.lit(step_pattern(keywords))
    parsed = line.where(F.rlike("line", pattern)).select(
        "file_name", "line_no", F.regexp_extract("line", step_pattern(keywords), 1).alias("step_type"),
        F.regexp_extract("line", step_pattern(keywords), 2).alias("text"))
    return parsed.withColumn("step_id", content_id(F.col("text"), STEP_PREFIX))


def step_nodes(parsed: DataFrame, order_cols=("file_name", "line_no")) -> DataFrame:
    """One row per distinct text; the type of the last line with that text wins."""
    return parsed.groupBy("step_id").agg(
        F.max_by(F.struct("step_type", "text"), F.struct(*order_cols)).alias("s")
    ).select("step_id", F.col("s.step_type").alias("step_type"), F.col("s.text").alias("text"))


def parse_definitions(files: DataFrame) -> DataFrame:
    """Definition blocks (file_name, pos, definition_id, keyword, expression, code_block).

    ``swallowed`` marks an expression that runs over a line end: a one-line stub before it was
    taken in by the lazy pattern.
    """
    pattern = F.lit(DEFINITION_PATTERN)
    found = F.arrays_zip(*[F.regexp_extract_all("content", pattern, F.lit(g)).alias(name)
                           for g, name in ((1, "keyword"), (2, "expression"), (0, "code_block"))])
    rows = files.select("file_name", F.posexplode(found).alias("pos", "m"))
    return rows.select(
        "file_name", F.col("pos").cast("bigint").alias("pos"),
        content_id(F.col("m.expression"), DEFINITION_PREFIX).alias("definition_id"),
        F.col("m.keyword").alias("keyword"), F.col("m.expression").alias("expression"),
        F.col("m.code_block").alias("code_block"),
        F.contains("m.expression", F.lit("\n")).alias("swallowed"))


def definition_nodes(parsed: DataFrame) -> DataFrame:
    """One row per expression; its last block wins, its first position gives the binding order."""
    where = F.struct("file_name", "pos")
    return parsed.groupBy("definition_id").agg(
        F.max_by(F.struct("expression", "code_block"), where).alias("d"),
        F.min(where).alias("first")).select(
        "definition_id", F.col("d.expression").alias("expression"),
        F.col("d.code_block").alias("code_block"), F.col("first.file_name").alias("file_name"),
        F.col("first.pos").alias("pos"))
