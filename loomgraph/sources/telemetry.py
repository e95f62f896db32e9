"""Telemetry sources: the day-partitioned log table and the JSON-lines completion files."""
from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.schema import COMPLETION, LOG
from loomgraph.session import materialize

MAX_BAD = 1000  # fixed value: bad lines tolerated per read
_CORRUPT = "_bad_line"


def read_logs(spark: SparkSession, path: str, since: str | None = None,
              until: str | None = None, merge_schema: bool = True) -> DataFrame:
    """Log rows; ``since``/``until`` (days) prune partitions.

    ``merge_schema`` finds columns added later by reading every file's footer; without it only the
    declared columns are read.
    """
    if not merge_schema:
        logs = spark.read.schema(f"{LOG}, dt date").parquet(path)
    else:
        logs = spark.read.option("mergeSchema", "true").parquet(path)
    if since:
        logs = logs.where(F.col("dt") >= F.lit(since).cast("date"))
    if until:
        logs = logs.where(F.col("dt") <= F.lit(until).cast("date"))
    missing = [f for f in T.StructType.fromDDL(LOG).fields if f.name not in logs.columns]
    for field in missing:
        logs = logs.withColumn(field.name, F.lit(None).cast(field.dataType))
    return logs


def write_logs(logs: DataFrame, path: str, mode: str = "append") -> None:
    """Append to the table, one folder per day."""
    (logs.withColumn("dt", F.to_date("timestamp"))
         .write.mode(mode).partitionBy("dt").parquet(path))


def scan_completions(spark: SparkSession, path: str) -> tuple[DataFrame, Observation]:
    """Completion lines with ``file_uri``, and an observation that counts bad lines as they pass.

    Unknown fields are ignored, bad lines dropped.  Counting happens inside the one scan; call
    ``enforce_bad_limit`` once an action on the result has run.
    """
    raw = (spark.read.schema(f"{COMPLETION}, {_CORRUPT} string").option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", _CORRUPT).option("recursiveFileLookup", "true")
           .json(path).select("*", F.col("_metadata.file_path").alias("file_uri")))
    seen = Observation()
    counted = raw.observe(seen, F.count_if(F.col(_CORRUPT).isNotNull()).alias("bad"),
                          F.count(F.lit(1)).alias("lines"))
    return counted.where(F.col(_CORRUPT).isNull()).drop(_CORRUPT), seen


def read_completions(spark: SparkSession, path: str, max_bad: int = MAX_BAD) -> DataFrame:
    """Completion lines as a columnar table: the JSON is parsed once, the bad lines are counted in
    that same pass, and later reads only touch the columns they need."""
    rows, seen = scan_completions(spark, path)
    table = materialize(rows, "completions")
    enforce_bad_limit(seen, max_bad)
    return table


def enforce_bad_limit(seen: Observation, max_bad: int = MAX_BAD) -> int:
    bad = seen.get["bad"]
    if bad > max_bad:
        raise ValueError(f"{bad} bad records, at most {max_bad} are tolerated")
    return bad
