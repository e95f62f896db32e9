"""Session settings, and the one way the library cuts lineage.

Iterative operators (breadth-first search) and operators that read one input several times write
it to a table under the shared folder the cluster names in ``spark.checkpoint.dir``.  A written
table survives the loss of any executor; nothing is kept in executor storage.
"""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_local_roots: dict[str, str] = {}


def build_session(app: str = "loomgraph", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Run-time settings the results and the skew handling rely on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # split a hot join key even where that costs one more exchange downstream
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    # batches of 10,000 rows of text take tens of MB in the JVM and again, more than once, in Python
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    # a job of many written steps gives each step's shuffle files back when it ends; by default they
    # stay until the driver happens to collect its garbage
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    # on one machine the cluster default of 200 only makes for tiny tasks (and state stores)
    if spark.sparkContext.master.startswith("local") and (
            spark.conf.get("spark.sql.shuffle.partitions") == "200"):
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return spark


def shared_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for local runs that name none."""
    root = spark.conf.get(_CONF, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CONF} to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="loomgraph-")
    return _local_roots[app]


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one intermediate table."""
    return f"{shared_root(spark)}/loomgraph/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage, exact size statistics."""
    path = shared_path(df.sparkSession, label)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a table stored in fewer pieces than there are cores; else leave it.

    Only for plain scans ahead of CPU-heavy work: a large table is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_bucketed(df: DataFrame, label: str, keys: list[str], buckets: int) -> str:
    """Write ``df`` hash-bucketed on ``keys`` and return the table name.

    Every later join of that table on ``keys`` skips the table's shuffle.
    """
    spark = df.sparkSession
    table = f"{label}_{uuid.uuid4().hex}"
    # one task per bucket writes one file per bucket
    (df.repartition(buckets, *keys).write.bucketBy(buckets, *keys)
       .option("path", shared_path(spark, label)).format("parquet").saveAsTable(table))
    return table
