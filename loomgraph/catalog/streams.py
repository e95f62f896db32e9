"""Registered queries that run as streams: available data in, a table out."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.catalog import matching, telemetry
from loomgraph.catalog.behaviour import judged
from loomgraph.catalog.fixtures import load
from loomgraph.catalog.graph import story_graph
from loomgraph.catalog.registry import query
from loomgraph.operators import routing
from loomgraph.schema import BINDS, IMPLEMENTS
from loomgraph.session import shared_path
from loomgraph.streaming.dedup import dedup_stream
from loomgraph.streaming.ingest import read_graph, start_ingest, write_base
from loomgraph.streaming.monitor import monitor_stream, rocksdb
from loomgraph.streaming.routes import start_route


def as_stream(spark: SparkSession, rows: DataFrame, label: str) -> DataFrame:
    """Write the rows as files and read the folder as a stream."""
    path = shared_path(spark, label)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def drain(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """Run the stream over what is there and return the table it wrote."""
    out = shared_path(spark, label)
    (stream.writeStream.format("parquet").outputMode("append").option("path", out)
     .option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
     .awaitTermination())
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_monitor", judged(-0.2) + """
    SELECT run_id, seq, agent_name, status, CASE WHEN status = 'tripped' THEN trip_why END AS reason
    FROM report""")
def stream_monitor(spark, sf):
    rocksdb(spark)
    actions = as_stream(spark, load(spark, sf, "v_vec_action"), "action_stream")
    return drain(spark, monitor_stream(actions, drift=-0.2), "monitored")


@query("stream_route", """
    SELECT insert_id, strftime(to_timestamp(ts_s) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day
    FROM {v_log} l WHERE log_name = 'calls'""")
def stream_route(spark, sf):
    logs = as_stream(spark, telemetry.logs(spark, sf), "log_stream")
    out = shared_path(spark, "routed")
    start_route(logs, lambda df: routing.route_logs(df, telemetry.LOG_NAME, "completions"),
                out, f"{out}-state").awaitTermination()
    return spark.read.parquet(out).select(F.col("insertId").alias("insert_id"),
                                          F.date_format("dt", "yyyy-MM-dd").alias("day"))


@query("stream_feedback", """
    SELECT doc_id, strftime(to_timestamp(ts_s) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day,
           CAST(score AS DOUBLE) AS score
    FROM {v_feedback} f
    WHERE log_type = 'feedback' AND service_name = 'story-app' AND doc_id % 11 <> 0""")
def stream_feedback(spark, sf):
    records = as_stream(spark, telemetry.feedback_records(spark, sf), "feedback_stream")
    out = shared_path(spark, "feedback")
    start_route(records, lambda df: routing.normalise_feedback(
        routing.route_feedback(df, telemetry.SERVICE), telemetry.SERVICE),
        out, f"{out}-state").awaitTermination()
    return spark.read.parquet(out).select("doc_id", F.date_format("dt", "yyyy-MM-dd").alias("day"),
                                          "score")


@query("stream_dedup", "SELECT event_id, user_id, event_type FROM {events} e")
def stream_dedup(spark, sf):
    """Every event sent twice, kept once."""
    rows = load(spark, sf, "events").select("event_id", "user_id", "event_type",
                                            F.col("ts").cast("timestamp").alias("timestamp"))
    stream = as_stream(spark, rows.unionByName(rows), "event_stream")
    kept = drain(spark, dedup_stream(stream, ["event_id"]), "deduped")
    return kept.select("event_id", "user_id", "event_type")


@query("stream_ingest", f"""
    SELECT 'BINDS' AS label, step_id AS src, definition_id AS dst
    FROM (SELECT DISTINCT text, step_id FROM {{v_line}} l) s
    JOIN ({matching._FIRST_ANY.replace("arg_min(definition_id, expression)", "min(definition_id)")}) f
      USING (text)
    UNION ALL SELECT 'IMPLEMENTS', story_id, step_id FROM {{v_implements}} i""")
def stream_ingest(spark, sf):
    """Step lines arrive as a stream and grow a graph that only had definitions."""
    root = shared_path(spark, "growing_graph")
    start = story_graph(spark, sf)
    write_base(start.with_tables(
        steps=start.steps.where(F.lit(False)), implements=spark.createDataFrame([], IMPLEMENTS),
        binds=spark.createDataFrame([], BINDS)), root)
    links = load(spark, sf, "v_implements")
    lines = load(spark, sf, "v_line").join(links, "step_id", "left").select(
        "story_id", "step_id", "step_type", "text", "ord")
    start_ingest(as_stream(spark, lines, "line_stream"), root, f"{root}/state").awaitTermination()
    grown = read_graph(spark, root)
    return grown.edges().where("label <> 'DEPENDS_ON'").select("label", "src", "dst")
