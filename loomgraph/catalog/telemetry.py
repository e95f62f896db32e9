"""Registered queries over logs and completion files."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.catalog.fixtures import load, run
from loomgraph.catalog.registry import query
from loomgraph.operators import routing
from loomgraph.plans import completions as view
from loomgraph.session import shared_path
from loomgraph.sources import telemetry as source

LOG_NAME = "calls"
SERVICE = "story-app"


def logs(spark: SparkSession, sf: str) -> DataFrame:
    """The log rows in their nested schema."""
    flat = load(spark, sf, "v_log")
    text = F.lit(None).cast("string")
    labels = F.struct(
        F.col("conversation_id").alias("gen_ai_conversation_id"),
        F.col("agent_name").alias("gen_ai_agent_name"),
        F.col("input_ref").alias("gen_ai_input_messages_ref"),
        F.col("output_ref").alias("gen_ai_output_messages_ref"),
        text.alias("gen_ai_system_instructions_ref"),
        F.col("in_tokens").alias("gen_ai_usage_input_tokens"),
        F.col("out_tokens").alias("gen_ai_usage_output_tokens"),
        F.lit("stop").alias("gen_ai_response_finish_reasons"), F.col("user_id"))
    return flat.select(
        F.col("log_name").alias("logName"), text.alias("textPayload"),
        F.timestamp_seconds("ts_s").alias("timestamp"), F.col("insert_id").alias("insertId"),
        "trace", F.col("span_id").alias("spanId"), labels.alias("labels"))


def completions(spark: SparkSession, sf: str) -> DataFrame:
    """The completion lines: one text part per line of the message."""
    lines = load(spark, sf, "v_line_of_file")
    text = F.lit(None).cast("string")
    said = F.col("role") == "assistant"
    asked = F.col("role") == "user"
    parts = F.transform(F.split("text", "\n"), lambda line: F.struct(
        F.lit("text").alias("type"), line.alias("content"), F.lit("text/plain").alias("mime_type"),
        text.alias("uri"), F.when(said, F.encode(line, "UTF-8")).alias("data"), text.alias("id"),
        F.when(asked, F.lit("lookup")).alias("name"),
        F.when(asked, F.lit('{"q": 1}')).alias("arguments"), text.alias("response")))
    return lines.select("file_uri", "role", F.col("idx").alias("index"), parts.alias("parts"))


def completions_result(spark: SparkSession, sf: str) -> DataFrame:
    rows = view.completions_view(logs(spark, sf), completions(spark, sf))
    return rows.withColumn("ts_s", F.unix_seconds("timestamp")).drop("timestamp")


# message parts with their call, before any de-duplication
_PARTS = """
    calls AS (
        SELECT *, 'input' AS message_type, input_ref AS messages_ref_uri FROM {v_log} a
        WHERE input_ref IS NOT NULL
        UNION ALL
        SELECT *, 'output' AS message_type, output_ref AS messages_ref_uri FROM {v_log} b
        WHERE output_ref IS NOT NULL),
    parts AS (
        SELECT c.*, f.role, f.idx AS message_idx, u.pos - 1 AS part_idx, u.line AS content
        FROM calls c JOIN {v_line_of_file} f ON f.file_uri = c.messages_ref_uri,
             LATERAL (SELECT unnest(string_split(f.text, chr(10))) AS line,
                             generate_subscripts(string_split(f.text, chr(10)), 1) AS pos) u),
    once AS (
        SELECT * FROM parts
        QUALIFY row_number() OVER (
            PARTITION BY conversation_id, trace, span_id, message_type, role, message_idx, part_idx
            ORDER BY ts_s DESC, insert_id) = 1),
    kept AS (
        SELECT * FROM once WHERE message_type = 'output'
        UNION ALL
        SELECT * FROM (
            SELECT * FROM once WHERE message_type = 'input'
            QUALIFY row_number() OVER (PARTITION BY conversation_id, role, message_idx, part_idx
                                       ORDER BY ts_s, insert_id) = 1) i
        WHERE role <> 'assistant')"""

query("completions_view", "WITH" + _PARTS + """
    SELECT ts_s, insert_id, trace, span_id, conversation_id,
           split_part(regexp_extract(messages_ref_uri, '/([^/]+)\\.jsonl', 1), '_', 1) AS api_call_id,
           message_type, role, message_idx, part_idx, content, 'text' AS part_type,
           CASE WHEN role = 'user' THEN 'lookup' END AS tool_name,
           CASE WHEN role = 'user' THEN '{"q": 1}' END AS tool_args,
           CAST(NULL AS VARCHAR) AS tool_response, in_tokens AS usage_input_tokens,
           out_tokens AS usage_output_tokens, agent_name, 'stop' AS finish_reasons, user_id,
           CAST(NULL AS VARCHAR) AS uri, 'text/plain' AS mime_type,
           CASE WHEN role = 'assistant' THEN md5(content) END AS data_md5_hex, messages_ref_uri
    FROM kept""")(completions_result)


@query("log_refs_unpivot", """
    SELECT insert_id, trace, conversation_id, message_type, messages_ref_uri,
           split_part(regexp_extract(messages_ref_uri, '/([^/]+)\\.jsonl', 1), '_', 1) AS api_call_id
    FROM (UNPIVOT (SELECT insert_id, trace, conversation_id, input_ref AS input,
                          output_ref AS output FROM {v_log} l)
          ON input, output INTO NAME message_type VALUE messages_ref_uri) u""")
def log_refs_unpivot(spark, sf):
    refs = view.unpivot_refs(view.log_refs(logs(spark, sf)))
    return refs.select("insert_id", "trace", "conversation_id", "message_type", "messages_ref_uri",
                       "api_call_id")


@query("token_rollup", "WITH" + _PARTS + """
    SELECT conversation_id, agent_name, count(*) AS calls,
           CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens
    FROM (SELECT DISTINCT conversation_id, agent_name, trace, span_id,
                 TRY_CAST(in_tokens AS BIGINT) AS i, TRY_CAST(out_tokens AS BIGINT) AS o
          FROM kept) s
    GROUP BY conversation_id, agent_name""")
def token_rollup(spark, sf):
    rows = view.completions_view(logs(spark, sf), completions(spark, sf), ordered=False)
    return view.token_rollup(rows)


@query("log_route", """
    SELECT strftime(to_timestamp(ts_s) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS n,
           min(insert_id) AS first_id
    FROM {v_log} l
    WHERE log_name = 'calls' AND (regexp_matches(input_ref, 'completions/[0-9]*[02468]-')
                                  OR regexp_matches(output_ref, 'completions/[0-9]*[02468]-'))
    GROUP BY 1""")
def log_route(spark, sf):
    routed = routing.route_logs(logs(spark, sf), LOG_NAME, "completions/[0-9]*[02468]-")
    return routed.groupBy(F.date_format("dt", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.min("insertId").alias("first_id"))


def feedback_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "v_feedback")
    payload = F.to_json(F.struct(
        F.when(F.col("doc_id") % 11 == 0, F.lit("none")).otherwise(
            F.col("score").cast("string")).alias("score"),
        F.when(F.col("toxic") == 0, F.concat(F.lit("note "), F.col("doc_id"))).alias("text"),
        "log_type", "service_name",
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("u"), F.col("doc_id"))).alias("user_id")))
    return rows.select("doc_id", F.timestamp_seconds("ts_s").alias("timestamp"),
                       payload.alias("payload"))


@query("feedback_route", """
    SELECT strftime(to_timestamp(ts_s) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS n
    FROM {v_feedback} f WHERE log_type = 'feedback' AND service_name = 'story-app' GROUP BY 1""")
def feedback_route(spark, sf):
    routed = routing.route_feedback(feedback_records(spark, sf), SERVICE)
    return routed.groupBy(F.date_format("dt", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n"))


@query("feedback_normalise", """
    SELECT doc_id, CAST(score AS DOUBLE) AS score,
           CASE WHEN toxic = 0 THEN concat('note ', doc_id) ELSE '' END AS text,
           'feedback' AS log_type, 'story-app' AS service_name,
           CASE WHEN doc_id % 2 = 0 THEN concat('u', doc_id) ELSE 'generated' END AS user_id
    FROM {v_feedback} f
    WHERE log_type = 'feedback' AND service_name = 'story-app' AND doc_id % 11 <> 0""")
def feedback_normalise(spark, sf):
    routed = routing.route_feedback(feedback_records(spark, sf), SERVICE)
    rows = routing.normalise_feedback(routed, SERVICE)
    shown = F.when(F.length("user_id") == 36, F.lit("generated")).otherwise(F.col("user_id"))
    return rows.select("doc_id", "score", "text", "log_type", "service_name", shown.alias("user_id"))


@query("logs_source", """
    SELECT strftime(to_timestamp(ts_s) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS n,
           count(input_ref) AS inputs
    FROM {v_log} l GROUP BY 1""")
def logs_source(spark, sf):
    """Write the log table by day and scan it back."""
    path = shared_path(spark, "log_table")
    source.write_logs(logs(spark, sf), path)
    return source.read_logs(spark, path).groupBy(F.date_format("dt", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("labels.gen_ai_input_messages_ref").alias("inputs"))


@query("completions_source", """
    SELECT role, count(*) AS lines, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_parts,
           CAST(sum(idx) AS BIGINT) AS idx_sum
    FROM {v_line_of_file} f GROUP BY role""")
def completions_source(spark, sf):
    """JSON-lines files with an unknown field, and one bad line per first turn of a conversation."""
    path = shared_path(spark, "completion_files")
    lines = completions(spark, sf).select(F.to_json(F.struct(
        "parts", "role", "index", F.lit("x").alias("unknown_field"))).alias("value"))
    bad = run(spark, sf, "SELECT concat('{{', '\"role\": ', conv_id) AS value "
                         "FROM {conversations} c WHERE turn = 0")
    lines.unionByName(bad).write.text(path)
    rows = source.read_completions(spark, path, max_bad=bad.count())
    return rows.groupBy("role").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.size("parts")).alias("n_parts"),
        F.sum("index").alias("idx_sum"))
