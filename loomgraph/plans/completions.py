"""The completions view: message parts of every logged model call, each message once."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import api_call_id

OUTPUT = ("timestamp", "insert_id", "trace", "span_id", "conversation_id", "api_call_id",
          "message_type", "role", "message_idx", "part_idx", "content", "part_type", "tool_name",
          "tool_args", "tool_response", "usage_input_tokens", "usage_output_tokens", "agent_name",
          "finish_reasons", "user_id", "uri", "mime_type", "data_md5_hex", "messages_ref_uri")
SORT = ("conversation_id", "timestamp", "message_type", "message_idx", "part_idx")


def log_refs(logs: DataFrame) -> DataFrame:
    """Flat projection of the log rows that refer to an input or an output file."""
    label = "labels.gen_ai_"
    refs = logs.select(
        F.col("insertId").alias("insert_id"), "timestamp", "trace", F.col("spanId").alias("span_id"),
        F.col(label + "conversation_id").alias("conversation_id"),
        F.col(label + "input_messages_ref").alias("input_ref"),
        F.col(label + "output_messages_ref").alias("output_ref"),
        F.col(label + "usage_input_tokens").alias("usage_input_tokens"),
        F.col(label + "usage_output_tokens").alias("usage_output_tokens"),
        F.col(label + "agent_name").alias("agent_name"),
        F.col(label + "response_finish_reasons").alias("finish_reasons"),
        F.col("labels.user_id").alias("user_id"))
    return refs.where(F.col("input_ref").isNotNull() | F.col("output_ref").isNotNull())


def unpivot_refs(refs: DataFrame) -> DataFrame:
    """One row per message reference, from a single scan of the log."""
    rest = [c for c in refs.columns if c not in ("input_ref", "output_ref")]
    pair = F.array(*[F.struct(F.lit(kind).alias("message_type"),
                              F.col(f"{kind}_ref").alias("messages_ref_uri"))
                     for kind in ("input", "output")])
    return (refs.select(*rest, F.inline(pair)).where("messages_ref_uri IS NOT NULL")
            .withColumn("api_call_id", api_call_id(F.col("messages_ref_uri"))))


def part_keys(refs: DataFrame, completions: DataFrame) -> DataFrame:
    """References joined to their file lines, one row per message part, without any content.

    Assistant messages echoed back as input, and input without a role, never reach the result;
    ``role`` and ``message_type`` are keys of both later steps, so they are dropped right here.
    """
    lines = completions.select(F.col("file_uri").alias("messages_ref_uri"), "role",
                               F.col("index").alias("message_idx"), F.size("parts").alias("n_parts"))
    joined = refs.join(lines.where("n_parts > 0"), "messages_ref_uri").where(
        ~((F.col("message_type") == "input") & (F.col("role") == "assistant")))
    part_idx = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_parts").cast("bigint") - 1))
    return joined.withColumn("part_idx", part_idx).drop("n_parts")


def dedup_parts(parts: DataFrame) -> DataFrame:
    """Keep the newest copy within a trace and span, then the oldest input copy per conversation.

    Output rows are unique after the first step and all stay: their trace and span join the second
    step's key, which leaves a plain ``row_number = 1`` that Spark turns into a group limit before
    the shuffle.  So rows without a conversation id do not pile up in one task either.
    """
    message = ["conversation_id", "message_type", "role", "message_idx", "part_idx"]
    ties = ["insert_id", "messages_ref_uri"]
    newest = Window.partitionBy(*message, "trace", "span_id").orderBy(F.desc("timestamp"), *ties)
    is_output = F.col("message_type") == "output"
    oldest = Window.partitionBy(*message, F.when(is_output, F.col("trace")),
                                F.when(is_output, F.col("span_id"))).orderBy("timestamp", *ties)
    once = parts.withColumn("_n", F.row_number().over(newest)).where("_n = 1")
    return once.withColumn("_n", F.row_number().over(oldest)).where("_n = 1").drop("_n")


def attach_parts(winners: DataFrame, completions: DataFrame) -> DataFrame:
    """Fetch the content of the parts that stay.

    A line is found by its file, role and index; should a file hold several such lines, one of them
    is taken, as in the view.  That last step runs on the join's own partitioning.
    """
    line = F.concat(F.coalesce(F.col("message_idx").cast("string"), F.lit("")), F.lit("|"),
                    F.coalesce("role", F.lit("\0")))
    files = completions.select(F.col("file_uri").alias("messages_ref_uri"), "role", "parts",
                               F.col("index").alias("message_idx")).select(
        "messages_ref_uri", line.alias("_line"), "parts")
    part = F.try_element_at("parts", (F.col("part_idx") + 1).cast("int"))
    rows = (winners.withColumn("_line", line).join(files, ["messages_ref_uri", "_line"])
            .where(F.size("parts") > F.col("part_idx")).withColumn("part", part).drop("parts"))
    keys = ["messages_ref_uri", "_line", "part_idx", "message_type", "insert_id", "trace", "span_id",
            "conversation_id", "timestamp"]
    one = Window.partitionBy(*keys).orderBy("part.content")
    rows = rows.withColumn("_n", F.row_number().over(one)).where("_n = 1")
    return rows.select(
        *[c for c in winners.columns], F.col("part.content").alias("content"),
        F.col("part.type").alias("part_type"), F.col("part.name").alias("tool_name"),
        F.col("part.arguments").alias("tool_args"), F.col("part.response").alias("tool_response"),
        F.col("part.uri").alias("uri"), F.col("part.mime_type").alias("mime_type"),
        F.md5("part.data").alias("data_md5_hex"), F.col("part.id").alias("tool_id"))


def completions_view(logs: DataFrame, completions: DataFrame, ordered: bool = True) -> DataFrame:
    """The whole view; ``ordered=False`` leaves out the global sort, e.g. for a table write.

    Input files repeat the whole conversation, so most parts lose.  Both de-duplication steps
    therefore run on keys only, and message content is shuffled once, to meet the few rows left.
    """
    refs = unpivot_refs(log_refs(logs))
    winners = dedup_parts(part_keys(refs, completions))
    view = attach_parts(winners, completions).select(*OUTPUT)
    return view.orderBy(*SORT) if ordered else view


def token_rollup(view: DataFrame) -> DataFrame:
    """Tokens per conversation and agent; the view repeats them on every row of a span."""
    spans = view.groupBy("conversation_id", "agent_name", "trace", "span_id").agg(
        F.max(F.expr("try_cast(usage_input_tokens AS bigint)")).alias("i"),
        F.max(F.expr("try_cast(usage_output_tokens AS bigint)")).alias("o"))
    return spans.groupBy("conversation_id", "agent_name").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("i").alias("input_tokens"),
        F.sum("o").alias("output_tokens"))
