"""Log routing and feedback normalisation, the same functions for batch and stream frames."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEEDBACK = ("struct<score: string, text: string, log_type: string, service_name: string, "
            "user_id: string, session_id: string>")
FEEDBACK_TYPE = "feedback"  # fixed value


def route_logs(logs: DataFrame, log_name: str, ref_pattern: str) -> DataFrame:
    """Records of one log whose input or output reference matches, with their day."""
    refs = [F.col(f"labels.gen_ai_{kind}_messages_ref") for kind in ("input", "output")]
    wanted = F.lit(False)
    for ref in refs:
        wanted = wanted | F.coalesce(F.rlike(ref, F.lit(ref_pattern)), F.lit(False))
    return (logs.where((F.col("logName") == log_name) & wanted)
            .withColumn("dt", F.to_date("timestamp")))


def route_telemetry(records: DataFrame, service: str, kind: str) -> DataFrame:
    """Records whose labels name the service and the telemetry type."""
    return records.where((F.col("labels.service_name") == service)
                         & (F.col("labels.type") == kind))


def route_feedback(records: DataFrame, service: str) -> DataFrame:
    """Feedback payloads (JSON text ``payload``) of one service, with their day."""
    payload = F.from_json("payload", FEEDBACK)
    return (records.withColumn("feedback", payload)
            .where((F.col("feedback.log_type") == FEEDBACK_TYPE)
                   & (F.col("feedback.service_name") == service))
            .withColumn("dt", F.to_date("timestamp")))


def normalise_feedback(records: DataFrame, service: str) -> DataFrame:
    """Feedback rows (a ``feedback`` struct) with defaults; rows without a numeric score are dropped.

    Missing constants take their value, other constants are rejected; missing ids get a UUID.
    """
    f = F.col("feedback")
    score = F.expr("try_cast(feedback.score AS double)")
    rows = records.where(
        score.isNotNull()
        & (F.coalesce(f["log_type"], F.lit(FEEDBACK_TYPE)) == FEEDBACK_TYPE)
        & (F.coalesce(f["service_name"], F.lit(service)) == service))
    rest = [c for c in records.columns if c != "feedback"]
    return rows.select(
        *rest, score.alias("score"), F.coalesce(f["text"], F.lit("")).alias("text"),
        F.lit(FEEDBACK_TYPE).alias("log_type"), F.lit(service).alias("service_name"),
        F.coalesce(f["user_id"], F.uuid()).alias("user_id"),
        F.coalesce(f["session_id"], F.uuid()).alias("session_id"))


def write_days(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("dt").parquet(path)
