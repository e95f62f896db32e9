"""Evaluation: grading, scorecards, rubric scores, metrics, agent events and attempts."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import clamp_score, contains_text
from loomgraph.schema import EVAL_CASE, EVAL_DATASET

MAX_ATTEMPTS = 5  # fixed value


def _breaker() -> Column:
    return ((F.col("actual") == F.col("expected.circuit_breaker_tripped"))
            & contains_text(F.coalesce("reason", F.lit("")), F.col("expected.reason_contains")))


def _rejection() -> Column:
    reason = F.coalesce("reason", F.lit(""))
    return F.col("actual") & (contains_text(reason, F.col("expected.reason_contains"))
                              | F.contains(F.lower(reason), F.lit("rejected")))


# How each case is graded; ``actual`` is tripped / raised / reused / scaffolded respectively.
RULES: dict[str, Callable[[], Column]] = {
    "eval_infinite_loop": _breaker,
    "eval_intent_drift": _breaker,
    "eval_quorum_rejection": _rejection,
    "eval_step_reuse": lambda: F.col("actual") == F.col("expected.reused"),
    "eval_step_generate": lambda: F.col("actual") == F.col("expected.scaffolded"),
}


def read_eval_cases(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Eval cases from JSON arrays, one per file (``multi_line``) or line."""
    return spark.read.schema(EVAL_CASE).option("multiLine", multi_line).json(path)


def read_eval_dataset(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per case of either shape: single prompt, or a list of turns with events."""
    sets = spark.read.schema(EVAL_DATASET).option("multiLine", multi_line).json(path)
    return flatten_eval_dataset(sets)


def flatten_eval_dataset(sets: DataFrame) -> DataFrame:
    case = sets.select(F.inline("eval_cases"))
    events = F.flatten(F.transform("agent_data.turns", lambda t: t["events"]))
    asked = F.filter(events, lambda e: e["author"] == "user")
    first = F.try_element_at(asked, F.lit(1))["content"]
    parts = F.coalesce(F.col("prompt.parts"), first["parts"])
    reference = F.col("reference.response.parts")
    return case.select(
        "eval_case_id", F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("prompt"),
        F.array_join(F.transform(reference, lambda p: p["text"]), "\n").alias("reference"),
        turn_count(F.col("agent_data.turns")).alias("turns"), "agent_data")


def turn_count(turns: Column) -> Column:
    return F.when(turns.isNull(), F.lit(0)).otherwise(F.size(turns)).cast("bigint")


def grade(cases: DataFrame, results: DataFrame,
          rules: dict[str, Callable[[], Column]] | None = None, by: str = "case_id") -> DataFrame:
    """Cases with ``passed``; results are (case_id, actual, reason), unknown rules are left out.

    ``by`` names the case column that selects the rule.
    """
    rules = RULES if rules is None else rules
    joined = cases.where(F.col(by).isin(*rules)).join(results, "case_id")
    verdict = F.lit(None).cast("boolean")
    for name, rule in rules.items():
        verdict = F.when(F.col(by) == name, rule()).otherwise(verdict)
    return joined.withColumn("passed", F.coalesce(verdict, F.lit(False)))


def scorecard(graded: DataFrame, by: list[str] | None = None) -> DataFrame:
    return graded.groupBy(*(by or [])).agg(
        F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"),
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_passed"))


def rubric_summary(scores: DataFrame) -> DataFrame:
    """Long-form rubric scores (artifact_id, dimension, score) to one row per dimension."""
    return scores.groupBy("dimension").agg(
        F.count("score").alias("n"), F.avg("score").alias("avg_score"),
        F.min("score").alias("min_score"), F.max("score").alias("max_score"))


def rubric_wide(scores: DataFrame, dimensions: list[str]) -> DataFrame:
    return scores.groupBy("artifact_id").pivot("dimension", dimensions).agg(F.max("score"))


def agent_turn_count(conversations: DataFrame, cases: DataFrame) -> DataFrame:
    """Turns per case from a turn table (case_id per row); a case without turns scores 0."""
    turns = conversations.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    return cases.select("case_id").join(turns, "case_id", "left").select(
        "case_id", F.coalesce("n", F.lit(0)).alias("turns"))


class MetricRegistry:
    """Metrics by name: a Column expression over the instances, or a Python batch function.

    A Python metric takes a pandas frame of instances and returns one score per row.
    """

    def __init__(self) -> None:
        self._columns: dict[str, Column] = {}
        self._python: dict[str, Callable] = {}

    def add(self, name: str, column: Column) -> "MetricRegistry":
        self._columns[name] = column
        return self

    def add_python(self, name: str, score: Callable) -> "MetricRegistry":
        self._python[name] = score
        return self

    def run(self, instances: DataFrame) -> DataFrame:
        """(case_id, metric, score); one pass for the Columns, one for the functions."""
        out = []
        if self._columns:
            rows = F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("score"))
                             for n, c in self._columns.items()])
            out.append(instances.select("case_id", F.inline(rows)))
        if self._python:
            out.append(instances.mapInPandas(_python_metrics(dict(self._python)),
                                             _metric_schema(instances)))
        if not out:
            raise ValueError("no metrics registered")
        return reduce(DataFrame.unionByName, out)


def _metric_schema(instances: DataFrame) -> str:
    key = instances.schema["case_id"].dataType.simpleString()
    return f"case_id {key}, metric string, score double"


def _python_metrics(scores: dict[str, Callable]):
    def run(batches):
        for pdf in batches:
            for name, score in scores.items():
                out = pdf[["case_id"]].copy()
                out["metric"] = name
                out["score"] = [float(s) for s in score(pdf)]
                yield out
    return run


def judged_scores(verdicts: DataFrame) -> DataFrame:
    """Clamp verdict scores to 1..5; a missing verdict scores 0."""
    return verdicts.withColumn("score", clamp_score(F.col("score")))


def last_complete(events: DataFrame, author: str) -> DataFrame:
    """Newest complete event per run by ``author`` (run_id, seq, value).

    Events carry ``partial``, ``state_delta`` (a map) under ``state_key``, and ``output``.  An event
    whose map has the key gives that value, even a NULL one; else its output, if there is one;
    an event with neither is passed over for an older one.
    """
    keyed = F.coalesce(F.map_contains_key("state_delta", F.col("state_key")), F.lit(False))
    usable = events.where((F.col("author") == author) & ~F.col("partial")
                          & (keyed | F.col("output").isNotNull()))
    value = F.when(keyed, F.try_element_at("state_delta", F.col("state_key"))).otherwise(F.col("output"))
    return (usable.select("run_id", "seq", value.alias("value")).groupBy("run_id")
            .agg(F.max_by(F.struct("seq", "value"), "seq").alias("e")).select("run_id", "e.*"))


def attempt_rollup(attempts: DataFrame, max_attempts: int | None = None) -> DataFrame:
    """Per run: attempts made, first successful one, verified flag.

    All attempts count; with ``max_attempts`` only those up to it, as a run under that limit made them.
    """
    rows = attempts if max_attempts is None else attempts.where(F.col("attempt") <= max_attempts)
    first = F.min(F.when(F.col("success"), F.col("attempt")))
    return rows.groupBy("run_id").agg(
        first.alias("first_success"),
        F.coalesce(first, F.max("attempt")).alias("attempts"),
        F.coalesce(F.bool_or("success"), F.lit(False)).alias("verified"))


def failure_report(rollup: DataFrame, runs: DataFrame) -> DataFrame:
    """Report text for the runs never verified; ``runs`` has run_id, story and last spec.

    The compiler output section is empty, as a failed run keeps no log.
    """
    # The section headings of the report.
    text = F.concat(F.lit("USER STORY:\n"), F.col("story"), F.lit("\n\nDAFNY CODE:\n"),
                    F.col("spec"), F.lit("\n\nCOMPILER OUTPUT:\n\n"))
    return (rollup.where(~F.col("verified")).join(runs, "run_id")
            .select("run_id", "attempts", text.alias("report")))
