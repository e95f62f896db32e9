"""Registered queries over eval cases, scores and metrics."""
from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.catalog.fixtures import load, run
from loomgraph.catalog.registry import query
from loomgraph.functions.text import clamp_score, unsafe_flag
from loomgraph.operators import evals as ev
from loomgraph.session import shared_path, spread

WORDS = ("token", "password", "secret")

_GRADED = """
    SELECT case_id, quality, CASE WHEN quality = 1 THEN 'aba_monitor' ELSE 'step_definition_manager' END
               AS component,
           CASE WHEN quality = 1 THEN actual = expected AND contains(text, 'the')
                ELSE actual = expected END AS passed
    FROM (SELECT *, regexp_matches(lower(text), 'token|password|secret') AS actual FROM {v_eval} e) x"""


def _graded(spark, sf):
    rows = load(spark, sf, "v_eval")
    loop = F.col("quality") == 1
    none = F.lit(None).cast("boolean")
    cases = rows.select(
        "case_id",
        F.when(loop, F.lit("aba_monitor")).otherwise(F.lit("step_definition_manager")).alias("component"),
        F.when(loop, F.lit("eval_infinite_loop")).otherwise(F.lit("eval_step_reuse")).alias("rule"),
        F.struct(F.when(loop, F.col("expected")).alias("circuit_breaker_tripped"),
                 F.when(loop, F.lit("the")).alias("reason_contains"), none.alias("is_approved"),
                 F.when(~loop, F.col("expected")).alias("reused"),
                 none.alias("scaffolded")).alias("expected"))
    results = rows.select("case_id", unsafe_flag(F.col("text"), WORDS).alias("actual"),
                          F.col("text").alias("reason"))
    return ev.grade(cases, results, by="rule")


@query("eval_grades", f"SELECT case_id, component, passed FROM ({_GRADED}) g")
def eval_grades(spark, sf):
    return _graded(spark, sf).select("case_id", "component", "passed")


@query("eval_scorecard", f"""
    SELECT component, count(*) FILTER (passed) AS passed, count(*) AS total,
           bool_and(passed) AS all_passed FROM ({_GRADED}) g GROUP BY component""")
def eval_scorecard(spark, sf):
    return ev.scorecard(_graded(spark, sf), ["component"])


# four rubric scores per labelled document, some out of range, some without a verdict
_RUBRIC = """
    SELECT CAST(doc_id AS STRING) AS artifact_id, 'correctness' AS dimension,
           CAST(quality * 4 + 1 AS BIGINT) AS score FROM {labels} a
    UNION ALL SELECT CAST(doc_id AS STRING), 'completeness', doc_id % 8 FROM {labels} b
    UNION ALL SELECT CAST(doc_id AS STRING), 'safety', CAST(5 - 4 * toxic AS BIGINT) FROM {labels} c
    UNION ALL SELECT CAST(doc_id AS STRING), 'maintainability',
                     CASE WHEN doc_id % 9 <> 0 THEN doc_id % 5 + 1 END FROM {labels} d"""
_CLAMPED = f"""
    SELECT artifact_id, dimension, CAST(CASE WHEN score IS NULL THEN 0
           ELSE greatest(1, least(5, score)) END AS BIGINT) AS score FROM ({_RUBRIC}) r"""


@query("rubric_summary", f"""
    SELECT dimension, count(score) AS n, avg(score) AS avg_score, min(score) AS min_score,
           max(score) AS max_score FROM ({_CLAMPED}) c GROUP BY dimension""")
def rubric_summary(spark, sf):
    return ev.rubric_summary(ev.judged_scores(run(spark, sf, _RUBRIC)))


@query("rubric_wide", f"""
    SELECT artifact_id, max(score) FILTER (dimension = 'correctness') AS correctness,
           max(score) FILTER (dimension = 'completeness') AS completeness,
           max(score) FILTER (dimension = 'safety') AS safety,
           max(score) FILTER (dimension = 'maintainability') AS maintainability
    FROM ({_CLAMPED}) c GROUP BY artifact_id""")
def rubric_wide(spark, sf):
    return ev.rubric_wide(ev.judged_scores(run(spark, sf, _RUBRIC)),
                          ["correctness", "completeness", "safety", "maintainability"])


@query("score_clamp", """
    SELECT s_suppkey, CAST(CASE WHEN s_nationkey = 7 THEN 0
           ELSE greatest(1, least(5, CAST(floor(s_acctbal / 1000) AS BIGINT))) END AS BIGINT) AS score
    FROM {supplier} s""")
def score_clamp(spark, sf):
    raw = F.when(F.col("s_nationkey") != 7, F.floor(F.col("s_acctbal") / 1000))
    return load(spark, sf, "supplier").select("s_suppkey", clamp_score(raw).alias("score"))


@query("turn_count", """
    SELECT d.doc_id AS case_id, count(c.conv_id) AS turns
    FROM {documents} d LEFT JOIN {conversations} c ON c.conv_id = d.doc_id GROUP BY d.doc_id""")
def turn_count(spark, sf):
    """Turns per case; a case without any scores 0."""
    turns = load(spark, sf, "conversations").withColumnRenamed("conv_id", "case_id")
    cases = load(spark, sf, "documents").select(F.col("doc_id").alias("case_id"))
    return ev.agent_turn_count(turns, cases)


@query("metric_registry", """
    SELECT doc_id AS case_id, 'chars' AS metric, CAST(n_chars AS DOUBLE) AS score FROM {documents} a
    UNION ALL SELECT doc_id, 'unsafe',
        CASE WHEN regexp_matches(lower(text), 'token|password|secret') THEN 1.0 ELSE 0.0 END
        FROM {documents} b
    UNION ALL SELECT doc_id, 'lines', CAST(len(string_split(text, chr(10))) AS DOUBLE)
        FROM {documents} c""")
def metric_registry(spark, sf):
    """Two Column metrics and a Python one over the same instances."""
    docs = spread(load(spark, sf, "documents")).select(F.col("doc_id").alias("case_id"), "text", "n_chars")
    metrics = (ev.MetricRegistry()
               .add("chars", F.col("n_chars"))
               .add("unsafe", unsafe_flag(F.col("text"), WORDS).cast("int"))
               .add_python("lines", lambda pdf: [t.count("\n") + 1 for t in pdf["text"]]))
    return metrics.run(docs)


@query("eval_dataset_source", """
    SELECT concat('b', item_id) AS eval_case_id, text AS prompt, text AS reference, 0 AS turns
    FROM {benchmark} a
    UNION ALL
    SELECT concat('c', conv_id, '_', turn), CASE WHEN role = 'user' THEN text END, NULL, turn + 1
    FROM {conversations} b""")
def eval_dataset_source(spark, sf):
    """Datasets with both case shapes, written as JSON and read back."""
    def said(name: str, who):
        return F.struct(who.alias("role"), F.array(F.struct(F.col(name).alias("text"))).alias("parts"))
    item = load(spark, sf, "benchmark").select(F.array(F.struct(
        F.concat(F.lit("b"), "item_id").alias("eval_case_id"),
        said("text", F.lit("user")).alias("prompt"),
        F.struct(said("text", F.lit("model")).alias("response")).alias("reference")
    )).alias("eval_cases"))
    event = F.struct(F.col("role").alias("author"), said("text", F.col("role")).alias("content"))
    turn = F.struct(F.col("turn").alias("turn_index"), F.array(event).alias("events"))
    talk = load(spark, sf, "conversations").select(F.array(F.struct(
        F.concat(F.lit("c"), "conv_id", F.lit("_"), "turn").alias("eval_case_id"),
        F.struct(F.array_repeat(turn, (F.col("turn") + 1).cast("int")).alias("turns")).alias("agent_data")
    )).alias("eval_cases"))
    path = shared_path(spark, "eval_sets")
    for name, rows in (("items", item), ("talks", talk)):
        rows.select(F.to_json(F.struct("eval_cases")).alias("value")).write.text(f"{path}/{name}")
    sets = ev.read_eval_dataset(spark, f"{path}/*", multi_line=False)
    return sets.select("eval_case_id", "prompt", "reference", "turns")


@query("eval_case_source", """
    SELECT CAST(case_id AS VARCHAR) AS case_id, 'aba_monitor' AS component, text AS description,
           expected AS circuit_breaker_tripped FROM {v_eval} e""")
def eval_case_source(spark, sf):
    rows = load(spark, sf, "v_eval").select(F.to_json(F.struct(
        "case_id", F.lit("aba_monitor").alias("component"), F.col("text").alias("description"),
        F.struct(F.col("expected").alias("circuit_breaker_tripped")).alias("expected"))).alias("value"))
    path = shared_path(spark, "eval_cases")
    rows.write.text(path)
    cases = ev.read_eval_cases(spark, path, multi_line=False)
    return cases.select("case_id", "component", "description", "expected.circuit_breaker_tripped")
