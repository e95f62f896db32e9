"""Registered queries over agent actions, events and attempts."""
from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.catalog.fixtures import load
from loomgraph.catalog.registry import query
from loomgraph.functions.vectors import drift_similarity
from loomgraph.operators import evals as ev
from loomgraph.operators import monitor as mon

# one day in units of seq (microseconds times 1000)
DAY = 86_400 * 1_000_000 * 1_000

_COS = "round(list_cosine_similarity(story_vec, response_vec), 12)"
# every action with its position, loop flag and drift, then the first violation per run
JUDGED = f"""
    WITH judged AS (
        SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS n,
               {_COS} AS sim,
               count(*) OVER last3 = 3 AND min(response) OVER last3 = max(response) OVER last3 AS looping
        FROM {{v_vec_action}} a
        WINDOW last3 AS (PARTITION BY run_id, agent_name ORDER BY seq
                         ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
    told AS (
        SELECT *, CASE WHEN n > 15 THEN 'Total runtime agent calls exceeded safe limit of 15.'
                       WHEN looping THEN concat('Infinite loop detected: Agent ''', agent_name,
                            ''' generated identical outputs 3 times in a row.')
                       WHEN sim < DRIFT THEN concat('Intent drift detected: Semantic similarity to ',
                            'original user story fell to ', printf('%.4f', sim),
                            ' (below threshold DRIFT).') END AS why
        FROM judged),
    first AS (SELECT run_id, min(seq) AS trip_seq, arg_min(why, seq) AS trip_why
              FROM told WHERE why IS NOT NULL GROUP BY run_id),
    report AS (
        SELECT t.run_id, t.seq, t.agent_name,
               CASE WHEN trip_seq IS NULL OR t.seq < trip_seq THEN 'accepted'
                    WHEN t.seq = trip_seq THEN 'tripped' ELSE 'rejected' END AS status, trip_why
        FROM told t LEFT JOIN first f USING (run_id))"""


def judged(drift: float) -> str:
    return JUDGED.replace("DRIFT", str(drift))


@query("monitor_calls", """
    SELECT run_id, seq FROM (
        SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS n
        FROM {v_action} a) t WHERE n = 16""")
def monitor_calls(spark, sf):
    return mon.call_violations(load(spark, sf, "v_action"))


_LOOPS = """
    SELECT run_id, agent_name, seq,
           count(*) OVER w = 3 AND min(response) OVER w = max(response) OVER w AS looping
    FROM {v_action} a
    WINDOW w AS (PARTITION BY run_id, agent_name ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""


@query("monitor_loops", _LOOPS)
def monitor_loops(spark, sf):
    """All actions, judged in day slices so that no run has to fit one task."""
    return mon.loop_flags(load(spark, sf, "v_action"), slice_width=DAY)


@query("monitor_loops_counted", _LOOPS)
def monitor_loops_counted(spark, sf):
    """All actions, judged by a scan over slices of equal numbers of rows."""
    return mon.loop_flags(load(spark, sf, "v_action"))


@query("monitor_drift", f"""
    SELECT run_id, seq, round({_COS}, 6) AS similarity, {_COS} < 0.45 AS drifting
    FROM {{v_vec_action}} a""")
def monitor_drift(spark, sf):
    rows = load(spark, sf, "v_vec_action").select(
        "run_id", "seq", drift_similarity(F.col("story_vec"), F.col("response_vec")).alias("s"))
    return rows.select("run_id", "seq", F.round("s", 6).alias("similarity"),
                       (F.col("s") < mon.DRIFT_THRESHOLD).alias("drifting"))


@query("monitor_report", judged(0.45) + """
    SELECT run_id, seq, agent_name, status,
           CASE status WHEN 'tripped' THEN trip_why
                WHEN 'rejected' THEN concat('Circuit Breaker is OPEN. Execution halted: ', trip_why)
           END AS reason FROM report""")
def monitor_report(spark, sf):
    report = mon.monitor(load(spark, sf, "v_vec_action"))
    return report.select("run_id", "seq", "agent_name", "status", "reason")


# a low drift threshold, so that loops and the call cap decide as well
@query("monitor_runs", judged(-0.2) + """
    SELECT run_id, count(*) FILTER (status <> 'rejected') AS logged,
           count(*) FILTER (status = 'rejected') AS rejected,
           bool_or(status = 'tripped') AS tripped,
           max(CASE WHEN status = 'tripped' THEN trip_why END) AS reason
    FROM report GROUP BY run_id""")
def monitor_runs(spark, sf):
    return mon.monitor_summary(mon.monitor(load(spark, sf, "v_vec_action"), drift=-0.2))


@query("last_complete_event", """
    SELECT run_id, seq, CASE WHEN has_key THEN state_value ELSE output END AS value
    FROM {v_event} e WHERE author = 'assistant' AND NOT partial AND (has_key OR output IS NOT NULL)
    QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) = 1""")
def last_complete_event(spark, sf):
    events = load(spark, sf, "v_event")
    state = F.when(F.col("has_key"), F.create_map(F.lit("spec"), F.col("state_value"))).otherwise(
        F.create_map(F.lit("other"), F.lit("x")))
    return ev.last_complete(events.withColumn("state_delta", state)
                            .withColumn("state_key", F.lit("spec")), "assistant")


_ROLLUP = """
    SELECT run_id, min(attempt) FILTER (success) AS first_success,
           coalesce(min(attempt) FILTER (success), max(attempt)) AS attempts,
           bool_or(success) AS verified
    FROM {v_attempt} a WHERE attempt <= 5 GROUP BY run_id"""


_ROLLUP_ALL = _ROLLUP.replace("WHERE attempt <= 5 ", "")


def _attempts(spark, sf, max_attempts=None):
    rows = load(spark, sf, "v_attempt")
    return ev.attempt_rollup(rows.withColumn("attempt", F.col("attempt").cast("bigint")), max_attempts)


def _runs(spark, sf):
    return load(spark, sf, "customer").select(
        F.col("c_custkey").alias("run_id"), F.col("c_name").alias("story"), F.col("c_mktsegment").alias("spec"))


@query("attempt_rollup", _ROLLUP)
def attempt_rollup(spark, sf):
    """Runs under the limit of five attempts."""
    return _attempts(spark, sf, max_attempts=ev.MAX_ATTEMPTS)


@query("attempt_rollup_all", _ROLLUP_ALL)
def attempt_rollup_all(spark, sf):
    return _attempts(spark, sf)


_REPORT = """
    SELECT run_id, attempts, concat('USER STORY:', chr(10), c_name, chr(10), chr(10), 'DAFNY CODE:',
           chr(10), c_mktsegment, chr(10), chr(10), 'COMPILER OUTPUT:', chr(10), chr(10)) AS report
    FROM (ROLLUP) r JOIN {customer} c ON c.c_custkey = r.run_id WHERE NOT verified"""


@query("failure_report", _REPORT.replace("ROLLUP", _ROLLUP))
def failure_report(spark, sf):
    return ev.failure_report(_attempts(spark, sf, max_attempts=ev.MAX_ATTEMPTS), _runs(spark, sf))


@query("failure_report_all", _REPORT.replace("ROLLUP", _ROLLUP_ALL))
def failure_report_all(spark, sf):
    return ev.failure_report(_attempts(spark, sf), _runs(spark, sf))
