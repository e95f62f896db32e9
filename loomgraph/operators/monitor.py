"""Behaviour monitor over action tables: call cap, loops, drift, circuit breaker.

A run is an ordered list of actions.  The first violation trips the run's breaker; that action is
still logged, every later one is rejected.  With a call cap the breaker trips at action cap + 1 at
the latest, so only the first cap + 1 actions of a run can decide anything: a group limit finds the last
of them by its keys, and vectors are compared for those actions only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.vectors import drift_similarity
from loomgraph.operators.scan import running, sliced
from loomgraph.session import materialize

# Default limits and the wording of the reasons.
LOOP_LIMIT, MAX_CALLS, DRIFT_THRESHOLD = 3, 15, 0.45
CALLS_REASON = "Total runtime agent calls exceeded safe limit of %d."
LOOP_REASON = "Infinite loop detected: Agent '%s' generated identical outputs %d times in a row."
DRIFT_REASON = ("Intent drift detected: Semantic similarity to original user story fell to %s "
                "(below threshold %s).")
OPEN_REASON = "Circuit Breaker is OPEN. Execution halted: %s"


def _has(df: DataFrame, *cols: str) -> bool:
    return set(cols) <= set(df.columns)


def drift_column(df: DataFrame) -> Column:
    if _has(df, "story_vec", "response_vec"):
        return drift_similarity(F.col("story_vec"), F.col("response_vec"))
    return F.lit(None).cast("double")


def call_violations(actions: DataFrame, max_calls: int = MAX_CALLS) -> DataFrame:
    """(run_id, seq) of the action that exceeds the cap, for the runs that do."""
    order = Window.partitionBy("run_id").orderBy("seq")
    return (actions.select("run_id", "seq").withColumn("_n", F.row_number().over(order))
            .where(F.col("_n") <= max_calls + 1).where(F.col("_n") == max_calls + 1)
            .select("run_id", "seq"))


def loop_flags(actions: DataFrame, loop_limit: int = LOOP_LIMIT,
               slice_width: int | None = None) -> DataFrame:
    """Every (run_id, agent_name, seq) with ``looping``: the agent's last N responses are equal.

    Streaks of equal responses are counted by a scan over slices of equal numbers of rows, so a run of
    any length is spread over many tasks, whatever its ``seq`` values.  With ``slice_width`` each run is cut
    into slices of that many ``seq`` units instead, and nothing is stored.  Such a slice needs the N-1 actions of the same agent before it: the last
    N-1 rows of every slice are handed to the slices they reach into.
    """
    cols = ["run_id", "agent_name", "seq", "response"]
    if slice_width is None:
        return _loop_scan(actions.select(*cols), loop_limit)
    group = ["run_id", "agent_name"]
    cut = actions.select(*cols, F.floor(F.col("seq") / slice_width).alias("_slice"))
    if loop_limit == 1:
        return _loop_window(cut, group + ["_slice"], 1)
    back = Window.partitionBy(*group, "_slice").orderBy(F.desc("seq"))
    tails = (cut.withColumn("_back", F.row_number().over(back))
             .where(F.col("_back") < loop_limit).drop("_back"))
    ahead = Window.partitionBy(*group).orderBy("seq")
    reach = F.array_distinct(F.array(*[F.lead("_slice", i).over(ahead)
                                       for i in range(1, loop_limit)]))
    carried = (tails.withColumn("_reach", reach)
               .withColumn("_to", F.explode("_reach"))
               .where(F.col("_to") != F.col("_slice"))
               .select(*cols, F.col("_to").alias("_slice"), F.lit(True).alias("_carried")))
    both = cut.withColumn("_carried", F.lit(False)).unionByName(carried)
    return _loop_window(both, group + ["_slice"], loop_limit, keep=~F.col("_carried"))


def _loop_scan(actions: DataFrame, n: int) -> DataFrame:
    """How long the streak of equal responses is at each action: its place less that of the last change."""
    group, order = ["run_id", "agent_name"], ["seq"]
    # a missing response equals another missing one
    said = F.struct(F.coalesce("response", F.lit("")), F.col("response").isNull())
    placed = running(sliced(actions, group, order, "actions"), group, order,
                     {"_place": ("sum", F.lit(1)), "_before": ("prev", said)})
    change = F.when(F.col("_before").isNull() | (F.col("_before") != said), F.col("_place"))
    changes = materialize(placed.withColumn("_change", change).drop("response", "_before"), "streaks")
    last = running(changes, group, order, {"_from": ("max", F.col("_change"))})
    return last.select("run_id", "agent_name", "seq", (F.col("_place") - F.col("_from") >= n - 1).alias("looping"))


def _loop_window(df: DataFrame, keys: list[str], n: int, keep: Column | None = None) -> DataFrame:
    frame = Window.partitionBy(*keys).orderBy("seq").rowsBetween(-(n - 1), 0)
    # a missing response equals another missing one
    said = F.struct(F.coalesce("response", F.lit("")), F.col("response").isNull())
    same = ((F.count(F.lit(1)).over(frame) == n)
            & (F.min(said).over(frame) == F.max(said).over(frame)))
    flagged = df.withColumn("looping", same)
    if keep is not None:
        flagged = flagged.where(keep)
    return flagged.select("run_id", "agent_name", "seq", "looping")


def first_trips(actions: DataFrame, loop_limit: int = LOOP_LIMIT, max_calls: int = MAX_CALLS,
                drift: float = DRIFT_THRESHOLD) -> DataFrame:
    """(run_id, trip_seq, reason) of the first violation per run; checks go calls, loop, drift."""
    run = Window.partitionBy("run_id").orderBy("seq")
    keep = [c for c in ("run_id", "seq", "agent_name", "response", "story_vec", "response_vec")
            if c in actions.columns]
    # what comes after action cap + 1 is left out by keys only, before any vector is joined to it or moved
    last = call_violations(actions, max_calls).select(F.col("run_id").alias("_run"), F.col("seq").alias("_last"))
    after = F.coalesce(F.col("seq") > F.col("_last"), F.col("_last").isNull() & F.col("seq").isNotNull())
    near = actions.select(*keep).join(last, F.col("run_id").eqNullSafe(F.col("_run")) & after, "left_anti")
    near = near.withColumn("_sim", drift_column(near)).drop("story_vec", "response_vec")
    head = near.withColumn("_n", F.row_number().over(run)).where(F.col("_n") <= max_calls + 1)
    # at most max_calls + 1 rows per run from here on
    agent = Window.partitionBy("run_id", "agent_name").orderBy("seq").rowsBetween(
        -(loop_limit - 1), 0)
    said = F.struct(F.coalesce("response", F.lit("")), F.col("response").isNull())
    judged = (head.withColumn("_loop", (F.count(F.lit(1)).over(agent) == loop_limit)
                          & (F.min(said).over(agent) == F.max(said).over(agent))))
    reason = (F.when(F.col("_n") > max_calls, F.lit(CALLS_REASON % max_calls))
              .when(F.col("_loop"), F.format_string(LOOP_REASON, "agent_name", F.lit(loop_limit)))
              .when(F.col("_sim") < drift,
                    F.format_string(DRIFT_REASON, F.format_string("%.4f", "_sim"),
                                    F.lit(str(drift)))))
    return (judged.select("run_id", "seq", reason.alias("reason")).where("reason IS NOT NULL")
            .groupBy("run_id").agg(F.min_by(F.struct("seq", "reason"), "seq").alias("t"))
            .select("run_id", F.col("t.seq").alias("trip_seq"), F.col("t.reason").alias("reason")))


def monitor(actions: DataFrame, loop_limit: int = LOOP_LIMIT, max_calls: int = MAX_CALLS,
            drift: float = DRIFT_THRESHOLD) -> DataFrame:
    """Actions with ``status`` (accepted, tripped, rejected) and ``reason``."""
    trips = first_trips(actions, loop_limit, max_calls, drift)
    seq, trip = F.col("seq"), F.col("trip_seq")
    status = (F.when(trip.isNull() | (seq < trip), F.lit("accepted"))
              .when(seq == trip, F.lit("tripped")).otherwise(F.lit("rejected")))
    told = (F.when(F.col("status") == "tripped", F.col("reason"))
            .when(F.col("status") == "rejected", F.format_string(OPEN_REASON, "reason")))
    return (actions.join(trips, "run_id", "left").withColumn("status", status)
            .withColumn("reason", told).drop("trip_seq"))


def monitor_summary(report: DataFrame) -> DataFrame:
    """Per run: logged and rejected actions, breaker state, reason."""
    return report.groupBy("run_id").agg(
        F.count_if(F.col("status") != "rejected").alias("logged"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.bool_or(F.col("status") == "tripped").alias("tripped"),
        F.max(F.when(F.col("status") == "tripped", F.col("reason"))).alias("reason"))
