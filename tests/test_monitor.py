import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.operators import monitor as mon
from loomgraph.operators.scan import sliced
from loomgraph.streaming.monitor import monitor_stream, rocksdb

SCHEMA = "run_id bigint, seq bigint, agent_name string, response string, " \
         "story_vec array<double>, response_vec array<double>"


def plain_monitor(rows, loop_limit=3, max_calls=15, drift=0.45):
    """One run at a time, one action at a time."""
    out, runs = {}, {}
    for run, seq, agent, response, story, said in sorted(rows, key=lambda r: (r[0], r[1])):
        state = runs.setdefault(run, {"log": [], "open": False})
        if state["open"]:
            out[run, seq] = "rejected"
            continue
        state["log"].append((agent, response))
        own = [r for a, r in state["log"] if a == agent][-loop_limit:]
        trip = len(state["log"]) > max_calls or (len(own) == loop_limit and len(set(own)) == 1)
        if story and said and len(story) == len(said):
            dot = sum(x * y for x, y in zip(story, said))
            size = (sum(x * x for x in story) * sum(x * x for x in said)) ** 0.5
            trip = trip or (dot / size if size else 0.0) < drift
        state["open"] = trip
        out[run, seq] = "tripped" if trip else "accepted"
    return out


def statuses(df):
    return {(r.run_id, r.seq): r.status for r in df.collect()}


def test_loop_trips_on_the_third(spark):
    rows = [(1, i, "corrector", "same", None, None) for i in range(4)]
    report = {r.seq: r for r in mon.monitor(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [report[i].status for i in range(4)] == ["accepted", "accepted", "tripped", "rejected"]
    assert report[2].reason == ("Infinite loop detected: Agent 'corrector' generated identical outputs "
                                "3 times in a row.")
    assert report[3].reason == "Circuit Breaker is OPEN. Execution halted: " + report[2].reason


@pytest.mark.parametrize("said,status", [([0.9, 0.1, 0.0], "accepted"), ([0.1, 0.9, 0.0], "tripped"),
                                         ([0.1, 0.9], "accepted"), ([], "accepted"), ([0.0] * 3, "tripped")])
def test_drift(spark, said, status):
    df = spark.createDataFrame([(1, 1, "a", "x", [1.0, 0.0, 0.0], said)], SCHEMA)
    row = mon.monitor(df, drift=0.5).first()
    assert row.status == status
    if said == [0.1, 0.9, 0.0]:
        assert row.reason == ("Intent drift detected: Semantic similarity to original user story fell to "
                              "0.1104 (below threshold 0.5).")


def test_cap_trips_on_entry_sixteen(spark):
    rows = [(1, i * 10, f"agent{i}", str(i), None, None) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in mon.call_violations(df).collect()] == [(1, 150)]
    trip = mon.first_trips(df).first()
    assert (trip.trip_seq, trip.reason) == (150, "Total runtime agent calls exceeded safe limit of 15.")
    summary = mon.monitor_summary(mon.monitor(df)).first()
    assert (summary.logged, summary.rejected, summary.tripped) == (16, 4, True)


def test_a_hot_run_shrinks_before_the_shuffle(spark):
    df = spark.range(200_000).selectExpr(
        "if(id % 3 = 0, id, 0L) AS run_id", "id AS seq", "concat('agent', id % 2) AS agent_name",
        "cast(id % 97 AS string) AS response", "cast(null AS array<double>) AS story_vec",
        "cast(null AS array<double>) AS response_vec")
    trips = mon.first_trips(df)
    plan = trips._jdf.queryExecution().executedPlan().toString()
    first = plan.split("Exchange")[-1]      # what runs below the lowest shuffle
    assert "WindowGroupLimit" in first, plan
    assert [tuple(r) for r in trips.select("run_id", "trip_seq").collect()] == [(0, 22)]


ROWS = st.lists(st.tuples(st.integers(1, 3), st.sampled_from("ab"), st.sampled_from("xyz"),
                          st.sampled_from([None, [1.0, 0.0], [0.0, 1.0]])), max_size=40)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ROWS)
def test_batch_equals_plain_monitor(spark, actions):
    rows = [(run, i, agent, said, [1.0, 0.2], vec) for i, (run, agent, said, vec) in enumerate(actions)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert statuses(mon.monitor(df, max_calls=6)) == plain_monitor(rows, max_calls=6)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ROWS, st.integers(1, 4), st.integers(1, 7))
def test_slices_do_not_change_loops(spark, actions, limit, width):
    rows = [(run, i, agent, said, None, None) for i, (run, agent, said, _) in enumerate(actions)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole, cut = (sorted(map(tuple, mon.loop_flags(df, limit, w).collect())) for w in (None, width))
    assert whole == cut and len(whole) == len(rows)


def test_stream_over_batches_equals_batch(spark, tmp_path):
    rocksdb(spark)
    rows = [(i % 3, i, "ab"[(i // 3) % 2], "xyxx"[(i * i) % 4], [1.0, 0.0],
             [0.3, 1.0] if i % 31 == 30 else [1.0, 0.1]) for i in range(90)]
    for part in range(3):  # one file, one micro-batch each
        spark.createDataFrame(rows[part * 30:part * 30 + 30], SCHEMA).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    stream = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
              .parquet(str(tmp_path / "in")))
    (monitor_stream(stream, max_calls=12).writeStream.format("parquet").outputMode("append")
     .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
     .trigger(availableNow=True).start().awaitTermination())
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = mon.monitor(spark.createDataFrame(rows, SCHEMA), max_calls=12)
    assert statuses(got) == statuses(batch) == plain_monitor(rows, max_calls=12)
    reasons = batch.where("status = 'tripped'").select("run_id", "reason")
    assert sorted(map(tuple, got.where(F.col("reason").isNotNull()).select("run_id", "reason").collect())
                  ) == sorted(map(tuple, reasons.collect()))


def test_half_of_all_rows_in_one_run(spark):
    """The streaks of one long run are counted in many tasks, and equal the plain window."""
    rows = [(1, i * i, "a" if i % 50 else "b", None if i % 7 == 0 else "xyz"[(i // 5) % 3], None, None) for i in range(1000)]
    rows += [(2 + i % 100, i, "a", "same" if i % 3 else None, None, None) for i in range(1000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    cut = sliced(df, ["run_id", "agent_name"], ["seq"], parts=24)
    assert cut.where("run_id = 1").select("slice").distinct().count() >= 8
    for limit in (1, 3, 6):
        want = mon._loop_window(df, ["run_id", "agent_name"], limit)
        assert sorted(map(tuple, mon.loop_flags(df, limit).collect())) == sorted(map(tuple, want.collect()))


def test_vectors_are_joined_to_the_first_actions_only(spark):
    """The join with the vectors reads cap + 1 actions of a run, and no vector is shuffled to its run."""
    actions = spark.createDataFrame([(r, i, "a", str(i)) for r in range(3) for i in range(40)] + [(None, 1, "a", "x"), (1, None, "a", "y")],
                                    "run_id bigint, seq bigint, agent_name string, response string")
    vectors = spark.createDataFrame([(r, [1.0, 0.0]) for r in range(3)], "v bigint, story_vec array<double>")
    joined = actions.join(vectors.hint("merge"), F.expr("run_id % 3 = v")).withColumn("response_vec", F.col("story_vec"))
    trips = mon.first_trips(joined, max_calls=5)
    assert sorted((r.run_id, r.trip_seq) for r in trips.collect()) == [(0, 5), (1, 4), (2, 5)]
    plan = trips._sc._jvm.PythonSQLUtils.explainString(trips._jdf.queryExecution(), "formatted")
    shuffled = [node for node in plan.split("\n\n") if ") Exchange" in node and "run_id" in node]
    assert shuffled and not any("story_vec" in node for node in shuffled)
