import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import evals as ev
from loomgraph.operators import routing
from loomgraph.plans.completions import completions_view, log_refs, token_rollup, unpivot_refs
from loomgraph.schema import COMPLETION, LOG
from loomgraph.sources import telemetry as source

LABELS = ("gen_ai_conversation_id gen_ai_agent_name gen_ai_input_messages_ref "
          "gen_ai_output_messages_ref gen_ai_usage_input_tokens").split()


def log(insert_id, second, trace, conv="c1", inp=None, out=None, name="calls"):
    stamp = datetime.fromtimestamp(1_700_000_000 + second, timezone.utc)
    labels = {"gen_ai_conversation_id": conv, "gen_ai_input_messages_ref": inp,
              "gen_ai_output_messages_ref": out, "gen_ai_usage_input_tokens": "7",
              "gen_ai_usage_output_tokens": "bad"}
    return {"insertId": insert_id, "timestamp": stamp, "trace": trace, "spanId": "s" + trace,
            "labels": labels, "logName": name}


def line(uri, role, index, *texts):
    return {"file_uri": uri, "role": role, "index": index,
            "parts": None if texts == (None,) else [{"type": "text", "content": t} for t in texts]}


def frames(spark, logs, lines):
    return (spark.createDataFrame(logs, LOG),
            spark.createDataFrame(lines, COMPLETION + ", file_uri string"))


def test_view_rules(spark):
    logs, lines = frames(spark, [
        log("i1", 0, "t1", inp="g/a_in.jsonl", out="g/a_out.jsonl"),
        log("i1x", 5, "t1", inp="g/a_in.jsonl", out="g/a_out.jsonl"),    # same span, newer copy
        log("i2", 10, "t2", inp="g/b_in.jsonl", out="g/b_out.jsonl"),    # repeats the history
        log("i3", 20, "t3"),                                             # no references at all
    ], [
        line("g/a_in.jsonl", "user", 0, "hello", "world"), line("g/a_in.jsonl", None, 1, "no role"),
        line("g/a_in.jsonl", "system", 2, None),                         # no parts
        line("g/a_out.jsonl", "assistant", 0, "hi"),
        line("g/b_in.jsonl", "user", 0, "hello", "world"), line("g/b_in.jsonl", "assistant", 1, "hi"),
        line("g/b_out.jsonl", "assistant", 0, "again"),
    ])
    view = completions_view(logs, lines)
    rows = [(r.insert_id, r.message_type, r.role, r.part_idx, r.content, r.api_call_id)
            for r in view.collect()]
    assert rows == [
        ("i1x", "input", "user", 0, "hello", "a"), ("i1x", "input", "user", 1, "world", "a"),
        ("i1x", "output", "assistant", 0, "hi", "a"), ("i2", "output", "assistant", 0, "again", "b")]
    rollup = token_rollup(view).collect()
    assert [(r.calls, r.input_tokens, r.output_tokens) for r in rollup] == [(2, 14, None)]
    refs = unpivot_refs(log_refs(logs))
    assert refs.count() == 6


def test_rows_without_conversation_keep_their_outputs(spark):
    logs, lines = frames(
        spark, [log(f"i{i}", i, f"t{i}", conv=None, out="g/x_out.jsonl", inp="g/x_in.jsonl")
                for i in range(20)],
        [line("g/x_out.jsonl", "assistant", 0, "same"), line("g/x_in.jsonl", "user", 0, "ask")])
    kinds = [r.message_type for r in completions_view(logs, lines).collect()]
    assert kinds.count("output") == 20 and kinds.count("input") == 1


def test_view_plan(spark):
    logs, lines = frames(spark, [log("i", 0, "t", inp="a", out="b")], [line("a", "user", 0, "x")])
    plan = completions_view(logs, lines, ordered=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4, plan    # both steps, before and after the shuffle
    assert "Union" not in plan                          # the log is scanned once
    wide = [p for p in plan.split("\n") if "Exchange hash" in p and "_line" in p]
    assert len(wide) <= 2, plan                         # content meets the keys; no shuffle after it


def test_doubled_file_lines_give_one_row(spark):
    logs, lines = frames(spark, [log("i", 0, "t", out="g/a_out.jsonl")],
                         [line("g/a_out.jsonl", None, None, "one", "more"),
                          line("g/a_out.jsonl", None, None, "two")])
    rows = [(r.part_idx, r.content) for r in completions_view(logs, lines).collect()]
    assert rows == [(0, "one"), (1, "more")]


def test_completion_files(spark, tmp_path):
    good = json.dumps({"role": "user", "index": 1, "parts": [{"type": "text", "content": "a"}], "x": 1})
    (tmp_path / "one.jsonl").write_text(good + "\n{broken\n")
    (tmp_path / "two.jsonl").write_text(good + "\n")
    rows, seen = source.scan_completions(spark, str(tmp_path))
    got = rows.collect()
    assert {r.file_uri.rsplit("/", 1)[1] for r in got} == {"one.jsonl", "two.jsonl"}
    assert "x" not in rows.columns and [r.parts[0].content for r in got] == ["a", "a"]
    assert source.enforce_bad_limit(seen) == 1
    assert source.read_completions(spark, str(tmp_path), max_bad=1).count() == 2
    with pytest.raises(ValueError):
        source.read_completions(spark, str(tmp_path), max_bad=0)


def test_view_joins_on_the_file_name(spark, tmp_path):
    (tmp_path / "abc_out.jsonl").write_text(json.dumps(
        {"role": "assistant", "index": 0, "parts": [{"type": "text", "content": "a"}]}) + "\n")
    rows, _ = source.scan_completions(spark, str(tmp_path))
    uri = rows.first().file_uri
    logs = spark.createDataFrame([log("i", 0, "t", out=uri)], LOG)
    assert [r.api_call_id for r in completions_view(logs, rows).collect()] == ["abc"]


def test_log_table_days(spark, tmp_path):
    path = str(tmp_path / "logs")
    source.write_logs(spark.createDataFrame([log("a", 0, "t"), log("b", 86_400, "t")], LOG), path)
    grown = spark.createDataFrame([log("c", 86_400, "t")], LOG).withColumn("fresh", F.lit(1))
    source.write_logs(grown, path)
    assert {r.insertId for r in source.read_logs(spark, path).collect()} == {"a", "b", "c"}
    assert "fresh" in source.read_logs(spark, path).columns
    for merge in (True, False):
        days = source.read_logs(spark, path, since="2023-11-15", merge_schema=merge)
        assert {r.insertId for r in days.collect()} == {"b", "c"}


def test_routing(spark):
    logs = spark.createDataFrame([log("a", 0, "t", inp="x/app/1"), log("b", 0, "t", out="x/app/2"),
                                  log("c", 0, "t", inp="x/other"), log("d", 0, "t", inp="x/app", name="z")], LOG)
    assert {r.insertId for r in routing.route_logs(logs, "calls", ".*app.*").collect()} == {"a", "b"}
    tagged = spark.createDataFrame([(("app", "agent"),), (("app", "web"),)],
                                   "labels struct<service_name: string, type: string>")
    assert routing.route_telemetry(tagged, "app", "agent").count() == 1


def test_feedback(spark):
    def record(**payload):
        return (datetime(2024, 1, 1), json.dumps(payload))
    rows = [record(score=4, log_type="feedback", service_name="app", text="ok", user_id="u"),
            record(score="x", log_type="feedback", service_name="app"),
            record(score=2.5, log_type="feedback", service_name="app"),
            record(score=1, log_type="feedback", service_name="other"), record(score=1)]
    df = spark.createDataFrame(rows, "timestamp timestamp, payload string")
    out = {r.score: r for r in routing.normalise_feedback(routing.route_feedback(df, "app"), "app").collect()}
    assert set(out) == {4.0, 2.5}
    assert out[4.0].user_id == "u" and out[2.5].text == "" and len(out[2.5].session_id) == 36


CASES = [
    ("eval_infinite_loop", {"circuit_breaker_tripped": True, "reason_contains": "Infinite loop"}),
    ("eval_intent_drift", {"circuit_breaker_tripped": True, "reason_contains": "Intent drift"}),
    ("eval_quorum_rejection", {"is_approved": False, "reason_contains": "unsafe patterns"}),
    ("eval_step_reuse", {"reused": True}), ("eval_step_generate", {"reused": False, "scaffolded": True}),
    ("unknown_case", {"reused": True}),
]


def test_eval_cases(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps(
        [{"case_id": c, "component": "x", "description": "d", "input": {}, "expected": e} for c, e in CASES]))
    cases = ev.read_eval_cases(spark, str(tmp_path / "cases.json"))
    assert cases.count() == 6
    results = spark.createDataFrame(
        [("eval_infinite_loop", True, "Infinite loop detected: x"), ("eval_intent_drift", True, None),
         ("eval_quorum_rejection", True, "Change REJECTED"), ("eval_step_reuse", True, None),
         ("eval_step_generate", None, None), ("unknown_case", True, "")],
        "case_id string, actual boolean, reason string")
    graded = ev.grade(cases, results)
    assert {r.case_id: r.passed for r in graded.collect()} == {
        "eval_infinite_loop": True, "eval_intent_drift": False, "eval_quorum_rejection": True,
        "eval_step_reuse": True, "eval_step_generate": False}
    assert ev.scorecard(graded).collect() == [(3, 5, False)]
    assert ev.scorecard(graded.where("passed")).collect() == [(3, 3, True)]


def test_eval_dataset_shapes(spark, tmp_path):
    def said(text, role="user"):
        return {"role": role, "parts": [{"text": text}]}
    (tmp_path / "set.json").write_text(json.dumps({"eval_cases": [
        {"eval_case_id": "one", "prompt": said("hi"), "reference": {"response": said("yes", "model")}},
        {"eval_case_id": "two", "agent_data": {"turns": [
            {"turn_index": 0, "events": [{"author": "user", "content": said("first")}]},
            {"turn_index": 1, "events": [{"author": "bot", "content": said("second", "model")}]}]}}]}))
    rows = {r.eval_case_id: r for r in ev.read_eval_dataset(spark, str(tmp_path / "set.json")).collect()}
    assert (rows["one"].prompt, rows["one"].reference, rows["one"].turns) == ("hi", "yes", 0)
    assert (rows["two"].prompt, rows["two"].reference, rows["two"].turns) == ("first", None, 2)


def test_last_complete_prefers_a_present_null(spark):
    rows = [(1, 1, "a", False, {"k": "old"}, "k", None), (1, 2, "a", False, {"k": None}, "k", "out"),
            (1, 3, "a", True, {"k": "partial"}, "k", None), (1, 4, "b", False, {"k": "other"}, "k", None),
            (2, 1, "a", False, {"z": "z"}, "k", "plain"), (2, 2, "a", False, None, "k", None)]
    df = spark.createDataFrame(rows, "run_id int, seq int, author string, partial boolean, "
                                     "state_delta map<string,string>, state_key string, output string")
    assert {tuple(r) for r in ev.last_complete(df, "a").collect()} == {(1, 2, None), (2, 1, "plain")}


def test_attempts(spark):
    df = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 5, False), (2, 6, True)],
                               "run_id int, attempt int, success boolean")
    rows = {r.run_id: (r.first_success, r.attempts, r.verified) for r in ev.attempt_rollup(df, max_attempts=5).collect()}
    assert rows == {1: (2, 2, True), 2: (None, 5, False)}
    runs = spark.createDataFrame([(2, "story", "spec")], "run_id int, story string, spec string")
    report = ev.failure_report(ev.attempt_rollup(df, max_attempts=5), runs).first().report
    assert report == "USER STORY:\nstory\n\nDAFNY CODE:\nspec\n\nCOMPILER OUTPUT:\n\n"
    # without a limit every attempt counts
    assert {r.run_id: (r.first_success, r.attempts, r.verified) for r in ev.attempt_rollup(df).collect()} == {
        1: (2, 2, True), 2: (6, 6, True)}
    assert ev.failure_report(ev.attempt_rollup(df), runs).collect() == []
