import pytest
from pyspark.sql import functions as F

from loomgraph.functions.embedding import embed
from loomgraph.plans.features import feature_report
from loomgraph.plans.ingest import ingest, ingest_steps
from loomgraph.schema import BINDS, DEFINITION, DEPENDS_ON, IMPLEMENTS, STEP, STORY
from loomgraph.operators.graph import StoryGraph
from loomgraph.streaming.ingest import compact, read_base, read_graph, start_ingest, write_base

LINES = "story_id string, step_id string, step_type string, text string, ord int"


def small_embed(df, col):
    return embed(df, col, dims=16)


@pytest.fixture
def corpora(tmp_path):
    for name in ("stories", "defs", "features"):
        (tmp_path / name).mkdir()
    (tmp_path / "stories" / "banking_01_withdrawal.txt").write_text("As a customer I withdraw cash")
    (tmp_path / "stories" / "banking_02_deposit.txt").write_text("As a customer I deposit cash")
    (tmp_path / "defs" / "a.rb").write_text(
        "Given(/^the balance is (\\d+)$/) do |b|\n  x\nend\nThen(/^the balance$/) do\n  y\nend\n")
    (tmp_path / "features" / "Withdraw.feature").write_text(
        "Feature: x\n  Given the balance is 100\n  When see the balance is 5\n  And skipped\n")
    return tmp_path


def test_ingest(spark, corpora):
    seeds = spark.createDataFrame([("banking_02_deposit.txt", "spec")], "story_id string, verified_spec string")
    graph = ingest(spark, str(corpora / "stories"), str(corpora / "defs"), str(corpora / "features"),
                   seeds, embed_fn=small_embed)
    assert {r.label: r.n for r in graph.load_summary().collect()} == {
        "UserStory": 2, "GherkinStep": 2, "RubyDefinition": 2}
    assert {(r.title, r.verified_spec) for r in graph.stories.collect()} == {
        ("Banking 01 Withdrawal", None), ("Banking 02 Deposit", "spec")}
    assert {r.story_id for r in graph.implements.collect()} == {"banking_01_withdrawal.txt"}
    # the match must start with the text, and the first definition wins
    assert [(r.text, r.expression) for r in graph.match("BINDS").collect()] == [
        ("the balance is 100", "the balance is (\\d+)")]
    assert all(len(r.embedding) == 16 for r in graph.steps.collect())


def test_ingest_without_stories_stops(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        ingest(spark, str(tmp_path / "no"), str(tmp_path / "no"), str(tmp_path / "no"))


def empty_graph(spark, defs=()):
    rows = [(d, e, f"Given(/^{e}$/) do end", None) for d, e in defs]
    return StoryGraph(spark.createDataFrame([], STORY), spark.createDataFrame([], STEP),
                      spark.createDataFrame(rows, DEFINITION), spark.createDataFrame([], IMPLEMENTS),
                      spark.createDataFrame([], BINDS), spark.createDataFrame([], DEPENDS_ON))


def test_ingest_steps_keeps_vectors(spark):
    graph = empty_graph(spark, [("d", r"is \d+")]).with_tables(
        steps=spark.createDataFrame([("s1", "Given", "is 1", [1.0])], STEP))
    batch = spark.createDataFrame([("st", "s1", "Then", "is 1", 1), (None, "s2", "When", "none", 2)], LINES)
    grown = ingest_steps(graph, batch)
    assert {(r.step_id, r.step_type, tuple(r.embedding or ())) for r in grown.steps.collect()} == {
        ("s1", "Then", (1.0,)), ("s2", "When", ())}
    assert grown.binds.collect() == [("s1", "d")] and grown.implements.collect() == [("st", "s1")]


def test_stream_ingest_over_batches(spark, tmp_path):
    root = str(tmp_path / "graph")
    write_base(empty_graph(spark, [("d", r"is \d+")]).with_tables(
        steps=spark.createDataFrame([("s0", "Given", "is 0", [1.0])], STEP)), root)
    assert read_graph(spark, root).steps.count() == 1
    lines = LINES.replace("ord int", "ord bigint")
    for i in range(3):   # the last batch sets the type of s0, though its ord is the lowest
        spark.createDataFrame(
            [("st", f"s{i}", "Given", f"is {i}", i), ("st", "s0", ("Given", "When", "Then")[i], "is 0", -i)],
            lines).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = start_ingest(stream, root, str(tmp_path / "ck"))
    query.awaitTermination()
    assert len(list((tmp_path / "graph" / "changes" / "steps").glob("batch=*"))) == 3
    compact(spark, root, str(tmp_path / "next"))
    for graph in (read_graph(spark, root), read_base(spark, str(tmp_path / "next"))):
        assert {(r.step_id, r.step_type, tuple(r.embedding or ())) for r in graph.steps.collect()} == {
            ("s0", "Then", (1.0,)), ("s1", "Given", ()), ("s2", "Given", ())}
        assert graph.binds.count() == 3 and graph.implements.count() == 3


def test_feature_report(spark):
    graph = empty_graph(spark, [("d1", r"the balance is (\d+)"), ("d2", "never")]).with_tables(
        steps=spark.createDataFrame([("b1", "Given", "the balance is 1", [1.0, 0.0])], STEP),
        binds=spark.createDataFrame([("b1", "d1")], BINDS))
    lines = spark.createDataFrame(
        [("b1", "Given", "the balance is 1", [1.0, 0.0]), ("b2", "Then", "my balance", [0.9, 0.1]),
         ("b3", "When", "a new action", [0.0, 1.0])], STEP)
    report = feature_report(lines, graph)
    assert {r.step_id: r.action for r in report.resolved.collect()} == {
        "b1": "REUSE", "b2": "EXPAND", "b3": "GENERATE"}
    row = report.coverage.first()   # the generated step counts, the expanded one still has no match
    assert (row.matched, row.total, row.coverage_text) == (2, 3, "66.67%")
    assert [r.definition_id for r in report.pruned.collect()] == ["d2"]
    kept = {r.definition_id: r for r in report.graph.definitions.collect()}
    assert kept["d1"].expression == r"the balance is (?:\$)?(\d+)" and kept["d1"].expression in kept["d1"].code_block
    assert report.graph.binds.count() == 3


def test_embedding(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "alpha gamma")], "id int, t string")
    vectors = {r.id: r.embedding for r in embed(df, "t", dims=32).collect()}
    assert abs(sum(x * x for x in vectors[1]) - 1) < 1e-9 and sum(vectors[2]) == 0
    own = embed(df, "t", lambda texts: [None if t is None else [len(t)] for t in texts])
    assert [r.embedding for r in own.orderBy("id").collect()] == [[10.0], None, [11.0]]
    assert own.schema["embedding"].dataType.simpleString() == "array<double>"
