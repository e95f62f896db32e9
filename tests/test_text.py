import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as tx
from loomgraph.functions import vectors as vec
from loomgraph.sources import corpus

FEATURE = """Feature: Greenhouse watering

  Background:
    Given bed 4 holds 35 litres

  Scenario: A dry morning
    When the sensor of bed 4 reads 12 percent
    And nobody is at the pump
    Then the valve opens for 90 seconds
    And the log names bed 4

  Scenario: Rain in the night
    Given a forecast of 8 mm
    When the sensor of bed 4 reads 71 percent
    Then the valve stays shut
    But the lamp turns green

  Scenario: Rain again
    Given a forecast of 8 mm
    Then the valve stays shut"""


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column).first()[0]


def test_feature_lines_and_nodes(spark):
    files = spark.createDataFrame([("beds.feature", FEATURE)], corpus.FILES)
    parsed = corpus.parse_steps(files).collect()
    assert [(r.step_type, r.text) for r in parsed] == [
        ("Given", "bed 4 holds 35 litres"), ("When", "the sensor of bed 4 reads 12 percent"),
        ("Then", "the valve opens for 90 seconds"), ("Given", "a forecast of 8 mm"),
        ("When", "the sensor of bed 4 reads 71 percent"), ("Then", "the valve stays shut"),
        ("Given", "a forecast of 8 mm"), ("Then", "the valve stays shut")]
    nodes = corpus.step_nodes(corpus.parse_steps(files)).collect()
    assert len(nodes) == 6
    assert parsed[0].step_id.startswith("gherkin_step_") and len(parsed[0].step_id) == 25


def test_last_step_type_wins_per_text(spark):
    files = spark.createDataFrame([("a.feature", "Given x y\nThen x y")], corpus.FILES)
    nodes = corpus.step_nodes(corpus.parse_steps(files)).collect()
    assert [(n.step_type, n.text) for n in nodes] == [("Then", "x y")]


def test_step_text_keeps_unicode_line_separator(spark):
    files = spark.createDataFrame([("a.feature", "Given a\u2028b")], corpus.FILES)
    assert corpus.parse_steps(files).first().text == "a\u2028b"


def test_definitions(spark):
    ruby = ("Given(/^the balance is (\\d+)$/) do |b|\n  x\nend\n\n"
            "When(/^all done$/) do\n  y\nend\n")
    files = spark.createDataFrame(
        [("a.rb", ruby), ("stub.rb", "Given(/^a new action is executed$/) do end"),
         ("mix.rb", "Given(/^one line$/) do end\nWhen(/^b$/) do\n  z\nend\n")], corpus.FILES)
    found = {(r.file_name, r.pos): r for r in corpus.parse_definitions(files).collect()}
    assert set(found) == {("a.rb", 0), ("a.rb", 1), ("mix.rb", 0)}
    assert found["a.rb", 0].expression == "the balance is (\\d+)"
    assert found["a.rb", 1].code_block == "When(/^all done$/) do\n  y\nend"
    assert found["mix.rb", 0].swallowed and not found["a.rb", 0].swallowed


@pytest.mark.parametrize("name,title", [
    ("banking_02_deposit.txt", "Banking 02 Deposit"), ("2b_or_not.txt", "2B Or Not"),
    ("o'neil-x.txt", "O'Neil-X"), ("ALL_caps.txt", "All Caps")])
def test_title(spark, name, title):
    assert one(spark, tx.title_of(F.col("n")), n=name) == title == (
        name.replace(".txt", "").replace("_", " ").title())


@pytest.mark.parametrize("name,story", [
    ("Withdraw_atm.feature", "banking_01_withdrawal.txt"), ("my_ATM.feature", "banking_04_daily_limit.txt"),
    ("other.feature", None)])
def test_route(spark, name, story):
    assert one(spark, tx.route_feature(F.col("n")), n=name) == story


@pytest.mark.parametrize("text,clean", [
    (" $10 paid ", "10 paid"), ("$$10", "$$10"), ("is $10", "is $10"), ("$x", "$x")])
def test_normalise(spark, text, clean):
    assert one(spark, tx.normalise_step(F.col("t")), t=text) == clean


def test_widen_and_fence(spark):
    assert one(spark, tx.widen(F.col("e")), e=r"balance is (\d+)") == r"balance is (?:\$)?(\d+)"
    assert one(spark, tx.strip_fence(F.col("c")), c=" ```ruby\ncode\n```\n") == "code"
    assert one(spark, tx.strip_fence(F.col("c")), c="x ```ruby\ny") == "x ```ruby\ny"


@pytest.mark.parametrize("uri,call", [
    ("gs://b/c/abc_inputs.jsonl", "abc"), ("gs://b/c/abc.jsonl", "abc"), ("gs://b/c/abc.txt", None)])
def test_api_call_id(spark, uri, call):
    assert one(spark, tx.api_call_id(F.col("u")), u=uri) == call


@pytest.mark.parametrize("score,clamped", [(None, 0), (9, 5), (-2, 1), (3, 3)])
def test_clamp(spark, score, clamped):
    df = spark.createDataFrame([(score,)], "s int")
    assert df.select(tx.clamp_score(F.col("s"))).first()[0] == clamped


@pytest.mark.parametrize("a,b,cosine,drift", [
    ([1.0, 0.0], [1.0, 0.0], 1.0, 1.0), ([0.0, 0.0], [1.0, 0.0], 0.0, 0.0),
    ([1.0], [1.0, 0.0], 0.0, None), ([], [1.0], 0.0, None), (None, [1.0], None, None)])
def test_cosine(spark, a, b, cosine, drift):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    assert df.select(vec.cosine(F.col("a"), F.col("b")),
                     vec.drift_similarity(F.col("a"), F.col("b"))).first() == (cosine, drift)


@pytest.mark.parametrize("text,vector", [
    ("[0.5, 1]", [0.5, 1.0]), ("[0.5", None), ("[]", None), ("nope", None), (None, None)])
def test_decode(spark, text, vector):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(vec.decode_vec(F.col("t"))).first()[0] == vector


def test_corpus_scan(spark, tmp_path):
    (tmp_path / "a_b.txt").write_text("line one\nline two", encoding="utf-8")
    (tmp_path / "skip.md").write_text("no")
    rows = corpus.read_corpus(spark, str(tmp_path), "*.txt", required=True).collect()
    assert [tuple(r) for r in rows] == [("a_b.txt", "line one\nline two")]
    assert corpus.read_corpus(spark, str(tmp_path / "none"), "*.rb").count() == 0
    with pytest.raises(FileNotFoundError):
        corpus.read_corpus(spark, str(tmp_path / "none"), "*.txt", required=True)
