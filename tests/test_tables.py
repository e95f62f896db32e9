import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.operators import graph, tables as t
from loomgraph.operators.graph import SeenPairs, StoryGraph, impact_context, impact_map
from loomgraph.schema import BINDS, DEFINITION, DEPENDS_ON, IMPLEMENTS, STEP, STORY

slow = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def stories(spark, ids):
    return spark.createDataFrame([(i, f"title {i}", None, None, None) for i in ids], STORY)


def edges(spark, pairs):
    return spark.createDataFrame(pairs, DEPENDS_ON)


def targets(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "story_id string")


def reached(df):
    return {(r.target, r.story_id): r.depth for r in df.collect()}


def test_upsert_modes(spark):
    old = spark.createDataFrame([("a", "A", "s"), ("b", "B", "t")], "id string, title string, spec string")
    new = spark.createDataFrame([("a", "A1", 1), ("a", "A2", 2), ("c", None, 3)],
                                "id string, title string, seq int")
    merged = {r.id: tuple(r) for r in t.upsert(old, new, ["id"], "seq").collect()}
    assert merged == {"a": ("a", "A2", "s"), "b": ("b", "B", "t"), "c": ("c", None, None)}
    replaced = {r.id: tuple(r) for r in t.upsert(old, new, ["id"], "seq", "replace").collect()}
    assert replaced["a"] == ("a", "A2", None) and replaced["b"] == ("b", "B", "t")
    with pytest.raises(ValueError):
        t.upsert(old, new.withColumnRenamed("title", "other"), ["id"], "seq")


@slow
@given(st.lists(st.tuples(st.integers(0, 5), st.text("xyz", max_size=2)), max_size=8))
def test_upsert_is_idempotent(spark, batch):
    old = spark.createDataFrame([(1, "one"), (9, "nine")], "id int, title string")
    new = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(batch)],
                                "id int, title string, seq int")
    once = t.upsert(old, new, ["id"], "seq")
    twice = t.upsert(once, new, ["id"], "seq")
    want = {1: "one", 9: "nine", **dict(batch)}
    assert {r.id: r.title for r in once.collect()} == want
    assert {r.id: r.title for r in twice.collect()} == want


def test_prune_returns_the_orphan(spark):
    defs = spark.createDataFrame([("bound_def", "a", "", None), ("orphan_def", "b", "", None)], DEFINITION)
    binds = spark.createDataFrame([("s", "bound_def")], BINDS)
    for null_aware in (False, True):
        kept, pruned = t.prune_orphans(defs, binds, null_aware)
        assert [r.definition_id for r in pruned.collect()] == ["orphan_def"]
        assert [r.definition_id for r in kept.collect()] == ["bound_def"]


def test_update_spec(spark):
    known = stories(spark, "ab").select("story_id", "title", "verified_spec")
    updates = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("z", "stub", 1)],
                                    "story_id string, verified_spec string, seq int")
    done = t.update_spec(known, updates, order_col="seq")
    assert {tuple(r) for r in done.collect()} == {("a", "title a", "new"), ("b", "title b", None)}
    stubs = t.update_spec(known, updates, insert_missing=True, order_col="seq")
    assert ("z", None, "stub") in {tuple(r) for r in stubs.collect()}


def test_integrity_report(spark):
    nodes = {"UserStory": stories(spark, ["a", "a", "b", None])}
    rows = {"DEPENDS_ON": edges(spark, [("a", "b"), ("a", "b"), ("x", "a"), ("x", "y"), (None, "b")])}
    found = {(r["check"], r["table"]): r["n"] for r in t.integrity_report(nodes, rows).collect()}
    assert found == {
        ("null_key", "UserStory"): 1, ("duplicate_key", "UserStory"): 1,
        ("null_key", "DEPENDS_ON"): 1, ("duplicate_key", "DEPENDS_ON"): 1,
        ("dangling_story_id", "DEPENDS_ON"): 2, ("dangling_depends_on_story_id", "DEPENDS_ON"): 1}
    assert {r["n"] for r in t.integrity_report({"UserStory": stories(spark, [])}, {}).collect()} == {0}


def test_not_in_nulls(spark):
    df = spark.createDataFrame([("a",), (None,)], "k string")
    none = spark.createDataFrame([], "k string")
    null = spark.createDataFrame([("b",), (None,)], "k string")
    plain = spark.createDataFrame([("b",)], "k string")
    assert t.not_in(df, none, "k", True).count() == 2
    assert t.not_in(df, null, "k", True).count() == 0
    assert [r.k for r in t.not_in(df, plain, "k", True).collect()] == ["a"]
    assert t.not_in(df, null, "k").count() == 2


def test_labels(spark):
    graph = StoryGraph(stories(spark, "ab"), spark.createDataFrame([], STEP),
                       spark.createDataFrame([], DEFINITION), spark.createDataFrame([], IMPLEMENTS),
                       spark.createDataFrame([], BINDS), edges(spark, [("a", "b")]))
    assert graph.match("depends_on").collect() == [("a", "title a", "b", "title b")]
    for bad in (graph.match, graph.edge_table, graph.node_table):
        with pytest.raises(ValueError):
            bad("NOPE")
    with pytest.raises(ValueError):
        t.delete_keys(graph.stories, graph.stories, "NOPE")


def test_chain_depths_and_text(spark):
    found = impact_map(stories(spark, ["target", "dep1", "dep2"]),
                       edges(spark, [("dep1", "target"), ("dep2", "dep1")]), targets(spark, "target"))
    assert reached(found) == {("target", "dep1"): 1, ("target", "dep2"): 2}
    assert {r.relation for r in found.collect()} == {"Direct Dependent", "Indirect Dependent (Depth 2)"}
    text = {r.depth: r.context for r in impact_context(found).collect()}
    assert text == {1: "- [Direct] dep1 (title dep1)", 2: "- [Indirect (Depth 2)] dep2 (title dep2)"}


def test_bucketed_edges_give_the_same_map(spark):
    tree = edges(spark, [(str(i), str(i // 2)) for i in range(1, 60)])
    known = stories(spark, [str(i) for i in range(60)])
    plain, bucketed = (reached(impact_map(known, tree, targets(spark, "0", "1", "3"), bucket_rows=n))
                       for n in (1000, 20))
    assert plain == bucketed and plain["1", "59"] == 5


def test_small_buckets_are_bounded_by_the_shuffle_partitions(spark, monkeypatch):
    """A bucket is a task of every level; 59 edges in buckets of one row made 59 of them."""
    made, write = [], graph.write_bucketed
    monkeypatch.setattr(graph, "write_bucketed", lambda *given: made.append(given[-1]) or write(*given))
    tree = edges(spark, [(str(i), str(i // 2)) for i in range(1, 60)])
    known = stories(spark, [str(i) for i in range(60)])
    assert reached(impact_map(known, tree, targets(spark, "1"), bucket_rows=1))["1", "59"] == 5
    assert made == [4]


def test_a_hub_is_cut_into_slices(spark):
    hub = [(f"l{i}", "hub") for i in range(40)] + [("top", "l7"), ("end", "top"), ("hub", "root")]
    known = stories(spark, [f"l{i}" for i in range(40)] + ["top", "end", "hub", "root"])
    plain, cut = (reached(impact_map(known, edges(spark, hub), targets(spark, "root", "hub"), bucket_rows=n))
                  for n in (1000, 6))
    assert plain == cut and plain["root", "end"] == 4 and len(plain) == 85


def test_cycle_returns_root_and_cap_stops(spark):
    ring = edges(spark, [("b", "a"), ("c", "b"), ("a", "c")])
    assert reached(impact_map(stories(spark, "abc"), ring, targets(spark, "a"))) == {
        ("a", "b"): 1, ("a", "c"): 2, ("a", "a"): 3}
    assert reached(impact_map(stories(spark, "abc"), ring, targets(spark, "a"), max_depth=1)) == {
        ("a", "b"): 1}
    assert impact_map(stories(spark, "abc"), ring, targets(spark, "a"), max_depth=0).count() == 0
    assert impact_map(stories(spark, "abc"), edges(spark, []), targets(spark, "a")).count() == 0


def test_missing_story(spark):
    chain = edges(spark, [("gone", "a"), ("c", "gone")])
    known = stories(spark, "ac")
    assert reached(impact_map(known, chain, targets(spark, "a"))) == {}
    assert reached(impact_map(known, chain, targets(spark, "a"), through_missing=True)) == {("a", "c"): 2}


def test_hub_is_paged_whole(spark):
    leaves = [f"l{i:03d}" for i in range(250)]
    found = impact_map(stories(spark, leaves), edges(spark, [(x, "hub") for x in leaves]),
                       targets(spark, "hub"))
    pages = impact_context(found, lines_per_page=50).collect()
    assert len(pages) == 5
    lines = [line for p in pages for line in p.context.split("\n")]
    assert sorted(lines) == [f"- [Direct] {x} (title {x})" for x in leaves]


def test_pages_follow_id_order(spark):
    leaves = [f"l{i:03d}" for i in range(250)]
    found = impact_map(stories(spark, leaves), edges(spark, [(x, "hub") for x in leaves]), targets(spark, "hub"))
    pages = sorted(impact_context(found, lines_per_page=60).collect(), key=lambda p: p.page)
    assert [(p.page, p.n_lines) for p in pages] == [(0, 60), (1, 60), (2, 60), (3, 60), (4, 10)]
    assert "\n".join(p.context for p in pages).split("\n") == [f"- [Direct] {x} (title {x})" for x in leaves]


@slow
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=14), st.sampled_from([2, 1000]))
def test_bfs_against_plain_search(spark, pairs, bucket_rows):
    """All roots at once; with two rows per bucket, hubs and crowded nodes take their own ways."""
    found = impact_map(stories(spark, "0123456"), edges(spark, [(str(a), str(b)) for a, b in pairs]),
                       targets(spark, *"0123456"), bucket_rows=bucket_rows)
    want = {}
    for root in range(7):
        queue = [(root, 0)]
        while queue:
            node, depth = queue.pop(0)
            for a, b in pairs:
                if b == node and (str(root), str(a)) not in want:
                    want[str(root), str(a)] = depth + 1
                    queue.append((a, depth + 1))
    assert reached(found) == want


def test_seen_pairs_are_never_shuffled(spark):
    """A level shuffles its own pairs once; what was seen comes bucket by bucket."""
    seen = SeenPairs(spark, targets(spark, "a").select(F.col("story_id").alias("target"), F.col("story_id").alias("node")).schema)
    def pairs(low, high):
        return spark.range(low, high).select((F.col("id") % 2).cast("string").alias("target"), F.col("id").cast("string").alias("node"))
    seen.add(seen.fresh(pairs(0, 500)), 1)
    seen.add(seen.fresh(pairs(300, 900)), 2)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = seen.fresh(pairs(800, 1000))
        assert sorted(int(r.node) for r in fresh.collect()) == list(range(900, 1000))
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        final = plan.split("Initial Plan")[0]
        assert final.count("Exchange hashpartitioning(") == 1 and "Bucketed: true" in final, final
        assert seen.spark.table(seen.table).where("depth = 2").count() == 400
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        seen.close()


def test_deep_chain(spark):
    """Every link of a chain is found at its depth, from two starts."""
    names = [f"{i:03d}" for i in range(25)]
    chain = edges(spark, [(b, a) for a, b in zip(names, names[1:])])
    found = reached(impact_map(stories(spark, names), chain, targets(spark, "000", "015")))
    assert found == {("000", names[i]): i for i in range(1, 25)} | {("015", names[i]): i - 15 for i in range(16, 25)}
