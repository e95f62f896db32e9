import hashlib
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions.patterns import GRAM, required_grams, required_pieces
from loomgraph.operators import match as m
from loomgraph.operators import nearest as nn
from loomgraph.plans.features import resolve_in_order
from loomgraph.schema import BINDS, DEFINITION, STEP, STORY

PATTERNS = [
    r"the initial balance is (\d+)", r"balance", r"^the (\w+ )?initial", r"(?i)THE INITIAL", r"\d+",
    r"(withdraw|deposit)s money", r"x{2,}abcd", r"(?P<who>user) pays", r"a(bcde)?f", r"[bal]+ance is",
    r"is (\d+)$", r"(?<=the )initial", r"pay\.s", r"(a|b", r"", r"(deposit){1,2}ed", r"^\$?5 euros",
]
TEXTS = [
    "the initial balance is 100", "THE INITIAL balance", "user pays", "he deposits money", "xxabcd",
    "af abcdef", "pay.s", "nothing here", "$5 euros", " $5 euros", "depositdeposited", "abc", "the old balance is 7",
]


def defs(spark, expressions):
    return spark.createDataFrame([(f"d{i:02d}", e, "", None) for i, e in enumerate(expressions)], DEFINITION)


def expected(expressions, anchor, normalise):
    out = {}
    for text in set(TEXTS):
        clean = re.sub(r"^\$?(\d+)", r"\1", text.strip())
        for i, expression in enumerate(expressions):
            try:
                find = getattr(re.compile(expression), "match" if anchor == "start" else "search")
            except re.error:
                continue
            if find(text) or (normalise and find(clean)):
                out[text] = f"d{i:02d}"
                break
    return out


@pytest.mark.parametrize("anchor,normalise", [("start", False), ("none", True)])
@pytest.mark.parametrize("patterns", [PATTERNS[:14], [p for p in PATTERNS if p], PATTERNS])
def test_first_match_equals_plain_loop(spark, anchor, normalise, patterns):
    texts = spark.createDataFrame([(t,) for t in TEXTS * 2], "text string")
    found = m.first_match(texts, defs(spark, patterns), anchor, normalise, block_rows=5)
    assert {r.text: r.definition_id for r in found.collect()} == expected(patterns, anchor, normalise)


def test_postings_carry_no_text(spark):
    """Broadcasts off: what meets on a piece is keys; texts only come for the candidates that are left."""
    plain = m.materialize(spark.createDataFrame(list(enumerate(TEXTS)), "key long, text string"), "texts")
    blockable = m.prepare_definitions(defs(spark, PATTERNS[:13])).where(F.size("grams") > 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = m.postings(plain, blockable)
        found = m.candidates(index, blockable)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert index.columns == ["gram", "key"] and "text" not in plan and "expression" not in plan
        # the three rarest pieces of each definition are all held
        pieces = {r.definition_id: r.grams for r in blockable.collect()}
        pairs = {(r.definition_id, r.key) for r in found.collect()}
        for d, grams in pieces.items():
            whole = {(d, i) for i, t in enumerate(TEXTS) if all(g in t for g in grams)}
            some = {(d, i) for i, t in enumerate(TEXTS) if any(g in t for g in grams)}
            mine = {p for p in pairs if p[0] == d}
            assert whole <= mine <= some
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_long_texts_and_crowded_pieces(spark):
    """Texts of 20,000 characters, and a piece that all texts share."""
    filler = "".join(chr(97 + i * i % 23) for i in range(20_000))
    texts = [f"{filler} order {i} is paid" for i in range(40)] + ["order 7 is paid", filler]
    expressions = [r"order 7 is paid$", r"order 1\d is paid", r"order \d+ is paid", r"never written"]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r.definition_id for r in m.first_match(table, defs(spark, expressions)).collect()}
    want = {t: next(f"d{i:02d}" for i, e in enumerate(expressions) if re.search(e, t))
            for t in texts if " is paid" in t}
    assert got == want


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.sampled_from(PATTERNS), st.text("abcde $5xthe initalbce", max_size=40))
def test_grams_are_required(expression, text):
    try:
        pattern = re.compile(expression)
    except re.error:
        return
    if pattern.search(text):
        assert all(g in text and len(g) == GRAM for g in required_grams(expression))


def test_bad_patterns_are_quarantined(spark):
    ok, bad = m.valid_patterns(defs(spark, ["fine", "broken (", "[a-"]))
    assert [r.expression for r in ok.collect()] == ["fine"]
    assert all(r.reason for r in bad.collect()) and bad.count() == 2


def test_coverage_counts_lines_and_empty_is_full(spark):
    lines = spark.createDataFrame([("a", "same"), ("a", "same"), ("a", "other"), ("b", "other")],
                                  "brand string, text string")
    found = {r.brand: (r.matched, r.total, r.coverage)
             for r in m.reuse_coverage(lines, defs(spark, ["^same$"]), ["brand"]).collect()}
    assert found == {"a": (2, 3, 2 / 3), "b": (0, 1, 0.0)}
    assert m.reuse_coverage(lines.limit(0), defs(spark, ["x"])).collect() == [(0, 0, 1.0)]


def test_generated_definitions(spark):
    steps = spark.createDataFrame([("s", "Given", "the balance is $10", None)], STEP)
    resolved = spark.createDataFrame([("s", "GENERATE")], "step_id string, action string")
    raw = m.generated_definitions(resolved, steps).first()
    assert raw.expression == "the balance is $10" and not re.search(raw.expression, raw.expression)
    quoted = m.generated_definitions(resolved, steps, escape=True).first().expression
    assert re.search(quoted, "the balance is $10")


def test_closest_definition(spark):
    steps = spark.createDataFrame([("s1", "Given", "x", [0.1, 0.2, 0.3]), ("s2", "Given", "y", [1.0, 0.0, 0.0]),
                                   ("s3", "Given", "unbound", [0.1, 0.21, 0.3])], STEP)
    binds = spark.createDataFrame([("s1", "d01"), ("s2", "d00")], BINDS)
    query = spark.createDataFrame([("q", [0.1, 0.21, 0.3])], "query_id string, embedding array<double>")
    best = nn.closest_definition(query, steps, binds, defs(spark, ["a", "b"])).collect()
    assert [r.definition_id for r in best] == ["d01"] and best[0].similarity > 0.99


def test_nearest_edge_cases(spark):
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [-1.0, 0.0]), ("d", [0.0, 0.0]),
            ("e", [1.0]), ("f", []), ("g", None)]
    stories = spark.createDataFrame([(i, i, i, v, "spec") for i, v in rows], STORY)
    queries = spark.createDataFrame(rows, "query_id string, embedding array<double>")
    best = {r.query_id: (r.story_id, r.similarity)
            for r in nn.nearest_verified(queries, stories).collect()}
    # c only has exact opposites and neutral vectors; e fits no other length
    assert best == {"a": ("b", 1.0), "b": ("a", 1.0), "c": ("d", 0.0), "d": ("a", 0.0), "e": ("a", 0.0)}


def test_opposite_is_never_chosen(spark):
    q = spark.createDataFrame([("q", [1.0])], "query_id string, embedding array<double>")
    c = spark.createDataFrame([("c", [-2.0])], "cand_id string, embedding array<double>")
    assert nn.top_k(q, c).count() == 0


def brute_force(vectors, k, exclude_self):
    def cosine(a, b):
        size = (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / size if len(a) == len(b) and size else 0.0
    out = set()
    for i, a in vectors:
        sims = sorted((-round(cosine(a, b), 9), j) for j, b in vectors if not (exclude_self and i == j))
        out |= {(i, j, -s, n + 1) for n, (s, j) in enumerate(sims[:k]) if -s > -1.0}
    return out


@pytest.mark.parametrize("k,exclude_self,block_rows", [
    (1, True, 1000), (1, True, 7), (3, True, 7), (3, False, 5), (2, True, 1), (50, True, 9)])
def test_top_k_equals_brute_force(spark, k, exclude_self, block_rows):
    """Three tight clusters, one of them holding most vectors, odd lengths and zero vectors."""
    vectors = []
    for i in range(60):
        axis = 0 if i % 3 else 1 + i % 2
        vector = [((i * 7 + 3 * d) % 11) / 100 for d in range(4)]
        vector[axis] += 1.0
        vectors.append((i, vector))
    vectors += [(60, [1.0, 1.0]), (61, [1.0, 0.9]), (62, [0.0] * 4), (63, [0.0] * 4), (64, [-1.0, -1.0])]
    q = spark.createDataFrame(vectors, "query_id int, embedding array<double>")
    c = spark.createDataFrame(vectors, "cand_id int, embedding array<double>")
    found = nn.top_k(q, c, k, exclude_self, block_rows).collect()
    assert {(r.query_id, r.cand_id, round(r.similarity, 9), r.rank) for r in found} == brute_force(
        vectors, k, exclude_self)


def test_far_cells_are_not_visited():
    """Ten separate clusters: a query visits its own."""
    pivots = pd.Series([np.eye(10)[i] for i in range(10)])
    visit = nn._visitor(list(range(10)), pivots, np.full(10, 5.0), np.full(10, 0.05), 1, False)
    near = pd.DataFrame({"query_id": [100], "embedding": [np.eye(10)[3] + 0.01]})
    assert [list(x) for x in next(visit(iter([near])))["cells"]] == [[3]]


def test_visits_fall_with_the_bound(spark):
    """Clusters: each query meets its own cells and not the rest; the result is the plain one."""
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((12, 8)) * 3
    vectors = [(i, (centres[i % 12] + rng.standard_normal(8) * 0.05).tolist()) for i in range(600)]
    q = spark.createDataFrame(vectors[:200], "query_id int, embedding array<double>")
    c = spark.createDataFrame(vectors, "cand_id int, embedding array<double>")
    visited = []
    found = nn.top_k(q, c, 3, True, 10, visited).collect()
    want = {w for w in brute_force(vectors, 3, True) if w[0] < 200}
    assert {(r.query_id, r.cand_id, round(r.similarity, 9), r["rank"]) for r in found} == want
    cells = 600 // 10
    assert visited[0] == 200 and sum(visited) < 200 * cells / 4


def test_shrinking_bound_prunes_later_rounds(spark):
    """Evenly spread vectors: far fewer cells are visited than the first bound would have asked for."""
    angles = np.linspace(0, np.pi / 2, 500)
    vectors = [(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles)]
    q = spark.createDataFrame(vectors, "query_id int, embedding array<double>")
    c = spark.createDataFrame(vectors, "cand_id int, embedding array<double>")
    visited = []
    found = nn.top_k(q, c, 1, True, 5, visited).collect()
    assert len(found) == 500 and all(abs(r.query_id - r.cand_id) == 1 for r in found)
    assert sum(visited) < 500 * 8


def test_no_candidates(spark):
    q = spark.createDataFrame([("q", [1.0])], "query_id string, embedding array<double>")
    c = spark.createDataFrame([], "cand_id string, embedding array<double>")
    assert nn.top_k(q, c).count() == 0


def test_cascade(spark):
    steps = spark.createDataFrame([
        ("s1", "Given", "the account balance is 1000", [1.0, 0.0]),
        ("s2", "When", "the account holds 5", [0.9, 0.1]), ("s3", "When", "a new action", [0.0, 1.0]),
        ("s4", "When", "no vector", None)], STEP)
    binds = spark.createDataFrame([("s1", "d00")], BINDS)
    found = m.resolve_steps(steps, steps, binds, defs(spark, [r"account balance is \d+"]))
    assert {r.step_id: (r.action, r.definition_id) for r in found.collect()} == {
        "s1": ("REUSE", "d00"), "s2": ("EXPAND", "d00"), "s3": ("GENERATE", None), "s4": ("GENERATE", None)}


def test_unusable_vectors_hide_no_neighbour(spark):
    nan, inf = float("nan"), float("inf")
    candidates = spark.createDataFrame(
        [("a", [0.9, 0.1]), ("b", [0.5, 0.5]), ("c", [nan, 1.0]), ("d", [None, 1.0]),
         ("e", [inf, 1.0]), ("f", []), ("g", None)], "cand_id string, embedding array<double>")
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("bad", [nan, 0.0])],
                                    "query_id string, embedding array<double>")
    got = nn.top_k(queries, candidates, k=2, block_rows=1).collect()
    assert sorted((r.query_id, r["rank"], r.cand_id) for r in got) == [("q", 1, "a"), ("q", 2, "b")]


def in_order(lines, definitions, resolved):
    """One line after the other."""
    made, out = [], {}
    for step, text in lines:
        action, definition = resolved[step]
        if action != "REUSE":
            hit = next((d for d, e in made if re.search(e, text)), None)
            if hit:
                action, definition = "REUSE", hit
            elif action == "EXPAND":
                made.append((definition, definitions[definition].replace(r"is (\d+)", r"is (?:\$)?(\d+)")))
            else:
                made.append((f"ruby_def_{hashlib.md5(text.encode()).hexdigest()[:12]}", text))
        out[step] = (action, definition)
    return out


def test_lines_see_what_earlier_lines_made(spark):
    texts = ["pay 1", "pay 12", "pay 123 now", "he will pay 12", "debt is $5", "debt is 7 and pay 1", "a.c", "abc", "abcd", "a+", "aa+",
             "debt is $5 to abc", "new", "newer", "newest", "the newer one", "debt is $9"]
    expand = {"debt is $5", "debt is 7 and pay 1", "debt is $9"}
    definitions = {"d1": r"debt is (\d+) or else", "d2": r"debt is (\d+)"}
    known = spark.createDataFrame([(d, e, "", None) for d, e in definitions.items()], DEFINITION)
    for seed in range(3):
        order = list(np.random.default_rng(seed).permutation(len(texts)))
        lines = [(f"s{i}", texts[i]) for i in order]
        resolved = {f"s{i}": ("EXPAND", "d2") if t in expand else ("REUSE", "d1") if t == "newest" else ("GENERATE", None)
                    for i, t in enumerate(texts)}
        table = spark.createDataFrame([(s, a, d, 0.7 if a == "EXPAND" else None) for s, (a, d) in resolved.items()],
                                      "step_id string, action string, definition_id string, similarity double")
        rows = spark.createDataFrame([(s, t, n) for n, (s, t) in enumerate(lines)], "step_id string, text string, ord int")
        got = {r.step_id: (r.action, r.definition_id) for r in resolve_in_order(table, rows, known).collect()}
        assert got == in_order(lines, definitions, resolved)


@pytest.mark.parametrize("k,exclude_self,block_rows,repeats", [(3, True, 10, 1), (1, False, 4, 3), (4, True, 500, 3), (60, False, 9, 2)])
def test_many_bundles_equal_brute_force(spark, monkeypatch, k, exclude_self, block_rows, repeats):
    """Bundles of 40 candidates and blocks of 30 visitors; each vector several times; one pivot holds too many."""
    monkeypatch.setattr(nn, "BUNDLE_ROWS", 40)
    monkeypatch.setattr(nn, "VISITORS", 30)
    rng = np.random.default_rng(5)
    plain = rng.standard_normal((100, 6)) + np.where(np.arange(100) % 2, 9.0, 0.0)[:, None]
    vectors = [(i, plain[i % 100].tolist()) for i in range(100 * repeats)] + [(900, [1.0, 2.0]), (901, [0.0] * 6)]
    q = spark.createDataFrame(vectors, "query_id int, embedding array<double>")
    c = spark.createDataFrame(vectors, "cand_id int, embedding array<double>")
    found = nn.top_k(q, c, k, exclude_self, block_rows).collect()
    assert len(found) == len(set(found))
    want = {(i, j, rank): s for i, j, s, rank in brute_force(vectors, k, exclude_self)}
    assert {(r.query_id, r.cand_id, r["rank"]) for r in found} == set(want)
    assert all(abs(r.similarity - want[r.query_id, r.cand_id, r["rank"]]) < 2e-9 for r in found)


def spread_vectors(n, dim, seed):
    """Unit vectors in all directions, where no cell can be left out."""
    m = np.random.default_rng(seed).standard_normal((n, dim))
    return m / np.linalg.norm(m, axis=1)[:, None]


def test_a_bundle_met_whole_sorts_few_similarities(monkeypatch):
    """Spread vectors: almost no pair gets past the products in single precision."""
    sorted_, best = [], nn._best
    monkeypatch.setattr(nn, "_best", lambda sims, k: sorted_.append(sims.size) or best(sims, k))
    a, b = spread_vectors(600, 48, 0), spread_vectors(6000, 48, 1)
    left = pd.DataFrame({"row": range(600), "query_id": range(600), "embedding": list(a), "known": -1.0})
    right = pd.DataFrame({"cand_id": range(6000), "embedding": list(b)})
    found = nn._kernel(5, True, 40, False)(left, right)
    sims = np.round(a @ b.T, 12)
    sims[np.arange(600), np.arange(600)] = -1.0
    want = {(i, int(j)) for i in range(600) for j in np.lexsort((np.arange(6000), -sims[i]))[:5]}
    assert set(zip(found["row"], found["cand_id"].astype(int))) == want
    assert sum(sorted_) < a.shape[0] * b.shape[0] / 20


@pytest.mark.parametrize("k,exclude_self", [(1, True), (5, True), (5, False), (40, True)])
def test_whole_bundles_equal_brute_force(monkeypatch, k, exclude_self):
    """Near and equal copies, opposites, zero vectors, repeated ids and a bound that is known, in small tiles."""
    monkeypatch.setattr(nn, "TILE", 64)
    monkeypatch.setattr(nn, "TILE_ROWS", 37)
    b = spread_vectors(300, 12, 2)
    b[50:90] = b[50] + np.random.default_rng(3).standard_normal((40, 12)) * 1e-8
    b[100:120], b[130:140], b[150] = b[100], 0.0, -b[151]
    b /= np.maximum(np.linalg.norm(b, axis=1), 1e-300)[:, None]
    other = np.arange(300) // 2  # each id comes twice
    rows = np.random.default_rng(4).permutation(300)
    a, own = b[rows], other[rows]
    sims = np.round(np.clip(a @ b.T, -1, 1), 12)
    if exclude_self:
        sims[own[:, None] == other[None, :]] = -1.0
    order = np.array([np.lexsort((np.arange(300), -row))[:k] for row in sims])
    best = np.take_along_axis(sims, order, axis=1)
    for known in (np.full(300, -1.0), best[:, -1], np.where(rows % 2, best[:, 0], -1.0)):
        got, cols = nn._whole(a, b, own if exclude_self else None, other if exclude_self else None, known, k)
        keep = (best > -1.0) & (best >= known[:, None])
        assert (((got > -1.0) & (got >= known[:, None])) == keep).all()
        assert np.allclose(got[keep], best[keep], atol=2e-12, rtol=0)
        far = keep & (np.abs(rows[:, None] - 70) > 20)  # copies 1e-8 apart tie at 12 digits, up to rounding
        assert (cols[far] == order[far]).all()


def test_spread_vectors_equal_brute_force(spark, monkeypatch):
    """Several bundles, each met whole."""
    monkeypatch.setattr(nn, "BUNDLE_ROWS", 300)
    vectors = spread_vectors(700, 24, 5)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    q = spark.createDataFrame(rows, "query_id int, embedding array<double>")
    found = nn.top_k(q, q.withColumnRenamed("query_id", "cand_id"), 3, True, 20).collect()
    sims = np.round(vectors @ vectors.T, 12)
    np.fill_diagonal(sims, -1.0)
    want = {(i, int(j), n + 1) for i in range(700) for n, j in enumerate(np.lexsort((np.arange(700), -sims[i]))[:3])}
    assert {(r.query_id, r.cand_id, r["rank"]) for r in found} == want


def test_small_cells_write_no_more(spark, monkeypatch, tmp_path):
    """What is written is rows of the tables, not visits of cells: a cell for each candidate here, none ruled out."""
    vectors = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(2).standard_normal((300, 32)))]
    q = spark.createDataFrame(vectors, "query_id int, embedding array<double>")
    monkeypatch.setattr("loomgraph.session.shared_root", lambda _: str(tmp_path))
    assert nn.top_k(q, q.withColumnRenamed("query_id", "cand_id"), 3, True, 1).count() == 900
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 500_000


def test_numbered_definitions_have_short_lists(spark):
    """One definition a number: with pieces of four characters each list held the texts of many numbers."""
    numbers = [100_000 + 7 * i for i in range(1000)]
    texts = [f"the red ring item {n} stock is 5" for n in numbers]
    table = m.prepare_definitions(defs(spark, [rf"the red ring item {n} stock is ([0-9]+)" for n in numbers]))
    plain = m.materialize(spark.createDataFrame(list(enumerate(texts)), "key long, text string"), "texts")
    index = m.postings(plain, table)
    rarest = (table.select("definition_id", F.explode("grams").alias("gram"))
              .join(index.groupBy("gram").agg(F.count("key").alias("n")), "gram").groupBy("definition_id").agg(F.min("n").alias("n")))
    assert rarest.where("n = 1").count() == len(numbers)
    assert m.candidates(index, table).count() == len(numbers)
    assert index.count() < 12 * len(numbers)  # of about 30 pieces a text


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.text("ab", min_size=4, max_size=40), st.text("ab", max_size=10), st.text("ab", max_size=10))
def test_pieces_are_required_and_cover_the_grams(run, before, after):
    pieces = required_pieces(run)
    assert all(p in before + run + after for p in pieces)
    assert all(any(g in p for p in pieces) for g in required_grams(run))
