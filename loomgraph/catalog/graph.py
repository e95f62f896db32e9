"""Registered queries over the property graph and its tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.catalog.fixtures import load, run
from loomgraph.catalog.registry import query
from loomgraph.operators import graph as g
from loomgraph.operators import tables as t
from loomgraph.schema import BINDS
from loomgraph.session import materialize


def story_graph(spark, sf, stored: bool = False) -> g.StoryGraph:
    """The graph over the logical tables; ``stored`` writes the step side down first, as the
    multi-step operators read it several times."""
    keep = materialize if stored else (lambda df, _: df)
    return g.StoryGraph(
        stories=load(spark, sf, "v_story"), implements=load(spark, sf, "v_implements"),
        steps=keep(load(spark, sf, "v_vec_step"), "graph_steps"),
        definitions=keep(load(spark, sf, "v_defs"), "graph_definitions"),
        binds=keep(load(spark, sf, "v_binds"), "graph_binds"),
        depends_on=load(spark, sf, "v_story_depends"))


@query("pattern_implements", """
    SELECT story_id, title, description, step_id, step_type, text
    FROM {v_implements} e JOIN {v_story} s USING (story_id) JOIN {v_vec_step} g USING (step_id)""")
def pattern_implements(spark, sf):
    return story_graph(spark, sf).match("IMPLEMENTS")


@query("pattern_binds", """
    SELECT step_id, text, definition_id, expression, code_block
    FROM {v_binds} e JOIN {v_vec_step} g USING (step_id) JOIN {v_defs} d USING (definition_id)""")
def pattern_binds(spark, sf):
    return story_graph(spark, sf).match("BINDS")


@query("pattern_depends_on", """
    SELECT a.story_id, a.title AS story_title, b.story_id AS depends_on_id,
           b.title AS depends_on_title
    FROM {v_story_depends} e JOIN {v_story} a ON a.story_id = e.story_id
    JOIN {v_story} b ON b.story_id = e.depends_on_story_id""")
def pattern_depends_on(spark, sf):
    return story_graph(spark, sf).match("DEPENDS_ON")


@query("graph_view_counts", """
    SELECT 'node' AS kind, 'UserStory' AS label, count(*) AS n FROM {v_story} a
    UNION ALL SELECT 'node', 'GherkinStep', count(*) FROM {v_vec_step} b
    UNION ALL SELECT 'node', 'RubyDefinition', count(*) FROM {v_defs} c
    UNION ALL SELECT 'edge', 'IMPLEMENTS', count(*) FROM {v_implements} d
    UNION ALL SELECT 'edge', 'BINDS', count(*) FROM {v_binds} e
    UNION ALL SELECT 'edge', 'DEPENDS_ON', count(*) FROM {v_story_depends} f""")
def graph_view_counts(spark, sf):
    graph = story_graph(spark, sf)
    both = graph.nodes().select(F.lit("node").alias("kind"), "label").unionByName(
        graph.edges().select(F.lit("edge").alias("kind"), "label"))
    return both.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"))


@query("load_summary", """
    SELECT 'UserStory' AS label, count(*) AS n FROM {v_story} a
    UNION ALL SELECT 'GherkinStep', count(*) FROM {v_vec_step} b
    UNION ALL SELECT 'RubyDefinition', count(*) FROM {v_defs} c""")
def load_summary(spark, sf):
    return story_graph(spark, sf).load_summary()


@query("scan_stories", """
    SELECT story_id, title, description, verified_spec, len(embedding) AS dims,
           round(list_sum(embedding), 6) AS vector_sum FROM {v_story} s""")
def scan_stories(spark, sf):
    """All columns of a node table; the vector is shown as its length and sum."""
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    size = F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("bigint")
    return story_graph(spark, sf).node_table("UserStory").select(
        "story_id", "title", "description", "verified_spec", size.alias("dims"),
        F.round(total, 6).alias("vector_sum"))


@query("scan_steps", "SELECT step_id, step_type, text FROM {v_vec_step} s")
def scan_steps(spark, sf):
    return story_graph(spark, sf).all_steps()


@query("scan_definitions", "SELECT definition_id, expression, code_block FROM {v_defs} d")
def scan_definitions(spark, sf):
    return story_graph(spark, sf).all_definitions()


@query("direct_dependents", """
    SELECT story_id, title FROM {v_story} s WHERE story_id IN (
        SELECT story_id FROM {v_story_depends} e WHERE depends_on_story_id IN (
            SELECT story_id FROM {v_story} v WHERE verified_spec IS NOT NULL))""")
def direct_dependents(spark, sf):
    graph = story_graph(spark, sf)
    targets = graph.stories.where("verified_spec IS NOT NULL").select("story_id")
    return g.direct_dependents(graph.stories, graph.depends_on, targets)


# dependents per target by plain recursion; {edges}, {nodes}, {cap} are filled in below
_REACH = """
    WITH RECURSIVE reach(target, story_id, depth) AS (
        SELECT e.depends_on_story_id, e.story_id, 1 FROM EDGES e
        UNION
        SELECT r.target, e.story_id, r.depth + 1 FROM reach r
        JOIN EDGES e ON e.depends_on_story_id = r.story_id WHERE r.depth < CAP)
    SELECT r.target, r.story_id, s.title, CAST(min(r.depth) AS BIGINT) AS depth,
           CASE WHEN min(r.depth) = 1 THEN 'Direct Dependent'
                ELSE concat('Indirect Dependent (Depth ', min(r.depth), ')') END AS relation
    FROM reach r JOIN NODES s ON s.story_id = r.story_id
    WHERE r.target IN (SELECT story_id FROM {v_part_story} p)
    GROUP BY r.target, r.story_id, s.title"""


def _reach(edges: str, nodes: str, cap: int) -> str:
    return _REACH.replace("EDGES", edges).replace("NODES", nodes).replace("CAP", str(cap))


_PRESENT = "(SELECT * FROM {v_part_story} q WHERE p_size <> 50)"


def _impact(spark, sf, edges: str, stories=None, **how):
    every = load(spark, sf, "v_part_story")
    stories = every if stories is None else stories
    found = g.impact_map(stories, load(spark, sf, edges), every.select("story_id"), **how)
    return found.withColumn("depth", F.col("depth").cast("bigint"))


@query("impact_map_tree", _reach("{v_tree}", "{v_part_story}", 40))
def impact_map_tree(spark, sf):
    """What breaks if any one story changes, for every story."""
    return _impact(spark, sf, "v_tree")


@query("impact_map_bucketed", _reach("{v_cyclic}", "{v_part_story}", 24))
def impact_map_bucketed(spark, sf):
    """The same walk with the edges in buckets, too, as beyond a million of them."""
    return _impact(spark, sf, "v_cyclic", bucket_rows=500)


@query("impact_map_cyclic", _reach("{v_cyclic}", "{v_part_story}", 24))
def impact_map_cyclic(spark, sf):
    return _impact(spark, sf, "v_cyclic")


@query("impact_map_capped", _reach("{v_cyclic}", _PRESENT, 3))
def impact_map_capped(spark, sf):
    """Depth cap; ids without a story row are walked through but not returned."""
    stories = load(spark, sf, "v_part_story").where("p_size <> 50")
    return _impact(spark, sf, "v_cyclic", stories, max_depth=3, through_missing=True)


@query("impact_map_missing", _reach(
    f"(SELECT t.* FROM {{v_tree}} t JOIN {_PRESENT} k ON k.story_id = t.story_id)",
    _PRESENT, 40))
def impact_map_missing(spark, sf):
    """Dependents without a story row end the walk."""
    return _impact(spark, sf, "v_tree", load(spark, sf, "v_part_story").where("p_size <> 50"))


@query("impact_summary", "SELECT target, count(*) AS dependents, count(*) FILTER (depth = 1) AS direct,"
       " max(depth) AS max_depth FROM (" + _reach("{v_tree}", "{v_part_story}", 40) + ") i GROUP BY 1")
def impact_summary(spark, sf):
    return g.impact_summary(_impact(spark, sf, "v_tree"))


@query("impact_context", """
    SELECT target, depth, CAST(0 AS BIGINT) AS page, count(*) AS n_lines,
           string_agg(concat('- [', CASE WHEN depth = 1 THEN 'Direct'
                                    ELSE concat('Indirect (Depth ', depth, ')') END,
                             '] ', story_id, ' (', title, ')'), chr(10) ORDER BY story_id) AS context
    FROM (""" + _reach("{v_tree}", "{v_part_story}", 40) + """) i GROUP BY target, depth""")
def impact_context(spark, sf):
    return g.impact_context(_impact(spark, sf, "v_tree"))


# Customers as nodes: the table holds three quarters of them, a batch overlaps and adds the rest;
# a key that comes twice in the batch has its later row win.
_OLD = """SELECT concat('k', CAST(c_custkey AS STRING)) AS id, c_name AS title, c_mktsegment AS spec,
                 c_acctbal AS score FROM {customer} a WHERE c_nationkey < 18"""
_NEW = """SELECT concat('k', CAST(c_custkey AS STRING)) AS id,
                 CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE concat(c_name, '!') END AS title,
                 c_acctbal + 1 AS score, c_custkey AS seq
          FROM {customer} b WHERE c_nationkey >= 12
          UNION ALL
          SELECT concat('k', CAST(c_custkey AS STRING)) AS id, concat(c_name, '?') AS title,
                 c_acctbal + 2 AS score, c_custkey + 1000000000 AS seq
          FROM {customer} c WHERE c_nationkey >= 21"""
_LAST = f"(SELECT * FROM ({_NEW}) n QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"


@query("upsert_replace", f"""
    SELECT id, title, CAST(NULL AS VARCHAR) AS spec, score FROM {_LAST} n
    UNION ALL
    SELECT id, title, spec, score FROM ({_OLD}) o WHERE id NOT IN (SELECT id FROM {_LAST} m)""")
def upsert_replace(spark, sf):
    return t.upsert(run(spark, sf, _OLD), run(spark, sf, _NEW), ["id"], "seq", mode="replace")


@query("upsert_merge", f"""
    SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN o.title ELSE n.title END AS title,
           o.spec, CASE WHEN n.id IS NULL THEN o.score ELSE n.score END AS score
    FROM ({_OLD}) o FULL JOIN {_LAST} n ON n.id = o.id""")
def upsert_merge(spark, sf):
    return t.upsert(run(spark, sf, _OLD), run(spark, sf, _NEW), ["id"], "seq", mode="merge")


# specs for a third of the stories and for as many unknown ids
_SPECS = """SELECT CASE WHEN quality = 1 THEN concat('doc_', CAST(doc_id AS STRING))
                        ELSE concat('gone_', CAST(doc_id AS STRING)) END AS story_id,
                   concat('spec ', CAST(toxic AS STRING)) AS verified_spec FROM {labels} l"""


@query("update_spec", f"""
    SELECT s.story_id, s.title, coalesce(u.verified_spec, s.verified_spec) AS verified_spec
    FROM {{v_story}} s LEFT JOIN ({_SPECS}) u ON u.story_id = s.story_id""")
def update_spec(spark, sf):
    stories = load(spark, sf, "v_story").select("story_id", "title", "verified_spec")
    return t.update_spec(stories, run(spark, sf, _SPECS))


@query("update_spec_stub", f"""
    SELECT coalesce(s.story_id, u.story_id) AS story_id, s.title,
           coalesce(u.verified_spec, s.verified_spec) AS verified_spec
    FROM {{v_story}} s FULL JOIN ({_SPECS}) u ON u.story_id = s.story_id""")
def update_spec_stub(spark, sf):
    """The form that inserts a stub row for an unknown story."""
    stories = load(spark, sf, "v_story").select("story_id", "title", "verified_spec")
    return t.update_spec(stories, run(spark, sf, _SPECS), insert_missing=True)


@query("delete_nodes", f"""
    SELECT story_id, title FROM {{v_story}} s
    WHERE story_id NOT IN (SELECT story_id FROM ({_SPECS}) u)""")
def delete_nodes(spark, sf):
    stories = load(spark, sf, "v_story").select("story_id", "title")
    return t.delete_keys(stories, run(spark, sf, _SPECS), "UserStory")


@query("edge_upsert", """
    SELECT DISTINCT concat('s', CAST(l_partkey AS VARCHAR)) AS story_id,
           concat('g', CAST(l_suppkey AS VARCHAR)) AS step_id FROM {lineitem} l""")
def edge_upsert(spark, sf):
    pair = """SELECT concat('s', CAST(l_partkey AS STRING)) AS story_id,
                     concat('g', CAST(l_suppkey AS STRING)) AS step_id FROM {lineitem} l"""
    return t.upsert_edges(run(spark, sf, pair + " WHERE l_quantity < 30"),
                          run(spark, sf, pair + " WHERE l_quantity >= 20"), "IMPLEMENTS")


@query("integrity_report", """
    WITH story AS (SELECT story_id FROM {v_story} s WHERE verified_spec IS NULL
                   UNION ALL SELECT story_id FROM {v_story} s WHERE title LIKE 'src1%'),
    edge AS (SELECT CASE WHEN story_id LIKE '%9' THEN NULL ELSE story_id END AS story_id,
                    depends_on_story_id FROM {v_story_depends} e)
    SELECT 'null_key' AS check, 'UserStory' AS table, count(*) AS n FROM story WHERE story_id IS NULL
    UNION ALL SELECT 'duplicate_key', 'UserStory', count(*) FROM (
        SELECT story_id FROM story GROUP BY 1 HAVING count(*) > 1) a
    UNION ALL SELECT 'null_key', 'DEPENDS_ON', count(*) FROM edge WHERE story_id IS NULL
    UNION ALL SELECT 'duplicate_key', 'DEPENDS_ON', 0
    UNION ALL SELECT 'dangling_story_id', 'DEPENDS_ON', count(*) FROM edge
        WHERE story_id IS NOT NULL AND story_id NOT IN (SELECT story_id FROM story)
    UNION ALL SELECT 'dangling_depends_on_story_id', 'DEPENDS_ON', count(*) FROM edge
        WHERE depends_on_story_id NOT IN (SELECT story_id FROM story)""")
def integrity_report(spark, sf):
    """A story table with missing and doubled keys, and edges with missing sources."""
    all_stories = load(spark, sf, "v_story")
    stories = all_stories.where("verified_spec IS NULL").unionByName(
        all_stories.where(F.col("title").startswith("src1"))).select("story_id")
    edges = load(spark, sf, "v_story_depends").withColumn(
        "story_id", F.when(~F.col("story_id").endswith("9"), F.col("story_id")))
    return t.integrity_report({"UserStory": stories}, {"DEPENDS_ON": edges})


_PRUNE = "SELECT definition_id, expression FROM {v_defs} d WHERE definition_id NOT IN ("


@query("orphan_prune", _PRUNE + "SELECT definition_id FROM {v_binds} b)")
def orphan_prune(spark, sf):
    _, pruned = t.prune_orphans(load(spark, sf, "v_defs").select("definition_id", "expression"),
                                load(spark, sf, "v_binds"))
    return pruned


@query("orphan_kept", """SELECT definition_id, expression FROM {v_defs} d
    WHERE definition_id IN (SELECT definition_id FROM {v_binds} b)""")
def orphan_kept(spark, sf):
    kept, _ = t.prune_orphans(load(spark, sf, "v_defs").select("definition_id", "expression"),
                              load(spark, sf, "v_binds"))
    return kept


@query("orphan_prune_null_aware", _PRUNE + """SELECT definition_id FROM {v_binds} b
    UNION ALL SELECT CAST(NULL AS VARCHAR))""")
def orphan_prune_null_aware(spark, sf):
    """One edge without a definition: NOT IN finds no orphan at all."""
    binds = load(spark, sf, "v_binds").unionByName(
        spark.createDataFrame([("gherkin_step_x", None)], BINDS))
    _, pruned = t.prune_orphans(load(spark, sf, "v_defs").select("definition_id", "expression"),
                                binds, null_aware=True)
    return pruned
