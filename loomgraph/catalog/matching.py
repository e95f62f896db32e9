"""Registered queries over texts, definitions and vectors."""
from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.catalog.fixtures import load, run
from loomgraph.catalog.graph import story_graph
from loomgraph.catalog.registry import query
from loomgraph.functions import text as tx
from loomgraph.functions import vectors as vec
from loomgraph.functions.embedding import embed
from loomgraph.operators import match as m
from loomgraph.operators import nearest as nn
from loomgraph.plans.features import feature_report as report
from loomgraph.plans.ingest import build_graph
from loomgraph.session import spread
from loomgraph.sources import corpus

FIRST = ("expression",)  # definitions come in the order of their expressions


@query("parse_steps", """
    SELECT doc_id, line_no - 1 AS line_no, regexp_extract(line, '^(The|Of|And)\\s+(.*)$', 1) AS step_type,
           regexp_extract(line, '^(The|Of|And)\\s+(.*)$', 2) AS text,
           concat('gherkin_step_', substr(md5(regexp_extract(line, '^(The|Of|And)\\s+(.*)$', 2)), 1, 12))
               AS step_id
    FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)),
                     lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM {documents} d) u
    WHERE regexp_matches(line, '^(The|Of|And)\\s+(.*)$')""")
def parse_steps(spark, sf):
    files = spread(load(spark, sf, "documents")).select(F.col("doc_id").alias("file_name"),
                                                F.col("text").alias("content"))
    return corpus.parse_steps(files, ("The", "Of", "And")).withColumnRenamed("file_name", "doc_id")


_BLOCK = corpus.DEFINITION_PATTERN


@query("parse_definitions", f"""
    SELECT file_name, pos - 1 AS pos, concat('ruby_def_', substr(md5(expression), 1, 12)) AS definition_id,
           keyword, expression, code_block, contains(expression, chr(10)) AS swallowed
    FROM (SELECT file_name, unnest(regexp_extract_all(content, '{_BLOCK}', 1)) AS keyword,
                 unnest(regexp_extract_all(content, '{_BLOCK}', 2)) AS expression,
                 unnest(regexp_extract_all(content, '{_BLOCK}', 0)) AS code_block,
                 generate_subscripts(regexp_extract_all(content, '{_BLOCK}', 0), 1) AS pos
          FROM {{v_rb}} f) u""")
def parse_definitions(spark, sf):
    return corpus.parse_definitions(load(spark, sf, "v_rb"))


@query("story_nodes", """
    SELECT file_name AS story_id, content AS description,
           array_to_string(list_transform(
               regexp_extract_all(replace(replace(file_name, '.txt', ''), '_', ' '), '(\\p{{L}}+|\\P{{L}}+)'),
               lambda x: concat(upper(x[1]), lower(x[2:]))), '') AS title,
           CASE WHEN l.quality = 1 THEN content END AS verified_spec
    FROM {v_file} f LEFT JOIN {labels} l USING (doc_id)""".replace("{{", "{").replace("}}", "}"))
def story_nodes(spark, sf):
    seeds = run(spark, sf, "SELECT file_name AS story_id, content AS verified_spec "
                           "FROM {v_file} f JOIN {labels} l USING (doc_id) WHERE l.quality = 1")
    return corpus.story_nodes(load(spark, sf, "v_file"), seeds)


@query("feature_routes", "SELECT file_name, CASE " + " ".join(
    f"WHEN contains(lower(file_name), '{word}') THEN '{story}'" for word, story in tx.FEATURE_RULES)
    + " END AS story_id FROM {v_feature} f")
def feature_routes(spark, sf):
    return load(spark, sf, "v_feature").select(
        "file_name", tx.route_feature(F.col("file_name")).alias("story_id"))


_FIRST_START = """
    SELECT text, arg_min(definition_id, expression) AS definition_id
    FROM (SELECT DISTINCT text FROM {v_line} l) t
    JOIN {v_defs} d ON regexp_matches(t.text, concat('\\A(?:', expression, ')')) GROUP BY text"""
_FIRST_ANY = """
    SELECT text, arg_min(definition_id, expression) AS definition_id
    FROM (SELECT DISTINCT text FROM {v_lookup_line} l) t
    JOIN {v_defs} d ON regexp_matches(t.text, expression)
      OR regexp_matches(regexp_replace(trim(t.text), '^\\$?([0-9]+)', '\\1'), expression) GROUP BY text"""


@query("bind_first_match", f"""
    SELECT ord, step_id, text, definition_id FROM {{v_line}} l LEFT JOIN ({_FIRST_START}) f USING (text)""")
def bind_first_match(spark, sf):
    """Ingestion rule: the match begins at the start of the text."""
    lines = load(spark, sf, "v_line").select("ord", "step_id", "text")
    return m.bind(lines, load(spark, sf, "v_defs"), "start", order_by=FIRST)


@query("lookup_first_match", f"""
    SELECT ord, step_id, text, definition_id
    FROM {{v_lookup_line}} l LEFT JOIN ({_FIRST_ANY}) f USING (text)""")
def lookup_first_match(spark, sf):
    """Lookup rule: a match anywhere, in the raw or the normalised text; bad regexes are skipped."""
    lines = load(spark, sf, "v_lookup_line").select("ord", "step_id", "text")
    defs = load(spark, sf, "v_defs").unionByName(load(spark, sf, "v_bad_defs"))
    return m.bind(lines, defs, "none", normalise=True, order_by=FIRST)


@query("quarantined_patterns", "SELECT definition_id, expression FROM {v_bad_defs} b")
def quarantined_patterns(spark, sf):
    defs = load(spark, sf, "v_defs").unionByName(load(spark, sf, "v_bad_defs"))
    return m.valid_patterns(defs)[1].select("definition_id", "expression")


@query("reuse_coverage", f"""
    SELECT brand, CAST(count(f.definition_id) AS BIGINT) AS matched, count(*) AS total,
           count(f.definition_id) / count(*) AS coverage
    FROM {{v_lookup_line}} l LEFT JOIN ({_FIRST_ANY}) f USING (text) GROUP BY brand""")
def reuse_coverage(spark, sf):
    return m.reuse_coverage(load(spark, sf, "v_lookup_line"), load(spark, sf, "v_defs"), ["brand"])


@query("reuse_coverage_total", f"""
    SELECT CAST(count(f.definition_id) AS BIGINT) AS matched, count(*) AS total,
           count(f.definition_id) / count(*) AS coverage
    FROM {{v_lookup_line}} l LEFT JOIN ({_FIRST_ANY}) f USING (text)""")
def reuse_coverage_total(spark, sf):
    return m.reuse_coverage(load(spark, sf, "v_lookup_line"), load(spark, sf, "v_defs"))


def _sim(a: str, b: str) -> str:
    return f"round(list_cosine_similarity({a}.embedding, {b}.embedding), 12)"


@query("cosine_pairs", f"""
    SELECT a.vec_id, b.vec_id AS other, round({_sim('a', 'b')}, 6) AS similarity,
           round(1 - {_sim('a', 'b')}, 6) AS distance
    FROM (SELECT vec_id, {{to_vec}} AS embedding FROM {{embeddings}}) a
    JOIN (SELECT vec_id, {{to_vec}} AS embedding FROM {{embeddings}}) b ON b.vec_id = a.vec_id // 2""")
def cosine_pairs(spark, sf):
    """Each vector with the one at half its number."""
    a = run(spark, sf, "SELECT vec_id, {to_vec} AS a FROM {embeddings}")
    b = a.select(F.col("vec_id").alias("other"), F.col("a").alias("b"))
    pairs = a.withColumn("other", F.floor(F.col("vec_id") / 2)).join(b, "other")
    sim = vec.cosine(F.col("a"), F.col("b"))
    return pairs.select("vec_id", "other", F.round(sim, 6).alias("similarity"),
                        F.round(vec.cosine_distance(F.col("a"), F.col("b")), 6).alias("distance"))


_NEAREST = f"""
    SELECT q.story_id AS query_id, s.story_id, s.title, s.description, s.verified_spec,
           {_sim('q', 's')} AS sim
    FROM {{v_story}} q JOIN {{v_story}} s ON q.story_id <> s.story_id
    WHERE s.verified_spec IS NOT NULL AND s.embedding IS NOT NULL AND q.embedding IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY q.story_id ORDER BY sim DESC, s.story_id) = 1"""


@query("nearest_verified", f"""
    SELECT query_id, story_id, title, description, verified_spec, round(sim, 6) AS similarity
    FROM ({_NEAREST}) n""")
def nearest_verified(spark, sf):
    stories = load(spark, sf, "v_story")
    queries = stories.select(F.col("story_id").alias("query_id"), "embedding")
    return nn.nearest_verified(queries, stories).withColumn(
        "similarity", F.round("similarity", 6)).drop("rank")


@query("retrieval_context", f"""
    SELECT query_id AS story_id, story_id AS similar_id, round(sim, 6) AS similarity,
           concat('Similar User Story: ', title, chr(10), 'Similar User Story Description:', chr(10),
                  description, chr(10), chr(10), 'Verified Specification Code:', chr(10),
                  verified_spec) AS context
    FROM ({_NEAREST}) n WHERE query_id IN (SELECT story_id FROM {{v_story}} v WHERE verified_spec IS NULL)""")
def retrieval_context(spark, sf):
    """Reference text for every story that has no verified spec yet."""
    stories = load(spark, sf, "v_story")
    queries = stories.where("verified_spec IS NULL").select(
        F.col("story_id").alias("query_id"), "embedding")
    return nn.retrieval_context(queries, stories).withColumn(
        "similarity", F.round("similarity", 6))


@query("closest_definition", f"""
    SELECT q.vec_id AS query_id, s.step_id, d.definition_id, d.expression, d.code_block,
           round({_sim('q', 's')}, 6) AS similarity
    FROM (SELECT vec_id, {{to_vec}} AS embedding FROM {{embeddings}}) q
    CROSS JOIN {{v_vec_step}} s JOIN {{v_binds}} b ON b.step_id = s.step_id
    JOIN {{v_defs}} d ON d.definition_id = b.definition_id
    QUALIFY row_number() OVER (PARTITION BY q.vec_id
                               ORDER BY {_sim('q', 's')} DESC, s.step_id, d.definition_id) = 1""")
def closest_definition(spark, sf):
    graph = story_graph(spark, sf, stored=True)
    queries = run(spark, sf, "SELECT vec_id AS query_id, {to_vec} AS embedding FROM {embeddings}")
    near = nn.closest_definition(queries, graph.steps, graph.binds, graph.definitions)
    return near.withColumn("similarity", F.round("similarity", 6)).drop("rank")


@query("topk_neighbours", f"""
    SELECT q.vec_id AS query_id, c.vec_id AS cand_id, round({_sim('q', 'c')}, 6) AS similarity,
           row_number() OVER (PARTITION BY q.vec_id ORDER BY {_sim('q', 'c')} DESC, c.vec_id) AS rank
    FROM (SELECT vec_id, {{to_vec}} AS embedding FROM {{embeddings}}) q
    JOIN (SELECT vec_id, {{to_vec}} AS embedding FROM {{embeddings}}) c ON c.vec_id <> q.vec_id
    QUALIFY rank <= 5""")
def topk_neighbours(spark, sf):
    rows = run(spark, sf, "SELECT vec_id, {to_vec} AS embedding FROM {embeddings}")
    near = nn.top_k(rows.withColumnRenamed("vec_id", "query_id"),
                    rows.withColumnRenamed("vec_id", "cand_id"), k=5)
    return near.select("query_id", "cand_id", F.round("similarity", 6).alias("similarity"),
                       F.col("rank").cast("bigint").alias("rank"))


_MANY_CELLS = f"""
    WITH v AS (SELECT vec_id, {{to_vec}} AS embedding FROM {{embeddings}}),
    near AS (SELECT vec_id + 1000000 AS vec_id,
                    list_transform(embedding, lambda x, i: x + CASE WHEN i = 1 THEN 0.001 ELSE 0.0 END) AS embedding
             FROM v WHERE vec_id % 3 = 0),
    rows AS (SELECT * FROM v UNION ALL SELECT * FROM near),
    ranked AS (SELECT q.vec_id AS query_id, c.vec_id AS cand_id, round({_sim('q', 'c')}, 12) AS sim,
                      row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_sim('q', 'c')}, 12) DESC, c.vec_id) AS rank
               FROM rows q JOIN rows c ON q.vec_id <> c.vec_id)
    SELECT query_id, cand_id, round(sim, 6) AS similarity, rank FROM ranked WHERE rank <= LIMIT_K"""


def _many_cells(spark, sf, k: int):
    """Each vector and shifted copies of a third of them, in cells of 40 candidates."""
    rows = run(spark, sf, "SELECT vec_id, {to_vec} AS embedding FROM {embeddings}")
    near = rows.where("vec_id % 3 = 0").select(
        (F.col("vec_id") + 1_000_000).alias("vec_id"),
        F.transform("embedding", lambda x, i: x + F.when(i == 0, 0.001).otherwise(0.0)).alias("embedding"))
    both = rows.unionByName(near)
    found = nn.top_k(both.withColumnRenamed("vec_id", "query_id"), both.withColumnRenamed("vec_id", "cand_id"),
                     k=k, block_rows=40)
    return found.select("query_id", "cand_id", F.round("similarity", 6).alias("similarity"),
                        F.col("rank").cast("bigint").alias("rank"))


@query("topk_many_cells", _MANY_CELLS.replace("LIMIT_K", "5"))
def topk_many_cells(spark, sf):
    return _many_cells(spark, sf, 5)


@query("top1_many_cells", _MANY_CELLS.replace("LIMIT_K", "1"))
def top1_many_cells(spark, sf):
    return _many_cells(spark, sf, 1)


@query("nearest_bad_vectors", f"""
    WITH v AS (SELECT vec_id, label, {{to_vec}} AS embedding FROM {{embeddings}} WHERE label NOT IN (0, 1, 2, 3)),
    ranked AS (SELECT q.vec_id AS query_id, c.vec_id AS cand_id, round({_sim('q', 'c')}, 12) AS sim,
                      row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_sim('q', 'c')}, 12) DESC, c.vec_id) AS rank
               FROM v q JOIN v c ON q.vec_id <> c.vec_id)
    SELECT query_id, cand_id, round(sim, 6) AS similarity, rank FROM ranked WHERE rank <= 3""")
def nearest_bad_vectors(spark, sf):
    """Vectors with NaN, infinite or null elements, and empty ones, are skipped and hide nothing."""
    rows = run(spark, sf, "SELECT vec_id, label, {to_vec} AS embedding FROM {embeddings}")
    spoilt = {0: F.lit(float("nan")), 1: F.lit(float("inf")), 2: F.lit(None).cast("double")}
    value = F.when(F.col("label") == 0, spoilt[0]).when(F.col("label") == 1, spoilt[1]).otherwise(spoilt[2])
    bad = F.when(F.col("label").isin(*spoilt), F.transform(
        "embedding", lambda x, i: F.when(i == 1, value).otherwise(x))).otherwise(F.col("embedding"))
    bad = F.when(F.col("label") == 3, F.array().cast("array<double>")).otherwise(bad)
    rows = rows.select("vec_id", bad.alias("embedding"))
    near = nn.top_k(rows.withColumnRenamed("vec_id", "query_id"), rows.withColumnRenamed("vec_id", "cand_id"),
                    k=3, block_rows=64)
    return near.select("query_id", "cand_id", F.round("similarity", 6).alias("similarity"),
                       F.col("rank").cast("bigint").alias("rank"))


_RESOLVED = f"""
    SELECT s.step_id, s.text,
           CASE WHEN f.definition_id IS NOT NULL THEN 'REUSE'
                WHEN n.sim >= 0.6 THEN 'EXPAND' ELSE 'GENERATE' END AS action,
           CASE WHEN f.definition_id IS NOT NULL THEN f.definition_id
                WHEN n.sim >= 0.6 THEN n.definition_id END AS definition_id,
           CASE WHEN f.definition_id IS NULL AND n.sim >= 0.6 THEN round(n.sim, 6) END AS similarity
    FROM {{v_vec_step}} s
    LEFT JOIN (SELECT text, arg_min(definition_id, ORDERING) AS definition_id
               FROM {{v_vec_step}} t JOIN {{v_defs}} d ON regexp_matches(t.text, expression)
               GROUP BY text) f ON f.text = s.text
    LEFT JOIN (SELECT q.step_id AS step_id, b.definition_id, {_sim('q', 'c')} AS sim
               FROM {{v_vec_step}} q CROSS JOIN {{v_vec_step}} c
               JOIN {{v_binds}} b ON b.step_id = c.step_id
               QUALIFY row_number() OVER (PARTITION BY q.step_id ORDER BY sim DESC, c.step_id,
                                          b.definition_id) = 1) n ON n.step_id = s.step_id"""


@query("step_resolution", "SELECT step_id, action, definition_id, similarity FROM ("
       + _RESOLVED.replace("ORDERING", "expression") + ") r")
def step_resolution(spark, sf):
    graph = story_graph(spark, sf, stored=True)
    found = m.resolve_steps(graph.steps, graph.steps, graph.binds, graph.definitions, order_by=FIRST)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("feature_report", "WITH resolved AS (" + _RESOLVED.replace("ORDERING", "definition_id") + """),
    made AS (SELECT text FROM resolved WHERE action = 'GENERATE'),
    hit AS (SELECT step_id FROM resolved r WHERE action <> 'EXPAND'
            OR EXISTS (SELECT 1 FROM made g WHERE contains(r.text, g.text)))
    SELECT l.brand, count(h.step_id) AS matched, count(*) AS total,
           count(h.step_id) / count(*) AS coverage,
           printf('%.2f%%', count(h.step_id) * 100.0 / count(*)) AS coverage_text
    FROM {v_vec_line} l LEFT JOIN hit h ON h.step_id = l.step_id GROUP BY l.brand""")
def feature_report(spark, sf):
    """Coverage per brand after the lines were mapped."""
    return report(load(spark, sf, "v_vec_line"), story_graph(spark, sf, stored=True), ["brand"]).coverage


@query("feature_orphans", "WITH resolved AS (" + _RESOLVED.replace("ORDERING", "definition_id") + """)
    SELECT definition_id FROM {v_defs} d
    WHERE definition_id NOT IN (SELECT definition_id FROM {v_binds} b)
      AND definition_id NOT IN (SELECT definition_id FROM resolved WHERE definition_id IS NOT NULL)""")
def feature_orphans(spark, sf):
    """Definitions left without an edge after the lines were mapped."""
    return report(load(spark, sf, "v_vec_line"), story_graph(spark, sf, stored=True)).pruned.select("definition_id")


@query("feature_second_pass", "WITH RECURSIVE resolved AS (" + _RESOLVED.replace("ORDERING", "definition_id") + r"""),
    made AS (
        SELECT r.step_id, r.text, row_number() OVER (ORDER BY l.ord) AS n,
               CASE r.action WHEN 'EXPAND' THEN r.definition_id
                    ELSE concat('ruby_def_', substr(md5(r.text), 1, 12)) END AS made_id,
               CASE r.action WHEN 'EXPAND' THEN replace(d.expression, 'is (\d+)', 'is (?:\$)?(\d+)') ELSE r.text END AS expression
        FROM resolved r JOIN (SELECT step_id, min(ord) AS ord FROM {v_vec_line} a GROUP BY step_id) l ON l.step_id = r.step_id
        LEFT JOIN {v_defs} d ON d.definition_id = r.definition_id WHERE r.action <> 'REUSE'),
    walk AS (  -- line after line, with all that was made so far
        SELECT 0::BIGINT AS n, NULL::VARCHAR AS step_id, NULL::VARCHAR AS hit, []::STRUCT(id VARCHAR, e VARCHAR)[] AS makers
        UNION ALL
        SELECT n, step_id, h, CASE WHEN h IS NULL THEN list_append(makers, struct_pack(id := made_id, e := expression)) ELSE makers END
        FROM (SELECT w.makers, m.n, m.step_id, m.made_id, m.expression,
                     list_filter(w.makers, lambda k: regexp_matches(m.text, k.e))[1].id AS h
              FROM walk w JOIN made m ON m.n = w.n + 1) t)
    SELECT r.step_id, CASE WHEN hit IS NULL THEN r.action ELSE 'REUSE' END AS action,
           coalesce(hit, r.definition_id) AS definition_id
    FROM resolved r LEFT JOIN walk w ON w.step_id = r.step_id""")
def feature_second_pass(spark, sf):
    """What becomes of each step when lines see what earlier lines made or widened."""
    found = report(load(spark, sf, "v_vec_line"), story_graph(spark, sf, stored=True), in_order=True)
    return found.resolved.select("step_id", "action", "definition_id")


@query("phrase_list", """
    SELECT step_id, concat('- ', step_type, ' ', text) AS line FROM {v_step} s""")
def phrase_list(spark, sf):
    return m.phrase_lines(load(spark, sf, "v_step"))


@query("checklist_text", """
    SELECT conv_id, turn, concat('- [ ] ', replace(text, chr(10), concat(chr(10), '- [ ] '))) AS checklist
    FROM {conversations} c""")
def checklist_text(spark, sf):
    """The lines of each message as open items."""
    return load(spark, sf, "conversations").select(
        "conv_id", "turn", tx.checklist(F.split("text", "\n")).alias("checklist"))


@query("widen_expression", r"""
    SELECT definition_id, replace(e, 'is (\d+)', 'is (?:\$)?(\d+)') AS expression,
           replace(c, e, replace(e, 'is (\d+)', 'is (?:\$)?(\d+)')) AS code_block
    FROM (SELECT definition_id, replace(expression, '([0-9]+)', '(\d+)') AS e,
                 replace(code_block, '([0-9]+)', '(\d+)') AS c FROM {v_defs} d) x""")
def widen_expression(spark, sf):
    def digits(name: str):
        return F.replace(F.col(name), F.lit("([0-9]+)"), F.lit(r"(\d+)"))
    defs = load(spark, sf, "v_defs").select("definition_id", digits("expression").alias("e"),
                                            digits("code_block").alias("c"))
    return defs.select("definition_id", tx.widen(F.col("e")).alias("expression"),
                       tx.widen_code(F.col("c"), F.col("e")).alias("code_block"))


@query("strip_fences", """
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(
               CASE WHEN doc_id % 2 = 0 THEN concat('```ruby', chr(10), text, chr(10), '```', chr(10))
                    ELSE text END, '^\\s+|\\s+$', '', 'g'),
               '^```ruby\\n', ''), '\\n```$', '') AS code
    FROM {documents} d""")
def strip_fences(spark, sf):
    docs = spread(load(spark, sf, "documents"))
    fenced = F.concat(F.lit("```ruby\n"), F.col("text"), F.lit("\n```\n"))
    code = F.when(F.col("doc_id") % 2 == 0, fenced).otherwise(F.col("text"))
    return docs.select("doc_id", tx.strip_fence(code).alias("code"))


@query("normalise_steps", """
    SELECT ord, text, regexp_replace(trim(text), '^\\$?([0-9]+)', '\\1') AS clean
    FROM {v_lookup_line} l""")
def normalise_steps(spark, sf):
    return load(spark, sf, "v_lookup_line").select(
        "ord", "text", tx.normalise_step(F.col("text")).alias("clean"))


@query("unsafe_flag", """
    SELECT doc_id, regexp_matches(lower(text), 'token|password|secret') AS unsafe FROM {documents} d""")
def unsafe_flag(spark, sf):
    words = ("token", "password", "secret")
    return spread(load(spark, sf, "documents")).select(
        "doc_id", tx.unsafe_flag(F.col("text"), words).alias("unsafe"))


@query("vector_roundtrip", """
    SELECT vec_id, len(embedding) AS dims, round(list_sum(embedding), 6) AS total
    FROM {embeddings} e WHERE label NOT IN (3, 4)""")
def vector_roundtrip(spark, sf):
    """Vectors as JSON text; broken and empty ones are skipped."""
    rows = run(spark, sf, "SELECT vec_id, label, {to_vec} AS embedding FROM {embeddings}")
    text = (F.when(F.col("label") == 3, F.lit("[0.1, ")).when(F.col("label") == 4, F.lit("[]"))
            .otherwise(vec.encode_vec(F.col("embedding"))))
    decoded = rows.select("vec_id", vec.decode_vec(text).alias("v")).where("v IS NOT NULL")
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return decoded.select("vec_id", F.size("v").cast("bigint").alias("dims"),
                          F.round(total, 6).alias("total"))


def _tally(letter: str) -> str:
    return f"CAST(length(text) - length(replace(text, '{letter}', '')) AS DOUBLE) AS n_{letter}"


@query("embed_udf", "SELECT doc_id, " + ", ".join(_tally(c) for c in "aeiou") + " FROM {documents} d")
def embed_udf(spark, sf):
    """A user function as the embedding stage: how often each vowel comes."""
    def tally(texts: list[str]) -> list[list[float]]:
        return [[t.count(c) for c in "aeiou"] for t in texts]
    docs = spread(load(spark, sf, "documents")).select("doc_id", "text")
    vectors = embed(docs, "text", tally)
    return vectors.select("doc_id", *[F.get("embedding", F.lit(i)).alias(f"n_{c}")
                                      for i, c in enumerate("aeiou")])


@query("embed_hashing", """
    SELECT doc_id, 1.0::DOUBLE AS norm FROM {documents} d WHERE regexp_matches(text, '[a-z]{{3}}')"""
       .replace("{{", "{").replace("}}", "}"))
def embed_hashing(spark, sf):
    """Hashed TF-IDF vectors have length 1."""
    docs = spread(load(spark, sf, "documents")).select("doc_id", "text")
    rows = embed(docs.where(F.rlike("text", F.lit("[a-z]{3}"))), "text", dims=256)
    return rows.select("doc_id", F.round(vec.norm(F.col("embedding")), 6).alias("norm"))


@query("embed_all", r"""
    SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[\p{L}\p{M}\p{N}_]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm
    FROM {documents} d""")
def embed_all(spark, sf):
    """Every document has a vector: of length 1, or 0 where its text has no word."""
    docs = spread(load(spark, sf, "documents")).select("doc_id", "text")
    rows = embed(docs, "text", dims=256)
    return rows.select("doc_id", F.round(vec.norm(F.col("embedding")), 6).alias("norm"))


@query("ingest_graph", """
    WITH def AS (SELECT p_partkey FROM {part} p),
    step AS (SELECT DISTINCT concat('the ', p_name, ' item ', p_partkey, ' stock is ', p_size) AS text,
                    p_partkey, p_partkey // 20 AS file_no FROM {part} q WHERE p_partkey % 4 <> 0)
    SELECT 'UserStory' AS label, count(*) AS n FROM {v_file} f
    UNION ALL SELECT 'RubyDefinition', count(*) FROM def
    UNION ALL SELECT 'GherkinStep', count(*) FROM step
    UNION ALL SELECT 'IMPLEMENTS', count(*) FROM step WHERE file_no % 3 < 2
    UNION ALL SELECT 'BINDS', count(*) FROM step WHERE p_partkey % 20 <> 7
    UNION ALL SELECT 'DEPENDS_ON', 0""")
def ingest_graph(spark, sf):
    """Three corpora to one graph; a definition per part, each step bound to its own."""
    graph = build_graph(spread(load(spark, sf, "v_file")).select("file_name", "content"),
                        load(spark, sf, "v_rb"), load(spark, sf, "v_feature"),
                        embed_fn=lambda df, col: embed(df, col, dims=64))
    both = graph.nodes().select("label").unionByName(graph.edges().select("label"))
    counts = both.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(graph.depends_on.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("DEPENDS_ON").alias("label"), "n"))
