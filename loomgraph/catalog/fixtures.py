"""Logical input tables over the given parquet tables, as SQL both Spark and DuckDB run.

``{name}`` stands for a given table, ``{v_name}`` for another logical table.  A logical table is
spliced in as a subquery, so every query that uses one reads the given tables through it.
"""
from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

# pieces the two engines spell differently: (Spark, DuckDB)
DIALECT = {
    "to_vec": ("CAST(embedding AS ARRAY<DOUBLE>)", "CAST(embedding AS DOUBLE[])"),
    "join_blocks": ("string_agg(block, '') WITHIN GROUP (ORDER BY ord)",
                    "string_agg(block, '' ORDER BY ord)"),
    "open_digits": (r"([0-9]+)", r"([0-9]+)"),
    "ts_us": ("unix_micros(CAST(ts AS TIMESTAMP))", "epoch_us(ts)"),
}

VIEWS = {
    # step lines: the number range widens with the table, so the texts grow with it
    "v_number": """
        SELECT p_partkey, p_name, p_brand, p_size,
               CAST(p_size + 50 * CAST(floor(p_partkey / 2000) AS BIGINT) AS BIGINT) AS num
        FROM {part}""",
    "v_line": """
        SELECT concat('gherkin_step_', substr(md5(text), 1, 12)) AS step_id, step_type, text, ord,
               brand, p_name, num
        FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'Given' WHEN p_partkey % 3 = 1 THEN 'When'
                          ELSE 'Then' END AS step_type,
                     concat('the ', p_name, ' stock is ', CAST(num AS STRING)) AS text,
                     p_partkey AS ord, p_brand AS brand, p_name, num
              FROM {v_number}) t""",
    # the same lines, and lines that only match once their leading dollar sign is gone
    "v_lookup_line": """
        SELECT step_id, step_type, text, ord, brand FROM {v_line}
        UNION ALL
        SELECT concat('gherkin_step_', substr(md5(text), 1, 12)) AS step_id, step_type, text, ord, brand
        FROM (SELECT 'Then' AS step_type, p_partkey AS ord, p_brand AS brand,
                     concat('$', CAST(num AS STRING), ' price of ', p_name) AS text
              FROM {v_number}) t""",
    "v_expression": """
        SELECT DISTINCT concat('the [a-z]+ ', split_part(p_name, ' ', 2), ' stock is {open_digits}')
            AS expression
        FROM {part} WHERE split_part(p_name, ' ', 2) <> 'ring'
        UNION
        SELECT DISTINCT concat('the ', split_part(p_name, ' ', 1), ' [a-z]+ stock') AS expression
        FROM {part} WHERE split_part(p_name, ' ', 1) < 'm'
        UNION
        SELECT DISTINCT concat('stock is ', CAST(num AS STRING), '$') AS expression
        FROM {v_number} WHERE p_size > 25
        UNION
        SELECT DISTINCT concat('^{open_digits} price of ', split_part(p_name, ' ', 1), ' ring')
            AS expression FROM {part}
        UNION
        SELECT DISTINCT concat('never ', s_name) AS expression FROM {supplier}""",
    "v_defs": """
        SELECT concat('ruby_def_', substr(md5(expression), 1, 12)) AS definition_id, expression,
               concat('Given(/^', expression, '$/) do |n|', chr(10), '  check', chr(10), 'end')
                   AS code_block
        FROM {v_expression} e""",
    # definitions with regexes no engine takes
    "v_bad_defs": """
        SELECT concat('ruby_def_', substr(md5(s_name), 1, 12)) AS definition_id,
               concat('broken (', s_name) AS expression, CAST(NULL AS STRING) AS code_block
        FROM {supplier}""",
    "v_step": """
        SELECT step_id, max(text) AS text, max_by(step_type, ord) AS step_type, max(ord) AS ord,
               max(p_name) AS p_name
        FROM {v_line} GROUP BY step_id""",
    # step nodes with a vector each
    "v_vec_step": """
        SELECT s.step_id, s.step_type, s.text, s.ord, {to_vec} AS embedding
        FROM (SELECT *, ord % (SELECT count(*) FROM {embeddings}) AS vec_no FROM {v_step} t) s
        JOIN {embeddings} e ON e.vec_id = s.vec_no""",
    "v_vec_line": """
        SELECT l.step_id, l.step_type, l.text, l.brand, l.ord, v.embedding
        FROM {v_line} l JOIN {v_vec_step} v ON v.step_id = l.step_id""",
    "v_binds": """
        SELECT s.step_id, d.definition_id
        FROM {v_step} s
        JOIN {v_defs} d ON d.expression = concat('the [a-z]+ ', split_part(s.p_name, ' ', 2),
                                                 ' stock is {open_digits}')""",
    "v_story": """
        SELECT concat('doc_', CAST(d.doc_id AS STRING)) AS story_id,
               concat(d.source, '_', d.lang) AS title, d.text AS description,
               {to_vec} AS embedding, CASE WHEN l.quality = 1 THEN d.text END AS verified_spec
        FROM {documents} d
        LEFT JOIN {labels} l ON l.doc_id = d.doc_id
        LEFT JOIN {embeddings} e ON e.vec_id = d.doc_id""",
    "v_implements": """
        SELECT DISTINCT concat('doc_', CAST(ord % (SELECT count(*) FROM {documents}) AS STRING))
                   AS story_id, step_id
        FROM {v_line} v""",
    # every story but the first depends on the story at half its number
    "v_story_depends": """
        SELECT concat('doc_', CAST(doc_id AS STRING)) AS story_id,
               concat('doc_', CAST(CAST(floor(doc_id / 2) AS BIGINT) AS STRING))
                   AS depends_on_story_id
        FROM {documents} WHERE doc_id >= 1""",
    "v_part_story": """
        SELECT concat('p', CAST(p_partkey AS STRING)) AS story_id, p_name AS title, p_size
        FROM {part}""",
    "v_tree": """
        SELECT concat('p', CAST(p_partkey AS STRING)) AS story_id,
               concat('p', CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING))
                   AS depends_on_story_id
        FROM {part} WHERE p_partkey >= 1""",
    # cycles inside blocks of 24 neighbours
    "v_cyclic": """
        SELECT concat('p', CAST(a AS STRING)) AS story_id,
               concat('p', CAST(b AS STRING)) AS depends_on_story_id
        FROM (SELECT p_partkey AS a, base + (j * j + 1) % 24 AS b FROM (
                  SELECT p_partkey, p_partkey % 24 AS j, p_partkey - p_partkey % 24 AS base
                  FROM {part}) x
              UNION
              SELECT p_partkey AS a, base + (3 * j + 2) % 24 AS b FROM (
                  SELECT p_partkey, p_partkey % 24 AS j, p_partkey - p_partkey % 24 AS base
                  FROM {part}) y) z
        WHERE a <> b""",
    # one model call per assistant turn; every fifth conversation is logged twice
    "v_call": """
        SELECT concat('i', CAST(conv_id AS STRING), '_', CAST(turn AS STRING)) AS insert_id,
               1704067200 + conv_id * 3600 + turn * 60 AS ts_s, conv_id, turn,
               concat('c', CAST(conv_id AS STRING)) AS conversation_id,
               CASE WHEN turn % 7 <> 6 THEN concat('gs://b/completions/', CAST(conv_id AS STRING),
                    '-', CAST(turn AS STRING), '_inputs.jsonl') END AS input_ref,
               concat('gs://b/completions/', CAST(conv_id AS STRING), '-', CAST(turn AS STRING),
                      '_outputs.jsonl') AS output_ref,
               CAST(turn * 10 + 5 AS STRING) AS in_tokens,
               CASE WHEN turn % 5 = 4 THEN 'n/a' ELSE CAST(length(text) AS STRING) END AS out_tokens,
               concat('agent_', CAST(conv_id % 3 AS STRING)) AS agent_name
        FROM {conversations} WHERE role = 'assistant'""",
    "v_log": """
        SELECT insert_id, ts_s, concat('t', CAST(conv_id AS STRING), '_', CAST(turn AS STRING)) AS trace,
               concat('s', CAST(conv_id AS STRING), '_', CAST(turn AS STRING)) AS span_id,
               conversation_id, input_ref, output_ref, in_tokens, out_tokens, agent_name,
               concat('u', CAST(conv_id % 7 AS STRING)) AS user_id,
               CASE WHEN conv_id % 4 = 3 THEN 'other' ELSE 'calls' END AS log_name
        FROM (SELECT * FROM {v_call}
              UNION ALL
              SELECT concat('d', insert_id) AS insert_id, ts_s + 1 AS ts_s, conv_id, turn,
                     conversation_id, input_ref, output_ref, in_tokens, out_tokens, agent_name
              FROM {v_call} WHERE conv_id % 5 = 0) t""",
    # file lines: an input file holds the conversation so far, an output file the turn itself
    "v_line_of_file": """
        SELECT c.input_ref AS file_uri, h.role, h.turn AS idx, h.text
        FROM {v_call} c JOIN {conversations} h ON h.conv_id = c.conv_id AND h.turn < c.turn
        WHERE c.input_ref IS NOT NULL
        UNION ALL
        SELECT c.output_ref AS file_uri, h.role, h.turn AS idx, h.text
        FROM {v_call} c JOIN {conversations} h ON h.conv_id = c.conv_id AND h.turn = c.turn""",
    "v_action": """
        SELECT user_id AS run_id, {ts_us} * 1000 + event_id % 1000 AS seq,
               concat('agent_', CAST(event_id % 3 AS STRING)) AS agent_name, props AS prompt,
               event_type AS response, event_id
        FROM {events}""",
    "v_vec_action": """
        SELECT a.run_id, a.seq, a.agent_name, a.response, s.embedding AS story_vec,
               r.embedding AS response_vec
        FROM (SELECT *, run_id % (SELECT count(*) FROM {embeddings}) AS story_no,
                     event_id % (SELECT count(*) FROM {embeddings}) AS response_no
              FROM {v_action} x) a
        JOIN (SELECT vec_id, {to_vec} AS embedding FROM {embeddings}) s ON s.vec_id = a.story_no
        JOIN (SELECT vec_id, {to_vec} AS embedding FROM {embeddings}) r ON r.vec_id = a.response_no""",
    "v_attempt": """
        SELECT o_custkey AS run_id, attempt, o_orderstatus = 'F' AS success
        FROM (SELECT o_custkey, o_orderstatus,
                     row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS attempt
              FROM {orders}) t""",
    "v_event": """
        SELECT conv_id AS run_id, turn AS seq, role AS author, turn % 4 = 3 AS partial,
               turn % 3 = 0 AS has_key, CASE WHEN turn % 2 = 0 THEN text END AS state_value,
               CASE WHEN turn % 5 <> 0 THEN text END AS output
        FROM {conversations}""",
    "v_feedback": """
        SELECT doc_id, 1704067200 + doc_id * 600 AS ts_s, quality * 4 + 1 AS score, toxic,
               CASE WHEN doc_id % 3 = 0 THEN 'other' ELSE 'feedback' END AS log_type,
               CASE WHEN doc_id % 5 = 0 THEN 'other-app' ELSE 'story-app' END AS service_name
        FROM {labels}""",
    "v_rb": """
        SELECT concat('steps_', CAST(file_no AS STRING), '.rb') AS file_name,
               {join_blocks} AS content
        FROM (SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS file_no, p_partkey AS ord,
                     concat(CASE WHEN p_partkey % 20 = 7 THEN
                                 concat('Given(/^one line ', CAST(p_partkey AS STRING), '$/) do end',
                                        chr(10)) ELSE '' END,
                            CASE WHEN p_partkey % 2 = 0 THEN 'Given' ELSE 'Then' END,
                            '(/^the ', p_name, ' item ', CAST(p_partkey AS STRING),
                            ' stock is {open_digits}$/) do |n|', chr(10), '  check n', chr(10), 'end',
                            chr(10)) AS block
              FROM {part}) t
        GROUP BY file_no""",
    # one feature file per twenty parts, its lines in table order
    "v_feature": """
        SELECT concat(CASE WHEN file_no % 3 = 0 THEN 'Withdraw_' WHEN file_no % 3 = 1 THEN 'atm_'
                           ELSE 'misc_' END, CAST(file_no AS STRING), '.feature') AS file_name,
               {join_blocks} AS content
        FROM (SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS file_no, p_partkey AS ord,
                     concat('  ', CASE WHEN p_partkey % 4 = 0 THEN 'And' ELSE 'When' END, ' the ',
                            p_name, ' item ', CAST(p_partkey AS STRING), ' stock is ',
                            CAST(p_size AS STRING), chr(10)) AS block
              FROM {part}) t
        GROUP BY file_no""",
    "v_file": """
        SELECT concat(source, '_', lang, '-part2b_', CAST(doc_id AS STRING), '.txt') AS file_name,
               text AS content, doc_id
        FROM {documents}""",
    "v_eval": """
        SELECT CAST(d.doc_id AS STRING) AS case_id, l.quality, l.toxic = 1 AS expected,
               d.text AS text
        FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id""",
}


def expand(sql: str, table, engine: int) -> str:
    """Replace every ``{name}``; ``table`` renders a given table, ``engine`` picks the dialect."""
    def put(found: re.Match) -> str:
        name = found.group(1)
        if name in DIALECT:
            return DIALECT[name][engine]
        if name in VIEWS:
            return f"({expand(VIEWS[name], table, engine)})"
        return table(name)

    return re.sub(r"\{([a-z_]+)\}", put, sql)


def duck(sql: str) -> str:
    """Oracle text: the given tables are registered under their own names."""
    return expand(sql, lambda name: name, 1)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or a logical table as a DataFrame."""
    return run(spark, sf_dir, "SELECT * FROM {" + name + "} src")


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    root = sf_dir.rstrip("/")

    def view(name: str) -> str:
        # one view per folder and table, so that a file's schema is read once
        known = f"given_{zlib.crc32(root.encode())}_{name}"
        if not spark.catalog.tableExists(known):
            spark.read.parquet(f"{root}/{name}.parquet").createOrReplaceTempView(known)
        return known

    return spark.sql(expand(sql, view, 0))
