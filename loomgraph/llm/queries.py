"""The operators as queries over the given tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import bloom_lm, quality_rules, token_store
from loomgraph.llm.decontamination import decontaminate
from loomgraph.llm.exact_dedup import exact_duplicates
from loomgraph.llm.jaccard_join import jaccard_components
from loomgraph.llm.language_id import held_out, identify
from loomgraph.llm.license_rules import scan_licenses
from loomgraph.llm.piece_codec import digests
from loomgraph.llm.prefix_trie import conversation_trie
from loomgraph.llm.relative_lz import remove_repeats
from loomgraph.llm.suffix_dedup import mark_repeats
from loomgraph.llm.whitening import whiten
from loomgraph.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file; asked for only where a query needs it."""
    import public_tokenizers
    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query("op9_exact_dedup", """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
    FROM d WINDOW g AS (PARTITION BY t)""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts of all documents; the largest identifier stays."""
    return exact_duplicates(read(spark, sf_dir, "documents"), keep="largest")


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    docs = read(spark, sf_dir, "documents")
    out = held_out(5, 0)
    return (identify(docs.select("doc_id", "text"), docs.where(~out).select("text", "lang"))
            .select("doc_id", out.alias("held_out"), "lang_pred", "score"))


#: Words and windows of the decontamination contract.
_HIT_WORDS = r"""
    d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM {documents}),
    i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
    windows AS (SELECT DISTINCT item_id, list_slice(w, pos, pos + 12) AS words, least(len(w), 13) AS n
                FROM i, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(pos) WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT n FROM windows),
    places AS (SELECT doc_id, pos, n, list_slice(w, pos, pos + n - 1) AS words
               FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(pos) WHERE len(w) >= n),
    found AS (SELECT p.doc_id, p.pos, p.n, v.item_id FROM places p JOIN windows v USING (words)),
    hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit
            FROM (SELECT DISTINCT doc_id, pos, n FROM found), unnest(range(pos, pos + n)) AS t(q)
            GROUP BY doc_id),
    named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                     sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS s
              FROM found GROUP BY doc_id),
    judged AS (SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit,
                      coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256,
                      coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
               FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id))"""


@query("op4_decontamination",
       "WITH" + _HIT_WORDS.replace("{documents}", "documents") + " SELECT * FROM judged")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 13 words found in the documents."""
    return decontaminate(read(spark, sf_dir, "documents").select("doc_id", "text"),
                         read(spark, sf_dir, "benchmark")).drop("text")


@query("op5_jaccard_join")
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by five-word shingles at a similarity of 0.75."""
    return jaccard_components(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id")


@query("op8_piece_codec")
def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text they decode to, as digests."""
    return digests(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op1_quality_rules")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, by rules learnt from labels that are not held out."""
    docs, out = read(spark, sf_dir, "documents"), held_out(3, 1)
    model = quality_rules.train(docs, read(spark, sf_dir, "labels").where(~out))
    return quality_rules.score(docs.select("doc_id", "text"), model).select(
        "doc_id", out.alias("held_out"), "score", "predicted")


@query("op7_token_store")
def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written as compressed blocks and read back."""
    docs = read(spark, sf_dir, "documents")
    return token_store.ids_crc32(token_store.round_trip(
        docs, vocabulary("word_bpe_49k.json"), end_id=2))


@query("op10_license_rules")
def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in the documents."""
    return scan_licenses(read(spark, sf_dir, "documents"))


@query("op2_bloom_lm")
def op2_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document, learnt from those that are not held out."""
    docs, out = read(spark, sf_dir, "documents"), held_out(5, 1)
    return bloom_lm.score(docs, docs.where(~out)).select(
        "doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that occur more than once."""
    return mark_repeats(read(spark, sf_dir, "documents"))


@query("op12_conversation_trie", """
    WITH RECURSIVE said AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
        FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (
        SELECT conv_id, conv_id - conv_id % 100 AS head,
               xor(list_reduce(list_transform(range(1, len(conv_id::VARCHAR) + 1),
                                              lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT),
                               lambda crc, b: list_reduce(range(8),
                                   lambda c, k: xor(c >> 1, (c & 1) * 3988292384), xor(crc, b)),
                               4294967295::BIGINT), 4294967295::BIGINT) % 6 AS h
        FROM (SELECT DISTINCT conv_id FROM said)),
    rebuilt AS (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS pos, role, text
        FROM (SELECT c.conv_id, 0 AS own, s.pos, s.role, s.text
              FROM convs c JOIN said s ON s.conv_id = c.head AND s.pos <= c.h
              UNION ALL
              SELECT c.conv_id, 1, s.pos, s.role, s.text
              FROM convs c JOIN said s ON s.conv_id = c.conv_id AND s.pos > c.h)),
    keyed AS (  -- the digest of a prefix from that of the prefix before it
        SELECT c.conv_id, 0::BIGINT AS pos, 'root' AS node, NULL::VARCHAR AS parent, 0::BIGINT AS chars FROM convs c
        UNION ALL
        SELECT k.conv_id, r.pos, sha256(k.node || len(r.role)::VARCHAR || ':' || r.role || r.text), k.node, len(r.text)
        FROM keyed k JOIN rebuilt r ON r.conv_id = k.conv_id AND r.pos = k.pos + 1),
    nodes AS (
        SELECT node, any_value(parent) AS parent, min(conv_id) AS conv_id, any_value(pos) AS depth,
               count(*) AS n_convs, any_value(chars) AS chars FROM keyed GROUP BY node),
    kids AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
    up AS (
        SELECT n.node AS top, n.node, n.parent, CASE WHEN k.n IS NULL THEN 1 ELSE 0 END AS leaf,
               (n.n_convs - 1) * n.chars AS saved
        FROM nodes n LEFT JOIN kids k USING (node)
        UNION ALL
        SELECT p.node, u.node, p.parent, u.leaf, u.saved FROM up u JOIN nodes p ON p.node = u.parent),
    totals AS (SELECT top AS node, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY top),
    ends AS (
        SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
        FROM keyed k WHERE pos = (SELECT count(*) FROM rebuilt r WHERE r.conv_id = k.conv_id) GROUP BY node)
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children,
           t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens,
           sha256(coalesce(e.ids, '')) AS ends_sha256
    FROM nodes n JOIN totals t USING (node) LEFT JOIN kids k USING (node)
    LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN ends e ON e.node = n.node""")
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations, with totals of its subtree."""
    return conversation_trie(read(spark, sf_dir, "conversations"))


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every usable vector on the sixteen largest components."""
    return whiten(read(spark, sf_dir, "embeddings"))


@query("op13_relative_lz", """
    WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                                          lambda w: w <> '') AS w FROM documents),
    places AS (SELECT doc_id, pos, array_to_string(list_slice(w, pos, pos + 49), ' ') AS s
               FROM d, unnest(range(1, len(w) - 48)) AS t(pos) WHERE len(w) >= 50),
    firsts AS (SELECT s, min(doc_id) AS first FROM places GROUP BY s),
    gone AS (SELECT DISTINCT doc_id, q FROM places JOIN firsts USING (s), unnest(range(pos, pos + 50)) AS t(q)
             WHERE doc_id > first),
    lists AS (SELECT doc_id, list(q) AS gone FROM gone GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
           sha256(array_to_string(list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256
    FROM d LEFT JOIN lists USING (doc_id)""")
def op13_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier document holds."""
    return remove_repeats(read(spark, sf_dir, "documents"))
