"""Benchmark decontamination with a distributed positional inverted index (DataFrame functions only).

The windows of the benchmark are the queries.  Of each window the ``PROBES`` terms that are rarest
in the documents are looked up: the index holds a posting (document, term, position) for every
occurrence of such a term.  The postings of the rarest term, shifted by its offset in the window, are
the candidates; each is looked up in the lists of the next terms, so a frequent term is only met where
the rarer ones already agree.  What is left is compared with the document's words, which makes the
phrase match exact.

Memory and skew: words are exploded without any text beside them; survivors meet their documents in
blocks, so no row carries a whole document; a term is counted by map-side partials; all joins of
postings are keyed by document, term and position, so no frequent term gathers in one task.  The small
tables of terms are written first: Spark broadcasts one only where its size is below the session's
threshold, and shuffles it beyond.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.session import materialize

#: Terms of a window whose posting lists are intersected.
PROBES = 3
#: Words of a block that survivors are compared with; ``window - 1`` more follow.
BLOCK = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words between ASCII characters that are neither letter nor digit."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN)
    return F.array_remove(parts, "")


def _key() -> Column:
    """Rows of equal identifier and text get equal results, so they share a key."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"),
                                  F.coalesce("text", F.lit(""))).cast("binary")))


def _window_id(words: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(" ", words).cast("binary")))


def benchmark_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, window_id, words): every run of ``window`` words; a shorter item is one window."""
    cut = (items.where(F.col("item_id").isNotNull())
           .select("item_id", words_of(F.col("text")).alias("all"))
           .where(F.size("all") > 0)
           .withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(
               F.size("all") - (window - 1), F.lit(1)))))
           .select("item_id", F.slice("all", F.col("at"), window).alias("words")).distinct())
    return cut.withColumn("window_id", _window_id(F.col("words")))


def probes(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_id, length, rarest): the ``PROBES`` rarest terms of each window, rarest first.

    ``rarest`` has (n, term, offset); a window of fewer distinct terms repeats its last.
    """
    distinct = windows.select("window_id", "words").distinct()
    terms = (distinct.select("window_id", F.size("words").alias("length"),
                             F.posexplode("words").alias("offset", "term"))
             .groupBy("window_id", "length", "term").agg(F.min("offset").alias("offset")))
    vocabulary = materialize(terms.select("term").distinct(), "benchmark-terms")
    counts = (docs.select(F.explode(words_of(F.col("text"))).alias("term"))
              .join(vocabulary, "term", "left_semi")
              .groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    entry = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset")
    ranks = F.array(*map(F.lit, range(PROBES)))
    return (terms.join(counts, "term", "left").groupBy("window_id", "length")
            .agg(F.sort_array(F.collect_list(entry)).alias("all"))  # <= window terms
            .select("window_id", "length", F.transform(
                ranks, lambda r: F.get("all", F.least(r, F.size("all") - 1))).alias("rarest")))


def phrase_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored postings (key, term, position, ranks) of the given (term, ranks)."""
    postings = (docs.select(_key().alias("key"), F.posexplode(words_of(F.col("text"))).alias("position", "term"))
                .join(terms, "term").select("key", "term", "position", "ranks"))
    return materialize(postings, "postings")


def _blocks(docs: DataFrame, keys: DataFrame, window: int) -> DataFrame:
    """(key, block, run): the words of the documents of ``keys`` from word ``block * BLOCK`` on."""
    words = (docs.select(_key().alias("key"), "text").join(keys, "key", "left_semi")
             .select("key", words_of(F.col("text")).alias("all")))
    return (words.select("key", "all", F.explode(F.sequence(
                F.lit(0).cast("long"), F.floor(F.greatest(F.size("all") - 1, F.lit(0)) / BLOCK))).alias("block"))
            .select("key", "block", F.slice(
                "all", (F.col("block") * BLOCK + 1).cast("int"), BLOCK + window - 1).alias("run")))


def find_windows(docs: DataFrame, windows: DataFrame, window: int, slop: int = 0) -> DataFrame:
    """(key, window_id, start, length, kind): places where windows occur in documents.

    ``kind`` is ``phrase`` for an exact match.  With ``slop`` above 0 a place where the probed terms
    stand within ``slop`` words of where the phrase has them is returned too, as ``proximity``.
    """
    probed = materialize(probes(docs, windows), "probes")
    terms = materialize(probed.select(F.posexplode("rarest.term").alias("rank", "term"))
                        .groupBy("term").agg(F.collect_set("rank").alias("ranks")), "terms")
    index = phrase_index(docs, terms)

    def list_of(rank: int) -> DataFrame:
        return index.where(F.array_contains("ranks", rank)).select("key", "term", "position")

    def entry(rank: int) -> Column:
        return F.get("rarest", F.lit(rank))

    found = (list_of(0).join(probed.withColumn("term", entry(0)["term"]), "term")
             .withColumn("start", F.col("position") - entry(0)["offset"])
             .where((F.col("start") >= 0) | F.lit(slop > 0))
             .select("key", "window_id", "length", "rarest", "start"))
    width, reach = slop + 1, (-1, 0, 1) if slop else (0,)
    for rank in range(1, PROBES):
        wanted = found.withColumn("at", F.col("start") + entry(rank)["offset"]).select(
            "*", entry(rank)["term"].alias("term"), F.floor(F.col("at") / width).alias("bin")).alias("w")
        bins = F.array(*[F.floor(F.col("position") / width) + i for i in reach])
        posts = list_of(rank).withColumn("bin", F.explode(bins)).alias("p")
        same = [F.col(f"w.{c}") == F.col(f"p.{c}") for c in ("key", "term", "bin")]
        close = F.abs(F.col("w.at") - F.col("p.position")) <= slop
        found = wanted.join(posts, same[0] & same[1] & same[2] & close, "left_semi").drop("at", "term", "bin")
    left = materialize(found.select("key", "window_id", "length", "start").distinct(), "candidates")
    keys = materialize(left.select("key").distinct(), "candidate-documents")
    # the identifier of a window is the digest of its words
    run = F.slice("run", F.greatest(F.col("start") - F.col("block") * BLOCK, F.lit(0)).cast("int") + 1,
                  F.col("length"))
    exact = F.coalesce((_window_id(run) == F.col("window_id")) & (F.col("start") >= 0), F.lit(False))
    out = (left.withColumn("block", F.floor(F.col("start") / BLOCK))
           .join(_blocks(docs, keys, window), ["key", "block"], "left")
           .select("key", "window_id", "start", "length",
                   F.when(exact, "phrase").otherwise("proximity").alias("kind")).distinct())
    return out if slop else out.where(F.col("kind") == "phrase")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, percent: int = 5) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated added, row by row.

    A word inside any occurrence of a window is hit; a document is contaminated if some word is hit
    and at least ``percent`` of its words are.  A null or empty text has no words.  Items without
    an identifier or without words match nothing; items that repeat an identifier are one item.
    Columns of the added names are replaced, all others pass through.  Empty tables give no rows, or
    rows without hits.
    """
    added = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "_key"]
    docs = docs.drop(*added)
    texts = docs.select("doc_id", "text")
    windows = materialize(benchmark_windows(items, window), "windows")
    places = materialize(find_windows(texts, windows, window), "places")
    hits = (places.groupBy("key", "start").agg(F.max("length").alias("length"))
            .select("key", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("at"))
            .distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_hit")))
    ids = (places.select("key", "window_id").distinct()
           .join(windows.select("window_id", F.col("item_id").cast("string").alias("item")), "window_id")
           .groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items")))
    marked = materialize(hits.join(ids, "key").withColumnRenamed("key", "_key"), "marked")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    found = F.coalesce("items", F.array().cast("array<string>"))
    rows = docs.withColumn("_key", _key()).withColumn("n_words", F.size(words_of(F.col("text"))).cast("long"))
    return rows.join(marked, "_key", "left").select(
        *docs.columns, "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(found, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 100 >= F.col("n_words") * percent)).alias("contaminated"))
