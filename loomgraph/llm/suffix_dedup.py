"""Repeated passages by sparse suffixes, exact for every window.

Each window of ``min_words`` words is named by the first of its smallest-hashed ``K``-word pieces, so
equal windows hold the same piece at the same offset.  Consecutive windows with one such place form a
run.  Runs found more than once, in whole, are marked.  Where a piece stands in several different
runs, the windows of each such run are counted by their hash, one copy of a run with the number of its
places, and the windows found more than once are marked.  So every repeated window is found however
many places a piece has, and no task needs all places of a piece at once.

Windows are told apart by two 64-bit hashes, of their words and of their piece.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.llm.kernel import as_long, mix, ngrams, powers, text_chunks, words
from loomgraph.session import materialize

K = 8


def _key() -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"),
                                  F.coalesce("text", F.lit(""))).cast("binary")))


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """Where the smallest hash (the first of equals) of each ``window`` consecutive hashes is."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    best = np.arange(len(grams))
    span = 1
    while span < window:  # doubling: best of [i, i + span)
        step = min(span, window - span)
        left, right = best[:-step], best[step:]
        best = np.where(grams[right] < grams[left], right, left)
        span += step
    return best


def _runs(docs: DataFrame, min_words: int) -> DataFrame:
    """(key, low, size, piece, run): windows ``low`` up to ``low + size`` of a text share a piece's place."""
    def run(batches):
        for batch in batches:
            for chunk in text_chunks(batch["text"]):
                found = words(chunk)
                h, n = found.hashes, len(found.hashes)
                if n < min_words:
                    continue
                grams = ngrams(h, K)
                best = minimisers(grams, min_words - K + 1)
                at = np.flatnonzero(found.docs[:n - min_words + 1] == found.docs[min_words - 1:])
                if not len(at):
                    continue
                place = best[at]
                first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                size = np.diff(np.append(first, len(at)))
                low, place = at[first], place[first]
                up, down = powers(n + 1)
                sums = np.zeros(n + 1, np.uint64)
                np.cumsum(h * up[:-1], out=sums[1:])
                end = low + size - 1 + min_words
                whole = mix((sums[end] - sums[low]) * down[low] + (end - low).astype(np.uint64))
                whole = mix(whole + (place - low).astype(np.uint64))
                doc = found.docs[low]
                yield pa.RecordBatch.from_arrays(
                    [batch["key"].take(pa.array(chunk.first + doc)), pa.array((low - found.bounds[doc]).astype(np.int32)),
                     pa.array(size.astype(np.int32)), as_long(grams[place]), as_long(whole)],
                    ["key", "low", "size", "piece", "run"])

    return docs.mapInArrow(run, "key binary, low int, size int, piece long, run long")


def _windows(rows: DataFrame, min_words: int) -> DataFrame:
    """(key, at, piece, hash, n): each window of the runs in ``kept``."""
    def run(batches):
        for batch in batches:
            for chunk in text_chunks(batch["text"]):
                found = words(chunk)
                hashes = ngrams(found.hashes, min_words)
                kept = batch["kept"].slice(chunk.first, chunk.last - chunk.first)
                doc = np.repeat(np.arange(len(kept)), kept.value_lengths().to_numpy())
                low, size, piece, n = (kept.flatten().field(c).to_numpy() for c in ("low", "size", "piece", "n"))
                for part in range(0, len(doc), 4096):
                    some = slice(part, part + 4096)
                    back = np.repeat(np.arange(len(doc[some])), size[some])
                    step = np.arange(len(back)) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
                    at = low[some][back].astype(np.int64) + step
                    yield pa.RecordBatch.from_arrays(
                        [batch["key"].take(pa.array(chunk.first + doc[some][back])), pa.array(at.astype(np.int32)),
                         pa.array(piece[some][back]), as_long(hashes[found.bounds[doc[some][back]] + at]), pa.array(n[some][back])],
                        ["key", "at", "piece", "hash", "n"])

    return rows.mapInArrow(run, "key binary, at int, piece long, hash long, n long")


def repeated_spans(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(key, first, last): word ranges that occur elsewhere too, joined where they touch."""
    rows = docs.select(_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    # rows equal in identifier and text share a key, but each counts as a copy
    placed = materialize(_runs(rows, min_words), "runs")
    kinds = materialize(placed.groupBy("piece", "run").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "low", "size")).alias("one")), "run-kinds")
    often = kinds.where("n > 1").select("piece", "run")
    whole = placed.join(often, ["piece", "run"], "left_semi").select(
        "key", F.col("low").alias("first"), (F.col("low") + F.col("size") - 1 + min_words).alias("last"))
    mixed = kinds.groupBy("piece").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("piece")
    kept = (kinds.join(mixed, "piece", "left_semi").groupBy("one.key")
            .agg(F.collect_list(F.struct("one.low", "one.size", "piece", "n")).alias("kept")))  # at most a text's runs
    windows = materialize(_windows(rows.join(kept, "key").dropDuplicates(["key"]), min_words), "windows")
    met = windows.groupBy("piece", "hash").agg(F.sum("n").alias("all")).where("all > 1").select("piece", "hash")
    # runs with n > 1 are marked in whole
    single = windows.where("n = 1").join(met, ["piece", "hash"], "left_semi").select(
        "key", F.col("at").alias("first"), (F.col("at") + min_words).alias("last"))
    spans = materialize(whole.union(single), "marks").select(
        "key", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))
    by_start = Window.partitionBy("key").orderBy("first", "last")
    reach = F.max("last").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("first") <= reach, 0).otherwise(1)
    return (spans.distinct().withColumn("fresh", fresh).withColumn("part", F.sum("fresh").over(by_start))
            .groupBy("key", "part").agg(F.min("first").alias("first"), F.max("last").alias("last"))
            .drop("part"))


def mark_repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, n_repeated, n_spans, spans): one row per row of ``docs``.

    ``spans`` lists word ranges ``first-last`` (``last`` excluded) of passages of at least
    ``min_words`` words that occur at another place, of this or another document.  Words are split at
    blanks, A-Z in lower case.  Null, empty and shorter texts have none.  Rows equal in
    identifier and text count as copies of each other; other columns are ignored; no rows, no rows.
    """
    if min_words < K:
        raise ValueError(f"min_words is at least {K}")
    spans = (repeated_spans(docs, min_words).groupBy("key")
             .agg(F.sum(F.col("last") - F.col("first")).alias("n_repeated"),
                  F.count(F.lit(1)).alias("n_spans"),
                  F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans")))
    zero = F.lit(0).cast("long")
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["first"], s["last"])), ",")
    return docs.select("doc_id", _key().alias("key")).join(spans, "key", "left").select(
        "doc_id", F.coalesce("n_repeated", zero).alias("n_repeated"),
        F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce(text, F.lit("")).alias("spans"))
