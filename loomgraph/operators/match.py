"""First-match regex binding, reuse coverage and the step resolution cascade.

A regex join compares every text with every definition.  Here the literal pieces that a definition's
matches must contain are looked up in postings (piece, key of a text): the list of its rarest piece,
intersected with those of the next ones unless it is short.  Pieces of long literals are long, so that
their lists do not grow with the number of texts that share some characters.  Postings and candidates are numbers and pieces only; a text
is fetched by its key for the candidates that are left, and the regex only runs on those.
Definitions without such a piece go through the block grid, which is exact too and keeps every task
bounded.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import patterns
from loomgraph.functions.text import (DEFINITION_PREFIX, content_id, normalise_step,
                                      ratio_or_one)
from loomgraph.operators.grid import grid_apply
from loomgraph.operators.nearest import closest_definition
from loomgraph.session import materialize, spread

ORDER = ("definition_id",)
MIN_SIMILARITY = 0.6  # fixed value: least similarity of a close match
LISTS = 3  # postings intersected for one definition at most; the regex decides in the end
FEW = 16  # texts of a list that go to the regex without another list


def vet_patterns(defs: DataFrame) -> DataFrame:
    """Definitions with ``reason`` (why the regex is unusable, NULL = valid) and literal ``grams``."""
    schema = T.StructType(defs.schema.fields + [
        T.StructField("reason", T.StringType()),
        T.StructField("grams", T.ArrayType(T.StringType()))])
    return defs.mapInPandas(patterns.vet, schema)


def valid_patterns(defs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable definitions, quarantined ones with the reason)."""
    vetted = vet_patterns(defs).drop("grams")
    return (vetted.where("reason IS NULL").drop("reason"), vetted.where("reason IS NOT NULL"))


def _residual(anchor: str):
    @F.pandas_udf("boolean")
    def match(expression: pd.Series, raw: pd.Series, clean: pd.Series) -> pd.Series:
        return patterns.match_pairs(anchor, expression, raw, clean)
    return match


def prepare_definitions(defs: DataFrame, order_by: tuple[str, ...] = ORDER) -> DataFrame:
    """Usable definitions with their rank and literal grams, written down for repeated matching."""
    rank = F.struct(*[F.col(c) for c in order_by], *[F.col(c) for c in ORDER if c not in order_by])
    # parsing regexes is CPU work on a small table: hand every core a share of it
    shares = int(defs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = defs.select("definition_id", "expression", rank.alias("rank"))
    vetted = vet_patterns(ranked.repartition(shares, "definition_id"))
    return materialize(vetted.where("reason IS NULL").drop("reason"), "vetted_defs")


def first_match(texts: DataFrame, defs: DataFrame, anchor: str = "none", normalise: bool = False,
                order_by: tuple[str, ...] = ORDER, block_rows: int = 4096) -> DataFrame:
    """(text, definition_id) of the first matching definition, for the distinct texts that have one.

    ``anchor='start'``: the match must begin at the text's start; ``'none'``: anywhere.
    ``normalise``: the normalised text counts as well as the raw one.
    ``order_by``: definition columns that say which definition comes first.
    ``defs`` may be the result of ``prepare_definitions``, which has that order built in.
    """
    if anchor not in ("start", "none"):
        raise ValueError(f"unknown anchor: {anchor}")
    vetted = defs if "grams" in defs.columns else prepare_definitions(defs, order_by)
    clean = normalise_step(F.col("text")) if normalise else F.lit(None).cast("string")
    plain = materialize(
        texts.select("text").where("text IS NOT NULL").dropDuplicates()
        .select(F.monotonically_increasing_id().alias("key"), "text", clean.alias("clean")), "distinct_texts")

    blockable = vetted.where(F.size("grams") > 0)
    found = candidates(postings(plain, blockable), blockable)
    tried = (found.join(blockable.select("definition_id", "expression", "rank"), "definition_id")
             .join(plain, "key").where(_residual(anchor)("expression", "text", "clean")))
    matched = tried.groupBy("key").agg(F.min("rank").alias("rank"))

    unblocked = vetted.where(F.size("grams") == 0).drop("grams")
    n_unblocked = unblocked.count()
    if n_unblocked:
        rest = _grid_match(plain, unblocked, anchor, n_unblocked, block_rows)
        matched = (matched.unionByName(rest).groupBy("key").agg(F.min("rank").alias("rank")))
    return plain.select("key", "text").join(matched, "key").select(
        "text", F.col("rank.definition_id").alias("definition_id"))


def postings(plain: DataFrame, blockable: DataFrame) -> DataFrame:
    """(gram, key), stored: which texts (key, text) hold the pieces that some definition needs."""
    wanted = blockable.select(F.explode("grams").alias("gram")).dropDuplicates()
    lengths = [r.n for r in wanted.select(F.char_length("gram").alias("n")).distinct().collect()]  # GRAM, LONG
    pieces = [patterns.text_grams(F.col("text"), n) for n in lengths or [patterns.GRAM]]
    held = spread(plain.select("key", "text")).select(F.explode(F.concat(*pieces)).alias("gram"), "key")
    return materialize(held.join(wanted, "gram", "left_semi"), "postings")


def candidates(index: DataFrame, blockable: DataFrame) -> DataFrame:
    """(definition_id, key): texts that hold the rarest pieces of a definition, up to ``LISTS`` of them.

    A piece that no text holds rules its definitions out; a list of ``FEW`` texts is not cut down further.
    """
    lengths = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    needs = (blockable.select("definition_id", F.explode("grams").alias("gram"))
             .join(lengths, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))))
    # a definition has at most as many pieces as its expression has characters
    lists = (needs.groupBy("definition_id").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("lists"))
             .where(F.col("lists")[0]["n"] > 0))
    lists = materialize(lists.select("definition_id", F.col("lists")[0]["gram"].alias("gram0"), *[
        F.when(F.col("lists")[0]["n"] > FEW, F.get("lists", F.lit(i))["gram"]).alias(f"gram{i}")
        for i in range(1, LISTS)]), "posting-lists")
    found = index.join(lists.withColumnRenamed("gram0", "gram"), "gram").drop("gram")
    for i in range(1, LISTS):
        # piece and key together: no list is ever in one task as a whole
        used = lists.select(F.col(f"gram{i}").alias("gram")).where("gram IS NOT NULL").dropDuplicates()
        more = index.join(used, "gram", "left_semi").select(
            F.col("gram").alias(f"gram{i}"), "key", F.lit(True).alias("_held"))
        found = (found.join(more, [f"gram{i}", "key"], "left")
                 .where(F.col("_held") | F.col(f"gram{i}").isNull()).drop("_held", f"gram{i}"))
    return found.select("definition_id", "key")


def _grid_match(plain: DataFrame, defs: DataFrame, anchor: str, n_defs: int, block_rows: int):
    """First match among definitions that have no literal piece to block on."""
    order = [f"_r{i}" for i in range(len(defs.schema["rank"].dataType.fields))]
    flat = defs.select("definition_id", "expression", "rank.*").toDF(
        "definition_id", "expression", *order)

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ordered = right.sort_values(order, na_position="first")
        tries = [(d, patterns.finder(e, anchor))
                 for d, e in zip(ordered["definition_id"], ordered["expression"])]
        out = []
        for key, text, clean in zip(left["key"], left["text"], left["clean"]):
            first = next((d for d, find in tries if patterns.hits(find, text, clean)), None)
            if first is not None:
                out.append((key, first))
        return pd.DataFrame(out, columns=["key", "definition_id"])

    found = grid_apply(plain, flat, "key", "definition_id", kernel,
                       "key long, definition_id string", plain.count(), n_defs, block_rows)
    return found.join(defs.select("definition_id", "rank"), "definition_id").select("key", "rank")


def bind(steps: DataFrame, defs: DataFrame, anchor: str = "none", normalise: bool = False,
         order_by: tuple[str, ...] = ORDER) -> DataFrame:
    """Steps with the ``definition_id`` of their first match, NULL without one."""
    return steps.join(first_match(steps, defs, anchor, normalise, order_by), "text", "left")


def reuse_coverage(steps: DataFrame, defs: DataFrame, by: list[str] | None = None,
                   order_by: tuple[str, ...] = ORDER) -> DataFrame:
    """(matched, total, coverage) of step lines; repeated lines count, no lines give 1.0.

    Lines are counted per text before the join, so one text repeated very often is one row in it.
    """
    by = by or []
    lines = steps.groupBy(*by, "text").agg(F.count(F.lit(1)).alias("n"))
    found = first_match(steps, defs, "none", True, order_by).withColumn("hit", F.lit(1))
    sums = lines.join(found, "text", "left").groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("matched"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return sums.withColumn("coverage", ratio_or_one(F.col("matched"), F.col("total")))


def resolve_steps(steps: DataFrame, graph_steps: DataFrame, binds: DataFrame, defs: DataFrame,
                  min_similarity: float = MIN_SIMILARITY,
                  order_by: tuple[str, ...] = ORDER) -> DataFrame:
    """(step_id, action, definition_id, similarity) per step node (step_id, text, embedding).

    REUSE: a definition's regex matches.  EXPAND: none does, but the nearest bound step reaches
    ``min_similarity``.  GENERATE: neither.
    """
    found = first_match(steps, defs, "none", True, order_by)
    looked_up = materialize(steps.select("step_id", "text", "embedding")
                            .join(found, "text", "left"), "looked_up_steps")
    reuse = looked_up.where("definition_id IS NOT NULL").select(
        "step_id", F.lit("REUSE").alias("action"), "definition_id",
        F.lit(None).cast("double").alias("similarity"))
    rest = looked_up.where("definition_id IS NULL").select("step_id", "embedding")
    near = closest_definition(
        rest.select(F.col("step_id").alias("query_id"), "embedding"), graph_steps, binds, defs
    ).select(F.col("query_id").alias("step_id"), F.col("definition_id").alias("near"), "similarity")
    close = F.coalesce("similarity", F.lit(0.0)) >= min_similarity
    other = rest.select("step_id").join(near, "step_id", "left").select(
        "step_id", F.when(close, F.lit("EXPAND")).otherwise(F.lit("GENERATE")).alias("action"),
        F.when(close, F.col("near")).alias("definition_id"),
        F.when(close, F.col("similarity")).alias("similarity"))
    return reuse.unionByName(other)


def generated_definitions(resolved: DataFrame, steps: DataFrame, escape: bool = False) -> DataFrame:
    """Definition nodes for GENERATE steps; the step text is the regex (``escape`` quotes it)."""
    special = F.regexp_replace("text", r"([\\.^$|?*+(){}\[\]])", r"\\$1")
    return (steps.join(resolved.where("action = 'GENERATE'").select("step_id"), "step_id", "left_semi")
            .select(content_id(F.col("text"), DEFINITION_PREFIX).alias("definition_id"),
                    (special if escape else F.col("text")).alias("expression"))
            .dropDuplicates(["definition_id"]))


def phrase_lines(steps: DataFrame) -> DataFrame:
    """Reusable phrases, one ``- type text`` line per step node."""
    return steps.select("step_id", F.concat(F.lit("- "), F.col("step_type"), F.lit(" "),
                                            F.col("text")).alias("line"))
