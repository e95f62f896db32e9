"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; its result is written
as Parquet and read again as the next one's input.  Every stage but the last returns the columns of
``documents``; the last adds the token ids.

Null texts and texts without a letter go in the first stage.  Rows equal in identifier and text
count as one document from the second on; of such rows the one with the greatest other columns
stays.  Empty tables give no rows; further columns pass through.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomgraph.llm.decontamination import decontaminate
from loomgraph.llm.exact_dedup import exact_duplicates
from loomgraph.llm.jaccard_join import jaccard_components
from loomgraph.llm.language_id import held_out, identify
from loomgraph.llm.piece_codec import encode_and_decode
from loomgraph.session import materialize, tune


def _sha() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def _keep(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, sha) is in ``kept``, one each."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    left, right = docs.withColumn("_sha", _sha()).alias("l"), kept.select("doc_id", "sha").alias("r")
    found = left.join(right, F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))
                      & (F.col("l._sha") == F.col("r.sha")), "left_semi")
    one = found.groupBy("doc_id", "_sha").agg(
        F.max("text").alias("text"), F.max(F.struct(F.lit(0).alias("_"), *rest)).alias("rest"))
    return one.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"rest.{c}").alias(c)
                        for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language: a null text, or one without any letter.

    Where no row says its language nothing can be learnt; then, too, texts with letters stay.
    """
    found = identify(docs, docs.where(~held_out(5, 0)).select("text", "lang"))
    return found.where((F.col("lang_pred") != "und") | F.rlike("text", F.lit(r"\p{L}"))).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest identifier stays."""
    kept = exact_duplicates(docs, keep="largest").where("kept")
    return _keep(docs, kept.select("doc_id", F.col("text_sha256").alias("sha")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest identifier stays."""
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", _sha().alias("sha"))
    groups = jaccard_components(docs.select(name.alias("doc_id"), "text"))
    kept = groups.where(F.col("doc_id") == F.col("component_id"))
    return _keep(docs, kept.select("doc_id.doc_id", "doc_id.sha").distinct())


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents contaminated with benchmark passages."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, items).where(~F.col("contaminated")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the ids, their number, and the digest of the text they decode to."""
    import public_tokenizers
    return (encode_and_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
            .withColumn("n_tokens", F.size("ids").cast("long"))
            .withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("clean", clean),
          ("tokens", tokens)]

#: SQL has no SentencePiece encoder; tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
