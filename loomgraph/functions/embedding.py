"""The embedding stage: text to vector for a whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 768  # fixed value: vector size of generated embeddings


def embed(df: DataFrame, text_col: str, fn: Callable[[list[str]], list[list[float]]] | None = None,
          dims: int = DIMENSIONS) -> DataFrame:
    """Add ``embedding array<double>``.

    ``fn`` maps a batch of texts to vectors (a model client, say) and runs in Arrow batches;
    without it, hashed term counts weighted by IDF and scaled to length 1.
    """
    if fn is None:
        return _hashed(df, text_col, dims)
    schema = T.StructType(df.schema.fields + [T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for pdf in batches:
            vectors = fn(pdf[text_col].tolist())
            out = pdf.copy()
            out["embedding"] = [None if v is None else [float(x) for x in v] for v in vectors]
            yield out

    return df.mapInPandas(run, schema)


def _hashed(df: DataFrame, text_col: str, dims: int) -> DataFrame:
    stages = [
        RegexTokenizer(inputCol="_text", outputCol="_tokens", pattern=r"(?U)[^\w]+"),
        HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=dims),
        IDF(inputCol="_counts", outputCol="_weights"),
        Normalizer(inputCol="_weights", outputCol="_vector", p=2.0),
    ]
    source = df.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    vectors = Pipeline(stages=stages).fit(source).transform(source)
    return vectors.select(*df.columns, vector_to_array("_vector").alias("embedding"))
