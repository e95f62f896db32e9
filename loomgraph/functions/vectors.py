"""Vector column functions: cosine, drift similarity, JSON form of a vector."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, on_mismatch: float | None = 0.0) -> Column:
    """Cosine of two vectors; a zero vector gives 0, unequal lengths give ``on_mismatch``."""
    scale = norm(a) * norm(b)
    same = F.when(scale == 0.0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), scale))
    return (F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
            .when(F.size(a) != F.size(b), F.lit(on_mismatch).cast("double")).otherwise(same))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - cosine(a, b)


def drift_similarity(story: Column, response: Column) -> Column:
    """Cosine, or NULL (no check) when a vector is missing, empty or of another length."""
    usable = (F.size(story) > 0) & (F.size(response) > 0)
    return F.when(usable, cosine(story, response, on_mismatch=None))


def encode_vec(vec: Column) -> Column:
    return F.to_json(vec)


def decode_vec(text: Column) -> Column:
    """NULL for text that is no array of numbers; such rows are skipped, never an error."""
    vec = F.from_json(text, "array<double>")
    return F.when(F.size(vec) > 0, F.when(~F.exists(vec, lambda x: x.isNull()), vec))
