"""Vector scalars over array<double>; sums run left to right, so other engines give the same value after rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def text_similarity(a: Column, b: Column, dims: int = 32) -> Column:
    """Inner product of two texts' embeddings, 6 decimals."""
    return F.round(dot(hashed_embedding(a, dims), hashed_embedding(b, dims)), 6)


def hashed_embedding(text: Column, dims: int = 32) -> Column:
    """A deterministic stand-in for a model: word counts hashed by md5 to `dims` columns, L2-normalised."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")
    slots = F.transform(words, lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint"), F.lit(dims)))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    length = norm(raw)
    return F.when(length == 0, raw).otherwise(F.transform(raw, lambda x: x / length))
