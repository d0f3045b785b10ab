"""Vector arithmetic as columns over array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products; the shorter length wins."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for null, empty or zero vectors."""
    size = norm(a) * norm(b)
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0))


def hash_embedding(text: Column, dim: int) -> Column:
    """Bag-of-tokens vector from token digests, L2-normalised; each token is hashed once."""
    tokens = F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")
    at = lambda d, start: F.conv(F.substring(d, start, 8), 16, 10).cast("long") % dim
    places = F.transform(F.transform(tokens, lambda t: F.sha2(t, 256)), lambda d: F.struct(at(d, 1).alias("up"), at(d, 9).alias("down")))

    def add(total: Column, p: Column) -> Column:
        return F.transform(total, lambda x, i: x + (i == p["up"]).cast("double") - (i == p["down"]).cast("double"))

    return F.aggregate(places, F.array_repeat(F.lit(0.0), dim), add, lambda raw: F.transform(raw, lambda x: F.when(norm(raw) > 0, x / norm(raw)).otherwise(F.lit(0.0))))
