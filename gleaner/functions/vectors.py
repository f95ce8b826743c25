"""Vector expressions on array columns; all arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(doubles(a), 1, n), F.slice(doubles(b), 1, n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Lenient: vectors are cut to the shorter for the product, and a zero norm gives 0."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def strict_cosine(a: Column, b: Column) -> Column:
    """Strict: different lengths and zero norms raise."""
    scale = norm(a) * norm(b)
    return (
        F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double"))
        .when(scale == 0, F.raise_error(F.lit("a vector has norm 0")).cast("double"))
        .otherwise(dot(a, b) / scale)
    )


def l2_normalize(v: Column, zero_as_one: bool = True) -> Column:
    """Divide by the norm; zero_as_one leaves a zero vector as it is, else it turns to nulls."""
    n = norm(v)
    safe = F.when(n == 0, F.lit(1.0) if zero_as_one else F.lit(None)).otherwise(n)
    return F.transform(doubles(v), lambda x: x / safe)


def chunks(v: Column, width: int, parts: int) -> Column:
    """Reshape a flat vector into rows of width."""
    return F.array(*[F.slice(doubles(v), 1 + k * width, width) for k in range(parts)])


def maxsim(query: Column, doc: Column) -> Column:
    """Late interaction: for each query row the best cosine among the document's rows, averaged over the query rows."""
    best = F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: cosine(q, d))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(query)


def sparse_dot(q: Column, d: Column) -> Column:
    """Sum over shared keys of the product of two maps' weights."""
    return F.aggregate(F.map_keys(q), F.lit(0.0), lambda s, k: s + q[k] * F.coalesce(F.try_element_at(d, k), F.lit(0.0)))


def similarity_band(score: Column) -> Column:
    return F.when(score > 0.8, "very similar").when(score > 0.5, "somewhat similar").otherwise("low similarity")
