"""Vector and class-probability functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null when either vector has no length."""
    norm = l2_norm(a) * l2_norm(b)
    return F.when(norm > 0, dot(a, b) / norm)


def _valid(p: Column) -> Column:
    return F.size(p) >= 2


def max_prob(p: Column) -> Column:
    return F.when(_valid(p), F.array_max(p))


def least_confidence(p: Column) -> Column:
    return F.when(_valid(p), F.lit(1.0) - F.array_max(p))


def margin(p: Column) -> Column:
    """Gap between the two largest probabilities."""
    s = F.sort_array(p, asc=False)
    return F.when(_valid(p), s[0] - s[1])


def entropy(p: Column) -> Column:
    """Base-2 entropy; a zero probability contributes nothing."""
    terms = F.transform(p, lambda v: F.when(v > 0, -v * F.log2(v)).otherwise(F.lit(0.0)))
    return F.when(_valid(p), F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v))


def variance(p: Column) -> Column:
    """Population variance."""
    n = F.size(p)
    mean = F.aggregate(p, F.lit(0.0), lambda acc, v: acc + v) / n
    return F.when(_valid(p), F.aggregate(p, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean)) / n)
