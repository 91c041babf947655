"""Vector functions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, v: s + v * v))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def maxsim(query: Column, document: Column) -> Column:
    """Mean over the query's vectors of the largest cosine with the document's."""
    best = F.transform(query, lambda q: F.array_max(F.transform(document, lambda d: cosine(q, d))))
    return F.aggregate(best, F.lit(0.0), lambda s, v: s + v) / F.size(best)


def sparse_dot(a: Column, b: Column) -> Column:
    """Of two maps from token to weight."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.aggregate(F.transform(shared, lambda k: a[k].cast("double") * b[k].cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))
