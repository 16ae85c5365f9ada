"""Vector expressions over ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, z: Column) -> Column:
    """Inner product."""
    return F.aggregate(F.zip_with(a, z, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, z: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(z, z))
    return F.when(norms == 0, 0.0).otherwise(dot(a, z) / norms)


def composite(state: Column, start: int, length: int) -> Column:
    """Mean of a slice of a feature vector (1-based start)."""
    return F.aggregate(F.slice(state, start, length), F.lit(0.0), lambda acc, v: acc + v) / length
