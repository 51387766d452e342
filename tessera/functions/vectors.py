"""Vector arithmetic as native Spark expressions (no Python UDFs).

Dense vectors are ``array<double>`` columns; sparse vectors are
``map<bigint,double>`` columns (component -> value).  Everything here is a
Column expression evaluated inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# torch.nn.CosineSimilarity default eps (per-norm clamp)
COSINE_EPS = 1e-8
# torch.nn.CosineEmbeddingLoss internal epsilon (added to squared norms)
EMBEDDING_LOSS_EPS = 1e-12


def as_double_array(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.transform(c, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Dense dot product of two equally long arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0),
                       lambda acc, v: acc + v)


def sq_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x)


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def cosine(dot_ab: Column, sq_a: Column, sq_b: Column, eps: float = COSINE_EPS) -> Column:
    """Cosine similarity with each norm clamped at ``eps``; a zero vector
    therefore scores 0 against everything."""
    return dot_ab / (F.greatest(F.sqrt(sq_a), F.lit(eps)) * F.greatest(F.sqrt(sq_b), F.lit(eps)))


def embedding_cosine(dot_ab: Column, sq_a: Column, sq_b: Column) -> Column:
    """Cosine as used by a cosine-embedding loss: eps added to squared norms."""
    return dot_ab / F.sqrt((sq_a + F.lit(EMBEDDING_LOSS_EPS)) * (sq_b + F.lit(EMBEDDING_LOSS_EPS)))


def sparse_dot(a: Column, b: Column) -> Column:
    """Dot product of two ``map<component,value>`` vectors; iterates ``a``."""
    return F.aggregate(F.map_entries(a), F.lit(0.0),
                       lambda acc, e: acc + e["value"] * F.coalesce(F.element_at(b, e["key"]), F.lit(0.0)))


def sparse_sq_norm(a: Column) -> Column:
    return F.aggregate(F.map_values(a), F.lit(0.0), lambda acc, v: acc + v * v)


def dense_from_map(m: Column, dims: Column | int) -> Column:
    """Dense array of length ``dims`` from a component map (missing -> 0)."""
    n = F.lit(dims) if isinstance(dims, int) else dims
    return F.transform(F.sequence(F.lit(0).cast("bigint"), (n - 1).cast("bigint")),
                       lambda i: F.coalesce(F.element_at(m, i), F.lit(0.0)))


def argmax_first(a: Column) -> Column:
    """0-based index of the first maximum of an array."""
    return F.array_position(a, F.array_max(a)) - 1
