"""Vector expressions over array<float> or array<double> columns, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-10


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Unclamped cosine similarity."""
    return dot(a, b) / (norm(a) * norm(b))


def semantic_similarity(a: Column, b: Column) -> Column:
    """Cosine clamped to [0, 1]; 0 for null, empty, unequal or vanishing vectors and for results that are no number."""
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm(a) > EPSILON) & (norm(b) > EPSILON)
    value = F.when(usable, cosine(a, b))
    return F.when(value.isNull() | F.isnan(value), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


#: metric -> (expression, whether a higher value is nearer)
METRICS = {"cosine": (cosine, True), "dot": (dot, True), "euclid": (euclidean, False), "manhattan": (manhattan, False)}
