"""Vector expressions over array<float> columns, evaluated in double precision inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x: Column) -> Column:
    return x.cast("double")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, the engine's ranking distance; smaller is nearer."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (_d(x) - _d(y)) * (_d(x) - _d(y))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def normalize(a: Column) -> Column:
    """Unit vector as floats; a zero vector stays as it is."""
    length = norm(a)
    return F.transform(a, lambda x: (_d(x) / F.when(length == 0, F.lit(1.0)).otherwise(length)).cast("float"))


def similarity(distance: Column) -> Column:
    """Of unit vectors at a squared distance."""
    return 1 - distance / 2


def is_valid(a: Column, dimension: int | None = None) -> Column:
    """All components are finite numbers, and as many as wanted."""
    good = a.isNotNull() & (F.size(a) > 0) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return good & (F.size(a) == dimension) if dimension else good


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
