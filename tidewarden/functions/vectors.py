"""Vector arithmetic on array columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-12


def as_double(vec) -> Column:
    return F.col(vec).cast("array<double>") if isinstance(vec, str) else vec.cast("array<double>")


def total(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(vec: Column) -> Column:
    return F.sqrt(total(F.transform(vec, lambda v: v * v)))


def l2_normalise(vec) -> Column:
    """``x / max(|x|, 1e-12)`` in double precision."""
    wide = as_double(vec)
    size = F.greatest(norm(wide), F.lit(NORM_FLOOR))
    # repeated as an array so that the norm is taken once per row, not once per element
    return F.zip_with(wide, F.array_repeat(size, F.size(wide)), lambda v, s: v / s)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(NORM_FLOOR)) * F.greatest(norm(b), F.lit(NORM_FLOOR)))


def max_abs_difference(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def clamp(vec, bound: float = 5.0) -> Column:
    return F.transform(as_double(vec), lambda v: F.greatest(F.lit(-bound), F.least(F.lit(bound), v)))


def log_scale(vec, factor: float = 100.0) -> Column:
    """``log1p(f * max(v, 0)) / log1p(f)`` per element."""
    return F.transform(
        as_double(vec), lambda v: F.log1p(F.lit(factor) * F.greatest(v, F.lit(0.0))) / F.log1p(F.lit(factor))
    )
