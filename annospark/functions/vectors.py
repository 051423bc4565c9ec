"""Array-column vector expressions (JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vec: Column) -> Column:
    return F.transform(vec, lambda x: x.cast("double"))


def sq_norm(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def l2_norm(vec: Column) -> Column:
    return F.sqrt(sq_norm(vec))


def l2_normalise(vec: Column, floor: float = 1e-12) -> Column:
    """``v / max(||v||, floor)`` element-wise (F1)."""
    n = F.greatest(l2_norm(vec), F.lit(floor))
    return F.transform(vec, lambda x: x.cast("double") / n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def has_non_finite(vec: Column) -> Column:
    return F.exists(vec, lambda x: F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
