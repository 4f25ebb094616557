"""Vector functions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """Sum of products in double precision; otherwise for vectors that are missing or of different size."""
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.when(a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)), F.aggregate(products, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(otherwise))


def unit(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    n = F.sqrt(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    return F.when(n > 0, F.transform(v.cast("array<double>"), lambda x: x / n)).otherwise(v.cast("array<double>"))


def enrichment_dot(a: Column, b: Column) -> Column:
    """The dot product by which items are compared: below all others where a vector is missing or of another size."""
    return dot(a, b, -1.0)


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """A vector without a model: the same text gives the same unit vector."""
    return unit(F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.pmod(F.xxhash64(text, i), F.lit(2_000_003)) / 1_000_001.0 - 1))
