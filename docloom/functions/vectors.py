"""Vector functions on arrays of doubles."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 where the sizes differ or a norm is 0."""
    na = F.sqrt(dot(a, a)) if norm_a is None else norm_a
    nb = F.sqrt(dot(b, b)) if norm_b is None else norm_b
    return F.when((F.size(a) != F.size(b)) | (na == 0) | (nb == 0), 0.0).otherwise(dot(a, b) / (na * nb))
