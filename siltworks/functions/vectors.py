"""Vectors in array columns, and small hashes of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; the cosine of unit vectors. Null if either is null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def sign_bits(v: Column, first: int = 0, n: int = 64) -> Column:
    """Bit k of a 64-bit number is set where element ``first + k`` is positive."""
    flags = F.transform(F.slice(v, first + 1, n), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(flags, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def gradient_bits(v: Column, n: int = 63) -> Column:
    """Bit k is set where element k + 1 exceeds element k: a difference hash."""
    flags = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.when(F.get(v, i + 1) > F.get(v, i), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")),
    )
    return F.aggregate(flags, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
