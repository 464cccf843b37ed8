"""Vectors that take part: whole, finite, as doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers. The empty vector is."""
    v, least = vector.cast("array<double>"), F.lit(float("-inf"))
    within = F.coalesce((F.array_max(v) < float("inf")) & (F.array_min(v) > least), F.size(v) == 0)  # NaN is above all numbers
    return vector.isNotNull() & ~F.exists(v, lambda x: x.isNull()) & within


def finite_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``k, v``: key and components as doubles of the rows that ``finite`` holds for."""
    return df.where(finite(F.col(vector))).select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
