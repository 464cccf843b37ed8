"""Joins that stay even when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_by_key(rows: DataFrame, facts: DataFrame, key: str, n_col: str, n_rows: int) -> DataFrame:
    """Left join ``facts`` (one row a ``key``) to ``rows``; a key may own any share of the rows.

    ``n_col`` counts the rows of a key. Keys with more than ``max(512, n_rows / 4096)`` rows number at
    most 4,096 and are broadcast, so their rows stay where they are; the others shuffle evenly.
    Both inputs are read more than once: pass tables, not long lineages. Null keys match nothing; a caller
    with many of them sets those rows aside first.
    """
    cut = max(512, n_rows // 4096)
    hot = facts.where(F.col(n_col) > cut)
    warm = facts.where(F.col(n_col) <= cut)
    names = hot.select(F.col(key).alias("__hot"))
    at_hot = rows.join(F.broadcast(hot), key, "inner")
    at_rest = rows.join(F.broadcast(names), F.col(key) == F.col("__hot"), "left_anti").join(warm, key, "left")
    order = [*rows.columns, *[c for c in facts.columns if c != key]]
    return at_hot.unionByName(at_rest).select(*[f"`{c}`" for c in order])
