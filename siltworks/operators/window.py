"""Window-style operators: heads, ordinals, lags, windows over sequences. Positions are explicit columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.functions.numbers import known
from siltworks.operators.prefix import grouped_running


def head_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, total: int | None = None) -> DataFrame:
    """The first ``n`` rows of each group, and of those the first ``total`` in order."""
    line = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("__at", F.row_number().over(line)).where(F.col("__at") <= n).drop("__at")
    return out.orderBy(*order).limit(total) if total else out


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "ordinal") -> DataFrame:
    """0-based position of each row in its group."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def with_change(df: DataFrame, keys: Sequence[str], order: str, column: str, name: str = "change") -> DataFrame:
    """Difference to the row before in the same sequence; null for the first."""
    line = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(name, F.col(column) - F.lag(column).over(line))


def best_row(df: DataFrame, keys: Sequence[str], column: str, order: str) -> DataFrame:
    """The row of each group with the greatest known value, the first of ties; NaN counts as unknown."""
    rank = F.struct(known(F.col(column).cast("double")).alias("v"), (-F.col(order)).alias("o"))
    whole = df.where(known(F.col(column).cast("double")).isNotNull())
    best = whole.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), rank).alias("__row"))
    return best.select("__row.*")


def running_best(df: DataFrame, keys: Sequence[str], column: str, order: str) -> DataFrame:
    """Best value so far and whether a row improves on all before it (strictly: the first of ties keeps it).

    A sequence may be of any length.
    """
    value = known(F.col(column).cast("double"))
    out = grouped_running(df, list(keys), [F.col(order)], maxima={"best": value}, maxima_before={"__last": value})
    return out.withColumn("improved", F.coalesce(F.col(column) > F.col("__last"), F.col(column).isNotNull())).drop("__last")


def sliding_windows(df: DataFrame, length: str, size: int, stride: int | None = None) -> DataFrame:
    """One row for each window of ``size`` positions in a sequence of ``length``; half-overlapping by default."""
    step = stride or max(1, size // 2)
    starts = F.sequence(F.lit(0).cast("long"), F.col(length).cast("long") - size, F.lit(step).cast("long"))
    return df.where(F.col(length) >= size).withColumn("start", F.explode(starts))


def plan_windows(df: DataFrame, key: str, length: str, size: int, n: int, seed: int) -> DataFrame:
    """``n`` windows spread evenly over sequences: a random start for each sequence in each round."""
    from siltworks.functions.hashing import draw

    usable = df.where(F.col(length) >= size).select(key, length)
    count = usable.count()
    rounds = -(-n // max(1, count))
    step = max(1, size // 2)
    plans = usable.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(max(0, rounds - 1)))))
    choices = F.floor((F.col(length) - size) / step) + 1
    at = F.floor(draw(F.concat_ws("/", key, "round"), seed) * choices) * step
    plans = plans.withColumn("start", at.cast("long"))
    order = [F.col("round"), draw(F.col(key), seed), F.col(key)]
    return plans.orderBy(*order).limit(n).select(key, "round", "start")


def full_segments(df: DataFrame, keys: Sequence[str], position: str, size: int) -> DataFrame:
    """Rows in non-overlapping segments of ``size`` positions; incomplete ones are left out."""
    cut = df.withColumn("segment", F.floor(F.col(position) / size).cast("long"))
    full = cut.groupBy(*keys, "segment").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == size).drop("__n")
    return cut.join(full, [*keys, "segment"], "left_semi")


def first_island(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """The rows of each group up to the first gap in its integer positions."""
    line = Window.partitionBy(*keys).orderBy(position)
    marked = df.withColumn("__i", F.col(position) - F.row_number().over(line))
    marked = marked.withColumn("__f", F.first("__i").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return marked.where("__i = __f").drop("__i", "__f")


def key_positions(n: Column) -> Column:
    """Representative positions of a sequence of ``n``: its only one, its middle, or at 10, 50 and 90 percent."""
    tenth, half = F.floor(n / 10), F.floor(n / 2)
    return (
        F.when(n == 1, F.array(F.lit(0).cast("long")))
        .when(n >= 24, F.array(tenth, half, n - 1 - tenth))
        .otherwise(F.array(half))
    ).cast("array<bigint>")


def backwards(values: Column) -> Column:
    """A sequence of differences played backwards: reversed, with nothing before the new first."""
    return F.transform(F.reverse(values), lambda x, i: F.when(i == 0, F.lit(0.0)).otherwise(x.cast("double")))
