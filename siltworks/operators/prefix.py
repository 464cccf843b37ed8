"""Global order without a single task: ranks and running sums over a range-partitioned table."""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.scratch import scratch_table
from siltworks.ship import ship_code


def with_running(
    df: DataFrame, order: list[Column], sums: Mapping[str, Column] | None = None, rank: str = "rank", lags: Mapping[str, Column] | None = None
) -> DataFrame:
    """Add the 1-based ``rank`` of each row in ``order`` and a running sum, itself included, for each of ``sums``.

    ``lags`` are values of the row before, null for the first. Rows are range-partitioned and ranked inside their
    partition; what comes before a partition is one row a partition, which is broadcast. ``order`` must leave no ties
    that matter.
    """
    sums, lags = dict(sums or {}), dict(lags or {})
    extra = {f"__{k}": c for k, c in sums.items()} | {f"__l_{k}": c for k, c in lags.items()}
    parts = df.repartitionByRange(*order).withColumns(extra | {"__p": F.spark_partition_id()})
    parts = scratch_table(parts, "ranges")
    inside = Window.partitionBy("__p").orderBy(*order)
    line = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = parts.withColumn("__r", F.row_number().over(inside)).withColumns({f"__s_{k}": F.sum(f"__{k}").over(line) for k in sums})
    if lags:
        out = out.withColumns({f"__b4_{k}": F.lag(f"__l_{k}").over(inside) for k in lags})
        out = out.withColumn("__last", F.row_number().over(Window.partitionBy("__p").orderBy(*order)) == F.count(F.lit(1)).over(Window.partitionBy("__p")))
        out = scratch_table(out, "ranges-in-order")
    totals = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(f"__{k}").alias(f"__t_{k}") for k in sums])
    if lags:
        ends = out.where("__last").select("__p", *[F.col(f"__l_{k}").alias(f"__e_{k}") for k in lags])
        totals = totals.join(F.broadcast(ends), "__p")  # a row a partition
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "__p",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in sums],
        *[F.lag(f"__e_{k}").over(Window.orderBy("__p")).alias(f"__o_{k}") for k in lags],
    )
    out = out.join(F.broadcast(totals), "__p")
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns],
        (F.col("__before") + F.col("__r")).alias(rank),
        *[(F.col(f"__b_{k}") + F.coalesce(F.col(f"__s_{k}"), F.lit(0))).alias(k) for k in sums],
        *[F.when(F.col("__r") == 1, F.col(f"__o_{k}")).otherwise(F.col(f"__b4_{k}")).alias(k) for k in lags],
    )


def grouped_running(
    df: DataFrame, keys: list[str], order: list[Column], sums: Mapping[str, Column] | None = None, maxima: Mapping[str, Column] | None = None,
    maxima_before: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running ``sums`` and ``maxima`` of each group's rows in ``order``, this row included, and ``maxima_before`` without it.

    A group may be the whole table: rows are range-partitioned by keys and order and run through inside their partition; what
    a group's rows in earlier partitions come to is one row a partition at most, which is broadcast. Nulls do not
    count; a maximum of none is null; null keys are a group. ``order`` must leave no ties that matter.
    """
    sums, maxima, earlier = dict(sums or {}), dict(maxima or {}), dict(maxima_before or {})
    takes = {k: (c, F.sum) for k, c in sums.items()} | {k: (c, F.max) for k, c in (maxima | earlier).items()}
    marks = {f"__v_{k}": c for k, (c, _) in takes.items()}
    groups = [F.col(f"__g{i}") for i in range(len(keys))]
    rows = df.withColumns(marks | {f"__g{i}": F.struct(F.col(k).isNull().alias("none"), F.col(k).alias("key")) for i, k in enumerate(keys)})
    rows = scratch_table(rows.repartitionByRange(*groups, *order).withColumn("__p", F.spark_partition_id()), "group-ranges")
    inside = Window.partitionBy("__p", *groups).orderBy(*order)
    upto, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({f"__i_{k}": take(f"__v_{k}").over(before if k in earlier else upto) for k, (_, take) in takes.items()})
    totals = rows.groupBy("__p", *groups).agg(F.lit(1).alias("__one"), *[take(f"__v_{k}").alias(f"__t_{k}") for k, (_, take) in takes.items()])
    past = Window.partitionBy(*groups).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    carried = totals.select("__p", *groups, F.sum("__one").over(past).alias("__goes_on"), *[take(f"__t_{k}").over(past).alias(f"__c_{k}") for k, (_, take) in takes.items()])
    carried = carried.where("__goes_on IS NOT NULL").withColumnsRenamed({"__p": "__q"} | {f"__g{i}": f"__h{i}" for i in range(len(keys))})
    same = F.col("__p") == F.col("__q")
    for i in range(len(keys)):
        same = same & (F.col(f"__g{i}") == F.col(f"__h{i}"))
    out = out.join(F.broadcast(carried), same, "left")  # a partition's first group goes on, others begin there

    def value(k: str) -> Column:
        if k in sums:
            return F.coalesce(F.col(f"__c_{k}"), F.lit(0)) + F.coalesce(F.col(f"__i_{k}"), F.lit(0))
        return F.greatest(f"__c_{k}", f"__i_{k}")

    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in takes], *[value(k).alias(k) for k in takes])


def _between(low: pd.Series, high: pd.Series, part: pd.Series) -> pd.Series:
    """``low * (1 - part) + high * part`` where the first product and the sum are rounded once, as DuckDB's quantiles are."""
    one = lambda x, y, p: x if x == y else float(Fraction(x) * Fraction(1 - p) + Fraction(y * p))
    three = zip(low, high, part, strict=True)
    return pd.Series([None if pd.isna(x) else one(x, y, p) if abs(x) < float("inf") > abs(y) else x + (y - x) * p for x, y, p in three], dtype="float64")


def group_quantiles(
    df: DataFrame, keys: list[str], value: str, point: float | Column, name: str, to_compare: bool = False, times: str | None = None
) -> DataFrame:
    """``keys`` and ``name``: the exact quantile of each group's values with linear interpolation; nulls do not count.

    ``point`` may be an expression over the keys; a row counts ``times`` times, or once. With ``to_compare`` the last bit is that of DuckDB's ``quantile_cont``:
    between values a bit or two apart it decides which of them reach the quantile.

    Equal values are counted first; the distinct ones are ranked over range partitions, so that a group of any size, or
    the whole table (no keys), is never held by one task. Null keys are a group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg((F.sum(times) if times else F.count(F.lit(1))).alias("__c"))
    counts = scratch_table(with_running(counts, [*[F.col(k) for k in keys], F.col("__v")], {"__upto": F.col("__c")}, "__rank"), "value-counts")
    whole = counts.groupBy(*keys).agg(F.min(F.col("__upto") - F.col("__c")).alias("__start"), F.max("__upto").alias("__end"))
    at = (point if isinstance(point, Column) else F.lit(float(point))) * (F.col("__end") - F.col("__start") - 1)
    whole = whole.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__start", F.floor(at).alias("__low"), F.ceil(at).alias("__high"), (at - F.floor(at)).alias("__part"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    placed = counts.join(whole, same) if keys else counts.join(F.broadcast(whole))  # a single row
    first = F.col("__upto") - F.col("__c") - F.col("__start")
    holds = lambda c: (first <= F.col(c)) & (F.col(c) < first + F.col("__c"))
    low, high = F.max(F.when(holds("__low"), F.col("__v"))), F.max(F.when(holds("__high"), F.col("__v")))
    if not to_compare:
        return placed.groupBy(*keys).agg((low + (high - low) * F.max("__part")).alias(name))
    ship_code(df.sparkSession)
    ends = placed.groupBy(*keys).agg(low.alias("__a"), high.alias("__b"), F.max("__part").alias("__p"))
    return ends.select(*keys, F.pandas_udf(_between, "double")("__a", "__b", "__p").alias(name))  # a row a group
