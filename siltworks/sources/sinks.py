"""Sinks: keyed results, tables with summary rows, caches and new versions of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.operators.prefix import with_running


def write_metrics(df: DataFrame, path: str, form: str = "csv") -> None:
    """A table of metrics as CSV with a header, or as JSON lines."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.json(path)


def result_lines(values: DataFrame, key: str, text: str) -> DataFrame:
    """``key = text`` lines in order of key; raises on keys defined twice."""
    from siltworks.operators.joins import repeated_keys

    twice = [r[key] for r in repeated_keys(values, key).limit(5).collect()]
    if twice:
        raise ValueError(f"defined twice: {', '.join(map(str, twice))}")
    return values.select(F.concat_ws(" = ", key, text).alias("value"), key).orderBy(key).select("value")


def write_results(values: DataFrame, path: str, key: str = "key", text: str = "text") -> None:
    result_lines(values, key, text).coalesce(1).write.mode("overwrite").text(path)


def with_summary(df: DataFrame, group: str, name: str, metrics: Sequence[str], label: str = "mean") -> DataFrame:
    """The rows and, for each group, one whose ``name`` is ``label`` with the means of the metrics."""
    means = df.groupBy(group).agg(*[F.avg(m).alias(m) for m in metrics]).withColumn(name, F.lit(label))
    return df.unionByName(means, allowMissingColumns=True)


def bounded_cache(df: DataFrame, key: str, capacity: int) -> DataFrame:
    """The first ``capacity`` rows by key with their ``row_id``, ranked over range partitions whatever the capacity."""
    ranked = with_running(df, [F.col(key)], {}, "row_id")
    return ranked.where(F.col("row_id") <= capacity).withColumn("row_id", (F.col("row_id") - 1).cast("int"))


def next_version(cache: DataFrame, computed: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """A cache with some rows' columns replaced by computed ones; rows that were not computed stay."""
    new = computed.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__new"))
    out = cache.join(new, key, "left")
    fresh: dict[str, Column] = {c: F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}
    return out.withColumns(fresh).select(*cache.columns)


def sampled_batch(cache: DataFrame, row_id: str, count: int, size: int, seed: int) -> DataFrame:
    """Rows of one random batch in order of id; drawn with replacement only if the batch exceeds the cache."""
    from siltworks.functions.hashing import draw

    if size <= count:
        return cache.orderBy(draw(F.col(row_id), seed), row_id).limit(size).orderBy(row_id)
    spark = cache.sparkSession
    picks = spark.range(size).select(F.floor(draw(F.col("id"), seed) * count).cast("long").alias(row_id))
    return picks.join(cache, row_id).orderBy(row_id)
