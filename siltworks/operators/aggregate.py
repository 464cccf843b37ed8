"""Aggregations: grouped statistics, contingency tables, histograms, quantiles and curves."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.numbers import known
from siltworks.functions.text import slug
from siltworks.operators.prefix import group_quantiles, with_running

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def metric_columns(df: DataFrame, excluded: Sequence[str] = ()) -> list[str]:
    """Numeric columns but the excluded ones; booleans and decimals are no metrics."""
    return [c for c, kind in df.dtypes if kind in NUMERIC and c not in excluded]


def group_means(df: DataFrame, keys: Sequence[str], metrics: Sequence[str] | None = None) -> DataFrame:
    """Means of metrics by group, NaN skipped; rows with a null key are left out, as in a data frame's groupby."""
    metrics = list(metrics or metric_columns(df, keys))
    whole = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)) if keys else df
    return whole.groupBy(*keys).agg(*[F.avg(known(F.col(m).cast("double"))).alias(m) for m in metrics])


def group_medians(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Interpolated medians by group, NaN skipped."""
    whole = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return whole.groupBy(*keys).agg(*[F.median(known(F.col(m).cast("double"))).alias(m) for m in metrics])


def long_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``keys, metric, value`` rows, null and NaN values left out."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), known(F.col(m).cast("double")).alias("value")) for m in metrics])
    return df.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.metric", "x.value").where("value IS NOT NULL")


def group_stats(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Count, mean, least and greatest known value of each metric in each group; metrics without any are left out."""
    long = long_metrics(df, keys, metrics)
    return long.groupBy(*keys, "metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")
    )


def keyed_values(df: DataFrame, base: str, ids: Sequence[str], excluded: Sequence[str] = ()) -> DataFrame:
    """A wide table as ``key, number`` rows: base, slugs of the identifiers (empty ones skipped) and the metric."""
    metrics = metric_columns(df, [*ids, *excluded])
    long = long_metrics(df, ids, metrics)
    parts = F.array(F.lit(base), *[slug(F.col(c).cast("string")) for c in ids], slug(F.col("metric")))
    key = F.array_join(F.filter(parts, lambda x: x != ""), ".")
    return long.select(key.alias("key"), F.col("value").alias("number"))


def history_summary(df: DataFrame, run: str, position: str, metrics: Sequence[str]) -> DataFrame:
    """Rows, last known, least and greatest value of each metric of each run."""
    long = long_metrics(df, [run, position], metrics)
    return long.groupBy(run, "metric").agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by("value", position).alias("last"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts by ``row`` with a column for each of ``values``, 0 where there are none; null rows are left out."""
    whole = df.where(F.col(row).isNotNull())
    return whole.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(str(v)) for v in values])


def dense_histogram(df: DataFrame, column: str, top: int) -> DataFrame:
    """Counts of the integers 0 to ``top``, zeros included."""
    counts = df.where(F.col(column).between(0, top)).groupBy(F.col(column).cast("long").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(top + 1).withColumnRenamed("id", "value")
    return every.join(F.broadcast(counts), "value", "left").na.fill(0, ["n"])


def width_bin(x: Column, low: float, high: float, bins: int) -> Column:
    """0-based bin of equal widths; the upper end belongs to the last bin, values outside to none."""
    at = F.floor((x - low) / ((high - low) / bins)).cast("int")
    return F.when((x >= low) & (x <= high), F.least(at, F.lit(bins - 1)))


def width_histogram(df: DataFrame, keys: Sequence[str], column: str, low: float, high: float, bins: int) -> DataFrame:
    """Share of each group's values in each non-empty bin."""
    at = df.select(*keys, width_bin(F.col(column), low, high, bins).alias("bin")).where("bin IS NOT NULL")
    counts = at.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    totals = at.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    return counts.join(totals, list(keys)).select(*keys, "bin", (F.col("n") / F.col("total")).alias("share"))


def linear_quantiles(df: DataFrame, column: str, points: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one row a point; no rows without values."""
    values = df.select(known(F.col(column).cast("double")).alias("x"))
    found = [group_quantiles(values, [], "x", p, "value").select(F.lit(float(p)).alias("point"), "value") for p in points]
    return reduce(DataFrame.unionByName, found).where("value IS NOT NULL")


def index_quantile(df: DataFrame, column: str, key: str, point: float) -> DataFrame:
    """The sorted value at 0-based position ``int(point * (n - 1))``, no interpolation; no row without values."""
    whole = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select(column, key)
    ranked = with_running(whole, [F.col(column), F.col(key)])
    at = F.floor(F.lit(point) * (F.lit(whole.count()) - 1)) + 1
    return ranked.where(F.col("rank") == at).select(F.col(column).cast("double").alias("value"))


def roc_curve(df: DataFrame, score: str, label: str, key: str, points: int = 400) -> DataFrame:
    """``rank, fpr, tpr`` as the threshold sweeps down the scores, every ``n / points``-th row."""
    flags = {"positives": (F.col(label) == 1).cast("long"), "negatives": (F.col(label) == 0).cast("long")}
    swept = with_running(df.select(score, label, key), [F.desc(score), F.col(key)], flags)
    n, p, q = df.agg(F.count(F.lit(1)), F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    step = max(1, n // points)
    return swept.where((F.col("rank") - 1) % step == 0).select(
        "rank", (F.col("negatives") / max(1, q)).alias("fpr"), (F.col("positives") / max(1, p)).alias("tpr")
    )


def confusion(df: DataFrame, label: Column, found: Column) -> DataFrame:
    """Precision, recall and false positives of a decision; 0 where nothing was found or there."""
    hit = F.count_if(label & found)
    return df.agg(
        (hit / F.greatest(F.count_if(found), F.lit(1))).alias("precision"),
        (hit / F.greatest(F.count_if(label), F.lit(1))).alias("recall"),
        F.count_if(~label & found).alias("false_positives"),
    )
