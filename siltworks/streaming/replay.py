"""Replay of the event table as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """Parquet event files as a stream with a time-zone timestamp, which watermarks need."""
    read = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger)
    return read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events and value sums by window and type; rows later than ``late`` are left out in append mode."""
    by = F.window("ts", width)
    out = events.withWatermark("ts", late) if events.isStreaming else events
    out = out.groupBy(by.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and return its result table."""
    spark = stream.sparkSession
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint)
    run = query.trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)
