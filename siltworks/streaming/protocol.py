"""The line protocol of a running job: a kind, a space and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("PROGRESS", "ROUND", "DONE", "LOG")


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """``kind, body, payload`` of lines; payload is null where the body is no JSON object, other lines are logs."""
    parts = F.split(F.col(line), " ", 2)
    kind = F.when(F.get(parts, F.lit(0)).isin(*KINDS), F.get(parts, F.lit(0))).otherwise("TEXT")
    body = F.when(kind == "TEXT", F.col(line)).otherwise(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    return lines.withColumns({"kind": kind, "body": body}).withColumn("payload", F.from_json("body", "map<string,string>"))


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the lines of text files as they appear in a folder."""
    return spark.readStream.text(path)


def rounds(parsed: DataFrame) -> DataFrame:
    """``round, elapsed_min, step, score`` of ROUND lines with a payload."""
    kept = parsed.where("kind = 'ROUND' AND payload IS NOT NULL")
    number = lambda k, t: F.expr(f"try_cast(payload['{k}'] AS {t})").alias(k)
    return kept.select(number("round", "bigint"), number("elapsed_min", "double"), number("step", "bigint"), number("score", "double"))


def last_lines(parsed: DataFrame, order: str, n: int = 40) -> DataFrame:
    """The last ``n`` lines in order."""
    return parsed.orderBy(F.desc(order)).limit(n).orderBy(order)
