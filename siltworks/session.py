"""A session with the settings that the queries are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(name: str = "siltworks", **settings: str) -> SparkSession:
    """An existing or new session; ``settings`` win over ``SETTINGS``, with ``__`` for dots."""
    build = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        build = build.config(key, value)
    return build.getOrCreate()
