"""Scans with declared schemas: tables, manifests, metrics, snapshots and logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of a manifest that hold lists.
LIST_COLUMNS = ("frames", "flows", "valid", "depth", "native_lr")

MANIFEST = (
    "item_id string, source string, kind string, group string, role string, frames array<string>, n_frames bigint, "
    "content string, mv string, flows array<string>, valid array<string>, valid_kind string, depth array<string>, "
    "native_lr array<string>, frame_stride bigint, variant string, split string, component bigint, drop_reason string"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables, with time zone free timestamps as they are."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry(spark: SparkSession, rows: Sequence[Mapping], schema: str) -> DataFrame:
    """A source registry as a small table; optional keys are null."""
    fields = T._parse_datatype_string(schema).names
    return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], schema)


def source_of(registered: DataFrame, name: str) -> dict:
    """The registry row of a source; raises if there is none."""
    rows = registered.where(F.col("name") == name).limit(1).collect()
    if not rows:
        raise KeyError(name)
    return rows[0].asDict()


def encode_lists(df: DataFrame, columns: Sequence[str] = LIST_COLUMNS) -> DataFrame:
    """List columns as JSON text, as a manifest file has them."""
    here = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.to_json(F.col(c)) for c in here})


def decode_lists(df: DataFrame, columns: Sequence[str] = LIST_COLUMNS) -> DataFrame:
    """JSON text as list columns; bad text is null."""
    here = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.from_json(F.col(c), "array<string>") for c in here})


def write_manifest(df: DataFrame, path: str) -> None:
    encode_lists(df).write.mode("overwrite").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return decode_lists(spark.read.parquet(path))


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    """All items of some sources; columns that a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table of metrics; an unnamed first column is the stage."""
    return spark.read.option("header", True).option("enforceSchema", True).schema(schema).csv(path)


def dispatch(stems: Sequence[str], rules: Mapping[str, str]) -> dict[str, str]:
    """The rule of each file; files without one are an error that names them all."""
    unknown = sorted(s for s in stems if s not in rules)
    if unknown:
        raise ValueError(f"no rule for {', '.join(unknown)}")
    return {s: rules[s] for s in stems}


def read_snapshot(lines: DataFrame, pattern: str = r"^([^=\s]+)\s*=\s*(.*)$") -> DataFrame:
    """``key, text`` of a snapshot with one pair a line; other lines are skipped."""
    found = lines.select(F.regexp_extract("value", pattern, 1).alias("key"), F.regexp_extract("value", pattern, 2).alias("text"))
    return found.where("key <> ''")


def flatten_json(lines: DataFrame, key: str, text: str, base: str) -> DataFrame:
    """Numeric leaves of JSON documents as ``key, path, number``.

    Lists are indexed, keys split at ``/``, parts are slugs and empty ones are skipped; booleans, nulls and texts are
    left out; text that is no JSON has no leaves. Documents are walked as variants, a level a step, until no
    object or list is left; what is left to walk is checked each time, so any depth ends.
    """
    from siltworks.functions.text import slug
    from siltworks.scratch import scratch_table

    now = lines.select(F.col(key).alias("doc"), F.array().cast("array<string>").alias("path"), F.try_parse_json(text).alias("v"))
    leaves = []
    while True:
        kinds = now.where("v IS NOT NULL").withColumn("kind", F.schema_of_variant("v"))
        leaf = kinds.where("kind NOT LIKE 'OBJECT%' AND kind NOT LIKE 'ARRAY%'")
        leaves.append(leaf.where("kind NOT IN ('BOOLEAN', 'STRING', 'VOID')").select("doc", "path", F.try_variant_get("v", "$", "double").alias("number")))
        nodes = kinds.where("kind LIKE 'OBJECT%' OR kind LIKE 'ARRAY%'")
        nodes.createOrReplaceTempView("silt_json_nodes")
        step = lines.sparkSession.sql("SELECT n.doc, n.path, c.pos, c.key, c.value AS v FROM silt_json_nodes n, LATERAL variant_explode(n.v) c")
        names = F.coalesce(F.split("key", "/"), F.array(F.col("pos").cast("string")))
        parts = F.filter(F.transform(names, slug), lambda x: x != "")
        step = step.select("doc", F.concat("path", parts).alias("path"), F.to_json("v").alias("t"))
        step = scratch_table(step, "json-level")
        if not step.limit(1).count():
            break
        now = step.select("doc", "path", F.try_parse_json("t").alias("v"))
    out = union_sources(leaves)
    return out.select(F.col("doc").alias(key), F.array_join(F.concat(F.array(F.lit(base)), "path"), ".").alias("path"), "number")


def integrity(files: DataFrame, expected: DataFrame, name: str) -> DataFrame:
    """``name, ok`` of binary files (``content``) against the ``sha256`` that is expected by name; unknown names are not ok."""
    found = files.select(name, F.sha2("content", 256).alias("found")).join(expected.select(name, "sha256"), name, "left")
    return found.select(name, F.coalesce(F.col("found") == F.col("sha256"), F.lit(False)).alias("ok"))


def record_json(df: DataFrame, columns: Sequence[str]) -> Column:
    """A row as JSON without its unknown fields: nulls and NaN are left out."""
    kinds = dict(df.dtypes)
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns]
    return F.to_json(F.struct(*clean))
