"""Queries of scans, catalogues and sinks."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from siltworks.operators.window import first_island, full_segments
from siltworks.plans.queries_scalar import DUCK_PATH, PATH
from siltworks.plans.registry import duck_draw, query
from siltworks.scratch import scratch_path
from siltworks.sources import catalogue, sinks, tables
from siltworks.sources.tables import table

REGISTRY = "name string, kind string, role string, weight bigint"
DUCK_REGISTRY = """(SELECT 'src' || i AS name, CASE WHEN i % 2 = 0 THEN 'still' ELSE 'seq' END AS kind, CASE WHEN i % 5 = 0 THEN 'test' ELSE 'train' END AS role,
  CASE WHEN i % 3 <> 0 THEN i END AS weight FROM (SELECT unnest(range(0, 24)) AS i))"""


def _registry(spark):
    rows = [
        {"name": f"src{i}", "kind": ("still", "seq")[i % 2], "role": "train" if i % 5 else "test"} | ({"weight": i} if i % 3 else {})
        for i in range(24)
    ]
    return tables.registry(spark, rows, REGISTRY)


def _files(spark, sf_dir):
    """Page addresses as files of three sources."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(PATH).alias("path"))
    return pages.withColumn("source", F.concat(F.lit("s"), F.col("page_id") % 3))


DUCK_FILES = f"(SELECT page_id, {DUCK_PATH} AS path, 's' || page_id % 3 AS source FROM pages)"


@query("scan_project_documents", "S15 F14", "SELECT doc_id, lang, n_chars FROM documents WHERE n_chars >= 500 AND lang <> 'en'")
def scan_project_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("n_chars >= 500 AND lang <> 'en'").select("doc_id", "lang", "n_chars")


@query(
    "registry_card", "S1 R14 J15",
    f"""SELECT r.name, r.kind, r.role, r.weight, coalesce(d.n, 0) AS items, coalesce(d.chars, 0)::BIGINT AS chars FROM {DUCK_REGISTRY} r
    LEFT JOIN (SELECT source, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY source) d ON r.name = d.source""",
)
def registry_card(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("items"), F.sum("n_chars").alias("chars"))
    return _registry(spark).join(counts.withColumnRenamed("source", "name"), "name", "left").na.fill(0, ["items", "chars"])


@query(
    "discovery_union", "S8 S16 U1 A15",
    """SELECT source, count(*) AS items, count(*) FILTER (role = 'test') AS test_items, count(extra) AS extras FROM (
      SELECT 'docs' AS source, CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS role, NULL AS extra FROM documents UNION ALL
      SELECT 'pages', 'train', url FROM pages UNION ALL SELECT 'bench', 'test', NULL FROM benchmark) GROUP BY source""",
)
def discovery_union(spark, sf_dir):
    role = F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train")
    docs = table(spark, sf_dir, "documents").select(F.lit("docs").alias("source"), role.alias("role"))
    pages = table(spark, sf_dir, "pages").select(F.lit("pages").alias("source"), F.lit("train").alias("role"), F.col("url").alias("extra"))
    bench = table(spark, sf_dir, "benchmark").select(F.lit("bench").alias("source"), F.lit("test").alias("role"))
    return tables.union_sources([docs, pages, bench]).groupBy("source").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("role") == "test").alias("test_items"), F.count("extra").alias("extras")
    )


@query(
    "capped_folders", "S3 O5",
    f"""WITH f AS (SELECT page_id, regexp_replace(path, '/?[^/]*$', '') AS folder FROM {DUCK_FILES}),
    d AS (SELECT folder, count(*) AS n FROM f GROUP BY folder),
    o AS (SELECT folder, coalesce(sum(n) OVER (ORDER BY {duck_draw("'3/' || folder")}, folder ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
    SELECT page_id, f.folder FROM f JOIN o USING (folder) WHERE before < 60""",
)
def capped_folders(spark, sf_dir):
    return catalogue.capped_folders(_files(spark, sf_dir), 60, 3).select("page_id", "folder")


@query(
    "shallowest_file", "S4",
    f"""SELECT name, arg_min(path, (len(string_split(path, '/')), path)) AS path FROM (
      SELECT path, list_extract(string_split(path, '/'), -1) AS name FROM {DUCK_FILES}) WHERE len(string_split(path, '/')) <= 4 GROUP BY name""",
)
def shallowest_file(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("name", F.element_at(F.split("path", "/"), -1))
    files = files.where(F.size(F.split("path", "/")) - 1 < 4)
    return files.groupBy("name").agg(F.min_by("path", F.struct(F.size(F.split("path", "/")), F.col("path"))).alias("path"))


@query(
    "catalogue_sequences", "S6 F16 X3",
    f"""WITH f AS (SELECT source, regexp_replace(path, '/?[^/]*$', '') AS folder, path,
      regexp_extract(path, '(\\d+)[^0-9]*$', 1) AS d FROM {DUCK_FILES}),
    g AS (SELECT source, folder, count(*) AS n_frames, min(path) AS any_path, list_sort(list(path)) AS paths FROM f GROUP BY source, folder HAVING count(*) >= 2)
    SELECT source, folder AS grp, n_frames, array_to_string(paths, ' ') AS sorted_frames FROM g""",
)
def catalogue_sequences(spark, sf_dir):
    items = catalogue.sequences(_files(spark, sf_dir), "source", min_frames=2)
    return items.select(
        "source", F.regexp_replace("group", "^[^:]*:", "").alias("grp"), "n_frames", F.array_join(F.array_sort("frames"), " ").alias("sorted_frames")
    )


@query(
    "original_only_filter", "F4 S6",
    """WITH f AS (SELECT doc_id, source, CASE WHEN doc_id % 4 = 0 AND source <> 'src1' THEN 'hr' ELSE 'any' END AS part FROM documents)
    SELECT source, count(*) AS files FROM (SELECT *, bool_or(part = 'hr') OVER (PARTITION BY source) AS marked FROM f) WHERE NOT marked OR part = 'hr' GROUP BY source""",
)
def original_only_filter(spark, sf_dir):
    part = F.when((F.col("doc_id") % 4 == 0) & (F.col("source") != "src1"), "hr").otherwise("any")
    files = table(spark, sf_dir, "documents").select("source", F.concat(F.lit("set/"), part, F.lit("/"), "doc_id", F.lit(".png")).alias("path"))
    return catalogue.only_originals(files, "source").groupBy("source").agg(F.count(F.lit(1)).alias("files"))


@query(
    "paired_frames", "S7",
    """WITH p AS (SELECT u.conv_id AS scene, u.turn, length(u.text) AS a, length(w.text) AS b FROM conversations u
      LEFT JOIN conversations w ON u.conv_id = w.conv_id AND w.turn = u.turn + 1 WHERE u.role = 'user'),
    l AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY turn DESC) AS back FROM p)
    SELECT scene, count(*) FILTER (back > 1) AS n, coalesce(sum(a) FILTER (back > 1), 0)::BIGINT AS frame_chars, coalesce(sum(b) FILTER (back > 1), 0)::BIGINT AS flow_chars FROM l GROUP BY scene""",
)
def paired_frames(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    frames = c.where("role = 'user'").select(F.col("conv_id").alias("scene"), F.lit("clean").alias("variant"), F.col("turn").alias("stem"), F.col("text").alias("path"))
    flows = c.select(F.col("conv_id").alias("scene"), (F.col("turn") - 1).alias("stem"), F.col("text").alias("path"))
    both = catalogue.paired_frames(frames, flows)
    chars = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(F.length(x), F.lit(0)))
    return both.select("scene", F.size("frames").cast("long").alias("n"), chars("frames").alias("frame_chars"), chars("flows").alias("flow_chars"))


@query(
    "first_islands", "S13",
    """WITH r AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE turn <> 3),
    f AS (SELECT *, first_value(i) OVER (PARTITION BY conv_id ORDER BY turn) AS f FROM r) SELECT conv_id, turn FROM f WHERE i = f""",
)
def first_islands(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("turn <> 3").select("conv_id", "turn")
    return first_island(c, ["conv_id"], "turn")


@query(
    "full_segments", "W9 S13",
    """WITH c AS (SELECT conv_id, turn, turn // 3 AS segment FROM conversations) SELECT conv_id, turn, segment FROM (
      SELECT *, count(*) OVER (PARTITION BY conv_id, segment) AS n FROM c) WHERE n = 3""",
)
def full_segment_rows(spark, sf_dir):
    return full_segments(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], "turn", 3).select("conv_id", "turn", "segment")


@query(
    "balanced_clips", "S14",
    """SELECT conv_id % 7 AS town, conv_id AS clip, count(*) FILTER (role = 'user') AS n_high, count(*) FILTER (role = 'assistant') AS n_low
    FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') >= 3 AND count(*) FILTER (role = 'user') = count(*) FILTER (role = 'assistant')""",
)
def balanced_clips(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 7).alias("town"), F.col("conv_id").alias("clip"), F.col("role").alias("res"))
    return catalogue.balanced_clips(c, "user", "assistant")


@query(
    "manifest_roundtrip", "S19 X17 F15 S20",
    """SELECT conv_id AS item, count(*) AS n_frames, array_to_string(list_sort(list(role || turn)), ',') AS frames FROM conversations GROUP BY conv_id""",
)
def manifest_roundtrip(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("item")).agg(F.array_sort(F.collect_list(F.concat("role", "turn"))).alias("frames"))
    path = scratch_path(spark, "manifest")
    tables.write_manifest(c, path)
    back = tables.read_manifest(spark, path)
    return back.select("item", F.size("frames").cast("long").alias("n_frames"), F.array_join("frames", ",").alias("frames"))


@query(
    "reachable_sources", "S21 F8 J4",
    """WITH m AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY lpad(doc_id::VARCHAR, 9, '0')) AS n FROM documents)
    SELECT source, bool_or(doc_id % 4 = 1) AS reachable FROM m WHERE n <= 3 GROUP BY source""",
)
def reachable_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    manifest = docs.select("source", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("item_id"), F.array(F.col("doc_id").cast("string")).alias("frames"))
    return catalogue.reachable(manifest, docs.where("doc_id % 4 = 1").select(F.col("doc_id").cast("string").alias("path")))


@query(
    "metrics_roundtrip", "S22 K1",
    """SELECT l_returnflag || l_linestatus AS stage, round(sum(l_quantity), 2) AS minutes FROM lineitem GROUP BY ALL""",
)
def metrics_roundtrip(spark, sf_dir):
    stage = F.concat("l_returnflag", "l_linestatus").alias("stage")
    rows = table(spark, sf_dir, "lineitem").groupBy(stage).agg(F.round(F.sum("l_quantity"), 2).alias("minutes"))
    path = scratch_path(spark, "metrics")
    sinks.write_metrics(rows.withColumnRenamed("stage", "_c0"), path)
    return tables.read_metrics(spark, path, "stage string, minutes double")


@query(
    "snapshot_scan", "S25 K5 A28",
    """SELECT p_brand AS key, count(*)::VARCHAR AS text FROM part GROUP BY p_brand""",
)
def snapshot_scan(spark, sf_dir):
    values = table(spark, sf_dir, "part").groupBy(F.regexp_replace("p_brand", " ", "_").alias("key")).agg(F.count(F.lit(1)).cast("string").alias("text"))
    path = scratch_path(spark, "results")
    sinks.write_results(values, path)
    return tables.read_snapshot(spark.read.text(path))


@query(
    "integrity_check", "S24",
    """SELECT n_nationkey, n_nationkey % 3 <> 0 AS ok FROM nation""",
)
def integrity_check(spark, sf_dir):
    """One file a nation, written and read back as bytes; every third is listed with the digest of other bytes."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    path = scratch_path(spark, "weights")
    nation.write.partitionBy("n_nationkey").text(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("n_nationkey", "content")
    rows = [(r["n_nationkey"], r["n_name"] + ("\n" if r["n_nationkey"] % 3 else "?")) for r in nation.collect()]  # 25 rows
    expected = spark.createDataFrame([(k, hashlib.sha256(t.encode()).hexdigest()) for k, t in rows], "n_nationkey int, sha256 string")
    return tables.integrity(files, expected, "n_nationkey")


@query(
    "select_items", "F6 F7 J4",
    """SELECT doc_id FROM documents WHERE doc_id % 5 <> 0 AND source IN ('src1', 'src2', 'src3') AND lang IN ('en', 'de') AND n_chars >= 300 AND doc_id % 4 < 2""",
)
def select_items(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.col("lang").alias("kind"), F.col("n_chars").alias("n_frames"), F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train").alias("split"),
        F.when(F.col("doc_id") % 4 != 1, F.col("doc_id") % 4).alias("frame_stride"),
    )
    chosen = catalogue.select_items(docs, "train", ["src1", "src2", "src3"], ["en", "de"], 300)
    return catalogue.without_strides(chosen).select("doc_id")


@query(
    "test_list_scan", "S5 O6 U3",
    f"""WITH n AS (SELECT DISTINCT trim(p_type) AS name FROM part), o AS (SELECT name FROM n ORDER BY {duck_draw("'5/' || name")}, name LIMIT 12)
    SELECT name FROM o WHERE name IN (SELECT p_type FROM part WHERE p_size > 25)""",
)
def test_list_scan(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    lines = part.select(F.concat(F.lit("  "), "p_type", F.lit(" ")).alias("value"))
    return catalogue.test_list(lines, part.where("p_size > 25").select(F.col("p_type").alias("name")), "name", 5, 12)


@query(
    "sampled_batch", "S23 P1",
    f"""SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY {duck_draw("'9/' || doc_id")}, doc_id LIMIT 64)""",
)
def sampled_batch(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sinks.sampled_batch(docs, "doc_id", docs.count(), 64, 9)


@query("bounded_cache", "K2", "SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id)::INT - 1 AS row_id FROM documents WHERE n_chars > 1000 ORDER BY doc_id LIMIT 100")
def bounded_cache(spark, sf_dir):
    return sinks.bounded_cache(table(spark, sf_dir, "documents").where("n_chars > 1000").select("doc_id", "n_chars"), "doc_id", 100)


@query("next_version", "K4 J12", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN -n_chars ELSE n_chars END AS n_chars FROM documents")
def next_version(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    computed = docs.where("doc_id % 3 = 0").withColumn("n_chars", -F.col("n_chars"))
    return sinks.next_version(docs, computed, "doc_id", ["n_chars"])


@query(
    "summary_rows", "K6 A25",
    """WITH d AS (SELECT p_type AS method, p_brand AS sequence, avg(p_retailprice) AS price FROM part GROUP BY ALL)
    SELECT method, sequence, round(price, 6) AS price FROM d UNION ALL SELECT method, 'mean', round(avg(price), 6) FROM d GROUP BY method""",
)
def summary_rows(spark, sf_dir):
    detail = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("method"), F.col("p_brand").alias("sequence")).agg(F.avg("p_retailprice").alias("price"))
    return sinks.with_summary(detail, "method", "sequence", ["price"]).select("method", "sequence", F.round("price", 6).alias("price"))
