"""Queries of scalar expressions: tokens, keys, formats, hashes, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.functions import hashing, numbers, text, vectors
from siltworks.plans.registry import duck_bucket, query
from siltworks.sources.tables import flatten_json, table

PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?].*$', '')"
DUCK_PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?].*$', '')"


@query(
    "path_tokens", "F1 F2 X19",
    f"""WITH p AS (SELECT page_id, {DUCK_PATH} AS path FROM pages),
    s AS (SELECT page_id, string_split(path, '/') AS parts FROM p),
    l AS (SELECT page_id, list_concat(parts[1:len(parts) - 1], [regexp_replace(parts[len(parts)], '(.)\\.[^.]*$', '\\1')]) AS parts FROM s),
    t AS (SELECT page_id, list_filter(regexp_split_to_array(lower(array_to_string(parts, '/')), '[/_\\-\\s.]+'), lambda x: x <> '') AS t FROM l)
    SELECT page_id, array_to_string(t, ' ') AS tokens, len(t)::BIGINT AS n FROM t""",
)
def path_tokens(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(PATH).alias("path"))
    t = text.path_tokens(F.col("path"))
    return pages.select("page_id", F.array_join(t, " ").alias("tokens"), F.size(t).cast("long").alias("n"))


@query(
    "clean_paths", "F3 F14",
    """WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'set/lr4/a.png' WHEN 1 THEN 'set/flow_viz/b.png' WHEN 2 THEN 'set/x2/c-mask.png'
      WHEN 3 THEN 'set/HR/jpeg.d.png' ELSE 'set/hr/e_1.png' END AS path FROM part)
    SELECT p_partkey, path, p_partkey % 5 = 4 AS clean FROM p""",
)
def clean_paths(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, ("set/lr4/a.png", "set/flow_viz/b.png", "set/x2/c-mask.png", "set/HR/jpeg.d.png", "set/hr/e_1.png"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    part = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    return part.withColumn("clean", text.is_clean(text.path_tokens(F.col("path"))))


@query(
    "natural_sort", "O1 O2",
    """WITH f AS (SELECT p_partkey, 'im' || p_partkey || '.png' AS name FROM part)
    SELECT p_partkey, name, row_number() OVER (ORDER BY p_partkey) AS place FROM f""",
)
def natural_sort(spark, sf_dir):
    from siltworks.operators.prefix import with_running

    f = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("im"), "p_partkey", F.lit(".png")).alias("name"))
    return with_running(f.withColumn("k", text.natural_key(F.col("name"))), [F.col("k")], rank="place").drop("k")


@query(
    "slugs", "X9",
    """SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_type || ')'), '[^a-z0-9_-]+', '_', 'g'), '_') AS slug FROM part""",
)
def slugs(spark, sf_dir):
    name = F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(name).alias("slug"))


_ESCAPED = " ".join(f"WHEN '{c}' THEN '{to}'" for c, to in text.TYPESET.items())


@query(
    "escapes", "X10",
    f"""SELECT doc_id, array_to_string(list_transform(string_split(text, ''), lambda c: CASE c {_ESCAPED} ELSE c END), '') AS escaped FROM documents""",
)
def escapes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.escape_chars(F.col("text")).alias("escaped"))


@query(
    "uri_parts", "X20 X15 F16",
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'kaggle' WHEN 1 THEN 'data' ELSE 'mp4' END AS scheme, 'f/' || page_id || '.png' AS path,
    CASE WHEN page_id % 3 = 2 THEN page_id * 7 END AS frame FROM pages""",
)
def uri_parts(spark, sf_dir):
    tail = F.concat(F.lit("f/"), "page_id", F.lit(".png"))
    uri = (
        F.when(F.col("page_id") % 3 == 0, text.build_uri(F.lit("own/set"), tail))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit("data:"), tail))
        .otherwise(F.concat(F.lit("mp4:"), tail, F.lit("#"), (F.col("page_id") * 7).cast("string")))
    )
    pages = table(spark, sf_dir, "pages").select("page_id", uri.alias("uri"))
    u = F.col("uri")
    return pages.select("page_id", text.uri_scheme(u).alias("scheme"), text.uri_path(u).alias("path"), text.uri_frame(u).alias("frame"))


@query(
    "stable_buckets", "X1 X2",
    f"""SELECT doc_id, {duck_bucket("'7/' || doc_id")} AS bucket FROM documents""",
)
def stable_buckets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hashing.seeded_bucket(F.col("doc_id"), 7).alias("bucket"))


@query(
    "short_ids", "X3 X4 X5",
    """WITH h AS (SELECT doc_id, md5(text) AS a, md5(lower(text)) AS b FROM documents)
    SELECT doc_id, substr(a, 1, 10) AS short_id, substr(a, 1, 16) AS hex,
    bit_count(xor(('0x' || substr(a, 1, 8))::BIGINT, ('0x' || substr(b, 1, 8))::BIGINT))::INT
      + bit_count(xor(('0x' || substr(a, 9, 8))::BIGINT, ('0x' || substr(b, 9, 8))::BIGINT))::INT AS hamming FROM h""",
)
def short_ids(spark, sf_dir):
    a, b = hashing.hash64(F.col("text")), hashing.hash64(F.lower("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", hashing.short_id(F.col("text")).alias("short_id"), hashing.bits_hex(a).alias("hex"), hashing.hamming(a, b).alias("hamming")
    )


@query(
    "cosine_pairs", "X6",
    """SELECT a.vec_id, b.vec_id AS other, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("b"))
    return e.join(b, "vec_id").select("vec_id", "other", F.round(vectors.dot(F.col("embedding"), F.col("b")), 6).alias("cosine"))


@query(
    "number_formats", "X7 X11 X14",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE '' END || format('{:,.0f}', floor(o_totalprice)) AS whole,
    CASE WHEN o_totalprice >= 1000 THEN format('{:,.0f}', floor(o_totalprice / 1000) ) || 'K' ELSE format('{:,.0f}', floor(o_totalprice)) END AS short,
    least(greatest(o_totalprice, 1000.0), 100000.0) AS clamped FROM orders""",
)
def number_formats(spark, sf_dir):
    price = F.floor("o_totalprice").cast("double")
    signed = F.when(F.col("o_orderkey") % 3 == 0, -price).otherwise(price)
    short = F.when(price >= 1000, numbers.count_text(F.floor(F.col("o_totalprice") / 1000) * 1000)).otherwise(numbers.integer_text(price))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", numbers.integer_text(signed).alias("whole"), short.alias("short"), numbers.clamp(F.col("o_totalprice"), 1000.0, 100000.0).alias("clamped")
    )


@query(
    "significant_figures", "X12",
    """WITH x AS (SELECT p_partkey, p_partkey / 8.0::DOUBLE AS v FROM part WHERE p_partkey > 0), d AS (
      SELECT p_partkey, v, greatest(0, 3 - floor(log10(v))::INT) AS places FROM x)
    SELECT p_partkey, places::INT AS places, CASE places WHEN 0 THEN format('{:,.0f}', round_even(v, 0)) WHEN 1 THEN rtrim(rtrim(format('{:,.1f}', round_even(v, 1)), '0'), '.')
      WHEN 2 THEN rtrim(rtrim(format('{:,.2f}', round_even(v, 2)), '0'), '.') WHEN 3 THEN rtrim(rtrim(format('{:,.3f}', round_even(v, 3)), '0'), '.')
      ELSE rtrim(rtrim(format('{:,.4f}', round_even(v, 4)), '0'), '.') END AS shown FROM d""",
)
def significant_figures(spark, sf_dir):
    v = F.col("p_partkey") / F.lit(8.0)
    part = table(spark, sf_dir, "part").where("p_partkey > 0")
    return part.select("p_partkey", numbers.significant_decimals(v).alias("places"), numbers.significant(v).alias("shown"))


@query(
    "metric_formats", "X13",
    """WITH m AS (SELECT unnest(['psnr_y', 'ssim', 't4_mean_ms', 'gmac', 'warp_err', 'ui_ghost_rate', 'lpips']) AS name), v AS (
      SELECT l_orderkey, l_linenumber, l_discount, name FROM lineitem, m)
    SELECT l_orderkey, l_linenumber, name, CASE name WHEN 'psnr_y' THEN 2 WHEN 'ssim' THEN 3 WHEN 't4_mean_ms' THEN 1 WHEN 'gmac' THEN 1 WHEN 'warp_err' THEN 4 ELSE 3 END AS places,
    CASE name WHEN 'psnr_y' THEN format('{:.2f}', l_discount) WHEN 'ssim' THEN format('{:.3f}', l_discount) WHEN 't4_mean_ms' THEN format('{:.1f}', round_even(l_discount, 1))
      WHEN 'gmac' THEN format('{:.1f}', round_even(l_discount, 1)) WHEN 'warp_err' THEN format('{:.4f}', l_discount) ELSE format('{:.3f}', l_discount) END AS shown FROM v""",
)
def metric_formats(spark, sf_dir):
    names = F.explode(F.array(*map(F.lit, ("psnr_y", "ssim", "t4_mean_ms", "gmac", "warp_err", "ui_ghost_rate", "lpips"))))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", names.alias("name"))
    c, v = F.col("name"), F.col("l_discount")
    return rows.select("l_orderkey", "l_linenumber", "name", numbers.decimals_of(c, v).alias("places"), numbers.format_metric(c, v).alias("shown"))


@query(
    "null_handling", "X8 F15",
    """SELECT l_returnflag, round(avg(CASE WHEN l_linenumber % 3 <> 0 THEN l_tax END), 6) AS mean_tax, count(*) FILTER (l_linenumber % 3 <> 0) AS known,
    round(sum(CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE l_tax END), 4) AS filled FROM lineitem GROUP BY l_returnflag""",
)
def null_handling(spark, sf_dir):
    raw = F.when(F.col("l_linenumber") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    x = numbers.known(F.col("x"))
    return table(spark, sf_dir, "lineitem").select("l_returnflag", raw.alias("x")).groupBy("l_returnflag").agg(
        F.round(F.avg(x), 6).alias("mean_tax"), F.count(x).alias("known"), F.round(F.sum(F.coalesce(x, F.lit(-1.0))), 4).alias("filled")
    )


@query(
    "run_dates", "X16",
    """SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END, '%-d %B %Y') AS finished,
    CASE WHEN o_orderkey % 2 = 0 THEN 600::BIGINT ELSE 3600::BIGINT END AS seconds FROM orders""",
)
def run_dates(spark, sf_dir):
    """A run from 23:55 whose end reads 00:05 ended on the next day."""
    even = F.col("o_orderkey") % 2 == 0
    start = F.to_timestamp(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(even, " 23:55:00").otherwise(" 10:00:00")))
    end = F.to_timestamp(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(even, " 00:05:00").otherwise(" 11:00:00")))
    end = F.when(end < start, end + F.expr("INTERVAL 1 DAY")).otherwise(end)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format(end, "d MMMM yyyy").alias("finished"), (F.unix_seconds(end) - F.unix_seconds(start)).alias("seconds")
    )


@query(
    "json_leaves", "X17 X18",
    """SELECT event_id, 'ev.p.k' AS path, (props->>'$.k')::DOUBLE AS number FROM events WHERE (props->>'$.k') IS NOT NULL
    UNION ALL SELECT event_id, 'ev.a.0', 1.5 FROM events UNION ALL SELECT event_id, 'ev.a.2.c', event_id::DOUBLE FROM events""",
)
def json_leaves(spark, sf_dir):
    doc = F.concat(F.lit('{"p": '), "props", F.lit(', "a": [1.5, true, {"c": '), "event_id", F.lit('}], "d": null, "e": "x"}'))
    events = table(spark, sf_dir, "events").select("event_id", doc.alias("doc"))
    return flatten_json(events, "event_id", "doc", "ev")


@query(
    "cost_estimates", "X23 N4 T11",
    """SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'Infinity'::DOUBLE ELSE round(2.0 * p_retailprice / (p_size % 7), 6) END AS ms,
    pow(0.5, greatest(0, ceil(log2(p_size / 12.0)))) AS scale, least(1.0, greatest(0.1, p_size / 40.0)) AS budget FROM part""",
)
def cost_estimates(spark, sf_dir):
    ms = numbers.estimate_ms(F.col("p_retailprice"), (F.col("p_size") % 7).cast("double"))
    scale = F.pow(F.lit(0.5), F.greatest(F.lit(0), F.ceil(F.log2(F.col("p_size") / 12.0))))
    budget = F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.col("p_size") / 40.0))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(ms, 6).alias("ms"), scale.alias("scale"), budget.alias("budget"))
