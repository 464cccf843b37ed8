"""Queries of metric rows, losses, caches, verification, calibration and the whole duplicate search."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.functions import hashing, vectors
from siltworks.operators import arrays, duplicates, features, images, joins, media
from siltworks.plans.queries_curation import LIMITS
from siltworks.plans.queries_sources import DUCK_FILES, _files
from siltworks.plans.queries_vision import SIDE, pictures
from siltworks.plans.registry import duck_draw, query
from siltworks.scratch import scratch_table
from siltworks.sources.tables import table

# Images, losses, costs ---------------------------------------------------------------------------------------------

_GREY = "(SELECT vec_id, i // 8 AS y, i % 8 AS x, abs(embedding[i + 1]::DOUBLE) * 400.0::DOUBLE AS v FROM embeddings, (SELECT unnest(range(0, 64)) AS i))"


@query(
    "thumb_statistics", "D1 D2",
    f"""WITH p AS {_GREY}, l AS (SELECT c.vec_id, u.v + d.v + a.v + b.v - 4 * c.v AS lap FROM p c JOIN p u ON u.vec_id = c.vec_id AND u.y = c.y - 1 AND u.x = c.x
      JOIN p d ON d.vec_id = c.vec_id AND d.y = c.y + 1 AND d.x = c.x JOIN p a ON a.vec_id = c.vec_id AND a.y = c.y AND a.x = c.x - 1 JOIN p b ON b.vec_id = c.vec_id AND b.y = c.y AND b.x = c.x + 1),
    r AS (SELECT vec_id, y, avg(v) AS m FROM p GROUP BY vec_id, y), b AS (SELECT vec_id, coalesce(1 - (max(y) FILTER (m >= 8) - min(y) FILTER (m >= 8) + 1) / 8.0::DOUBLE, 1.0) AS letterbox FROM r GROUP BY vec_id),
    s AS (SELECT vec_id, avg(v) AS mean, stddev_pop(v) AS std FROM p GROUP BY vec_id), h AS (SELECT vec_id, var_pop(lap) AS sharpness FROM l GROUP BY vec_id)
    SELECT vec_id, round(mean, 5) AS mean, round(std, 5) AS std, round(sharpness, 4) AS sharpness, round(letterbox, 5) AS letterbox FROM s JOIN h USING (vec_id) JOIN b USING (vec_id)""",
)
def thumb_statistics(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double")) * 400.0).alias("grey"))
    s = media.with_thumb_statistics(e, "grey", 8)
    return s.select("vec_id", *[F.round(c, 4 if c == "sharpness" else 5).alias(c) for c in ("mean", "std", "sharpness", "letterbox")])


@query(
    "loss_values", "M12",
    """SELECT l_returnflag, round(avg(sqrt(pow(l_tax - l_discount, 2) + 0.001::DOUBLE * 0.001::DOUBLE)), 7) AS smooth FROM lineitem GROUP BY l_returnflag""",
)
def loss_values(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(arrays.charbonnier(F.col("l_tax"), F.col("l_discount")).alias("smooth"))
    return p.select("l_returnflag", F.round("smooth", 7).alias("smooth"))


@query(
    "gradient_losses", "M12",
    f"""WITH p AS (SELECT vec_id, y, x, v / 400.0::DOUBLE AS v, 0.1::DOUBLE * x AS w FROM {_GREY}), a AS (SELECT c.vec_id, avg(abs(r.v - r.w - c.v + c.w)) AS m FROM p c JOIN p r ON r.vec_id = c.vec_id AND r.y = c.y AND r.x = c.x + 2 GROUP BY c.vec_id),
    b AS (SELECT c.vec_id, avg(abs(r.v - r.w - c.v + c.w)) AS m FROM p c JOIN p r ON r.vec_id = c.vec_id AND r.x = c.x AND r.y = c.y + 2 GROUP BY c.vec_id),
    n AS (SELECT c.vec_id, c.y, c.x, r.v - c.v AS dv, r.w - c.w AS dw FROM p c JOIN p r ON r.vec_id = c.vec_id AND abs(r.x - c.x) <= 3 AND abs(r.y - c.y) <= 3 WHERE c.x BETWEEN 3 AND 4 AND c.y BETWEEN 3 AND 4),
    g AS (SELECT vec_id, pow(dv / sqrt(0.81::DOUBLE + dv * dv) - dw / sqrt(0.81::DOUBLE + dw * dw), 2) AS s FROM n), e AS (SELECT vec_id, avg(s / (0.1::DOUBLE + s)) AS m FROM g GROUP BY vec_id)
    SELECT vec_id, round(a.m + b.m, 6) AS gradient, round(e.m, 6) AS census FROM a JOIN b USING (vec_id) JOIN e USING (vec_id)""",
)
def gradient_losses(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("a"))
    e = e.withColumn("b", F.transform("a", lambda _, i: F.pmod(i, F.lit(8)) * 0.1))
    return media.with_losses(e, "a", "b", 8).select("vec_id", F.round("gradient", 6).alias("gradient"), F.round("census", 6).alias("census"))


@query(
    "colour_round_trip", "G1 M5",
    """WITH c AS (SELECT vec_id, abs(embedding[1])::DOUBLE AS r, abs(embedding[2])::DOUBLE AS g, abs(embedding[3])::DOUBLE AS b FROM embeddings)
    SELECT vec_id, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, round_even(r * 255, 0) / 255 AS level,
    round(CASE WHEN r <= 0.0031308 THEN r * 12.92 ELSE 1.055 * pow(r, 1 / 2.4::DOUBLE) - 0.055 END, 6) AS coded FROM c""",
)
def colour_round_trip(spark, sf_dir):
    r, g, b = (F.abs(F.get("embedding", F.lit(i)).cast("double")) for i in range(3))
    e = table(spark, sf_dir, "embeddings").select("vec_id", r.alias("r"), arrays.to_ycocg(r, g, b).alias("c"))
    e = e.select("vec_id", F.col("r").alias("red"), arrays.from_ycocg(F.col("c.y"), F.col("c.co"), F.col("c.cg")).alias("p"))
    return e.select(
        "vec_id", *[F.round(f"p.{c}", 6).alias(c) for c in "rgb"], arrays.quantise(F.col("red")).alias("level"), F.round(arrays.linear_to_srgb(F.col("red")), 6).alias("coded")
    )


@query(
    "model_costs", "N5",
    """SELECT p_brand AS model, round(sum(p_size * 10.0::DOUBLE * 16 * (p_partkey % 32 + 1) * 8 * 9 / 2) / 1e9, 9) AS gmac, sum((p_partkey % 32 + 1) * 8 * 9 // 2 + 8)::BIGINT AS parameters FROM part GROUP BY p_brand""",
)
def model_costs(spark, sf_dir):
    layers = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("model"), (F.col("p_size") * 10.0).alias("height"), F.lit(16).alias("width"), (F.col("p_partkey") % 32 + 1).alias("c_in"),
        F.lit(8).alias("c_out"), F.lit(3).alias("kernel"), F.lit(2).alias("groups"),
    )
    return media.multiply_adds(layers, "model").withColumn("gmac", F.round("gmac", 9))


@query(
    "flipped_flows", "G6",
    """SELECT vec_id, list_transform(range(0, 64), lambda i: CASE WHEN i % 2 = 0 THEN -embedding[((i // 2) // 8) * 16 + (7 - (i // 2) % 8) * 2 + 1] ELSE embedding[((i // 2) // 8) * 16 + (7 - (i // 2) % 8) * 2 + 2] END::DOUBLE)::VARCHAR <> '' AS there,
    round(-embedding[15]::DOUBLE, 6) AS first_x, round(embedding[16]::DOUBLE, 6) AS first_y, round(-embedding[49]::DOUBLE, 6) AS last_x, round(embedding[50]::DOUBLE, 6) AS last_y FROM embeddings""",
)
def flipped_flows(spark, sf_dir):
    flow = F.transform("embedding", lambda x: x.cast("double"))
    f = table(spark, sf_dir, "embeddings").select("vec_id", media.flip_flow(flow, 8).alias("f"))
    at = {"first_x": 0, "first_y": 1, "last_x": 62, "last_y": 63}
    return f.select("vec_id", (F.size("f") == 64).alias("there"), *[F.round(F.get("f", F.lit(i)), 6).alias(c) for c, i in at.items()])


@query(
    "image_subset", "S12 P1",
    f"""WITH f AS (SELECT path || CASE WHEN page_id % 2 = 0 THEN '.PNG' ELSE '.txt' END AS path, source FROM {DUCK_FILES})
    SELECT source, path FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {duck_draw("'4/' || path")}, path) AS n FROM f
      WHERE lower(path) LIKE '%.png' AND NOT starts_with(split_part(path, '/', -1), '.')) WHERE n <= 5""",
)
def image_subset(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("path", F.concat("path", F.when(F.col("page_id") % 2 == 0, ".PNG").otherwise(".txt")))
    return media.image_subset(files, "source", 5, 4).select("source", "path")


@query(
    "flow_warps", "G9",
    f"""WITH p AS (SELECT vec_id, unnest(range(0, 64)) AS i, list_transform(embedding, lambda v: abs(v::DOUBLE)) AS e FROM embeddings),
    s AS (SELECT *, least(greatest(i % 8 + (vec_id % 5) * 0.25::DOUBLE - 0.5, 0), 7) AS sx, least(greatest(i // 8 + (i % 3) * 0.5::DOUBLE - 0.5, 0), 7) AS sy FROM p),
    g AS (SELECT *, floor(sx)::INT AS x0, floor(sy)::INT AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy, least(floor(sx)::INT + 1, 7) AS x1, least(floor(sy)::INT + 1, 7) AS y1 FROM s)
    SELECT vec_id, i AS place, round((e[y0 * 8 + x0 + 1] * (1 - fx) + e[y0 * 8 + x1 + 1] * fx) * (1 - fy) + (e[y1 * 8 + x0 + 1] * (1 - fx) + e[y1 * 8 + x1 + 1] * fx) * fy, 6) AS v FROM g""",
)
def flow_warps(spark, sf_dir):
    """A field that varies by pixel: a quarter step across by vector, half a step down by column of three."""
    place = F.sequence(F.lit(0), F.lit(63))
    across = (F.col("vec_id") % 5) * 0.25 - 0.5
    field = F.flatten(F.transform(place, lambda i: F.array(across, F.pmod(i, F.lit(3)) * 0.5 - 0.5)))
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("image"), field.alias("flow"))
    w = images.with_flow_warp(e, "image", "flow", 8).select("vec_id", F.posexplode("warped").alias("place", "v"))
    return w.select("vec_id", F.col("place").cast("long").alias("place"), F.round("v", 6).alias("v"))


@query(
    "block_motion", "G7",
    """WITH p AS (SELECT vec_id, i // 16 AS y, (i // 2) % 8 AS x, embedding[i + 1]::DOUBLE AS mx, embedding[i + 2]::DOUBLE AS my, (vec_id + i // 2) % 9 <> 0 AS valid FROM embeddings, (SELECT unnest(range(0, 64, 2)) AS i))
    SELECT vec_id, y // 2 AS by, x // 2 AS bx, round(avg(mx) / 2, 6) AS mx, round(avg(my) / 2, 6) AS my, bool_and(valid) AS valid FROM p GROUP BY ALL""",
)
def block_motion(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
    at = lambda k: F.get("embedding", 2 * F.col("i") + k).cast("double")
    pixels = e.select("vec_id", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).alias("x"), at(0).alias("mx"), at(1).alias("my"), ((F.col("vec_id") + F.col("i")) % 9 != 0).alias("valid"))
    b = media.block_motion(pixels, ["vec_id"], 2)
    return b.select("vec_id", "by", "bx", F.round("mx", 6).alias("mx"), F.round("my", 6).alias("my"), "valid")


@query(
    "cropped_windows", "D11",
    f"""WITH c AS (SELECT vec_id, floor({duck_draw("'6/y/' || vec_id // 4")} * 5)::INT AS y, floor({duck_draw("'6/x/' || vec_id // 4")} * 5)::INT AS x, embedding FROM embeddings)
    SELECT vec_id // 4 AS clip, vec_id AS frame, y, x, round(list_sum(list_transform(range(0, 16), lambda i: embedding[(y + i // 4) * 8 + x + i % 4 + 1]::DOUBLE * (i + 1))), 6) AS marked FROM c""",
)
def cropped_windows(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("clip"), F.col("vec_id").alias("frame"), F.transform("embedding", lambda x: x.cast("double")).alias("image"))
    w = images.cropped_windows(e, "clip", "frame", "image", 8, 4, 6)
    marked = F.aggregate(F.transform("crop", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return w.select("clip", "frame", "y", "x", F.round(marked, 6).alias("marked"))


@query(
    "fused_kernels", "N1",
    """SELECT p_partkey % 16 AS c_out, p_size % 16 AS c_in, p_partkey, round(p_size / 10.0 + p_retailprice / 1000 + CASE WHEN p_partkey % 2 = 0 AND p_partkey % 16 = p_size % 16 THEN 1 ELSE 0 END, 6) AS centre, round(p_size / 10.0, 6) AS corner FROM part""",
)
def fused_kernels(spark, sf_dir):
    k = F.col("p_size") / 10.0
    layers = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("layer"), (F.col("p_partkey") % 16).alias("c_out"), (F.col("p_size") % 16).alias("c_in"), F.array_repeat(k, 9).alias("k3"),
        (F.col("p_retailprice") / 1000).alias("k1"), (F.col("p_partkey") % 2 == 0).alias("identity"),
    )
    f = images.fused_kernels(layers)
    return f.select("c_out", "c_in", F.col("layer").alias("p_partkey"), F.round(F.get("kernel", F.lit(4)), 6).alias("centre"), F.round(F.get("kernel", F.lit(0)), 6).alias("corner"))


@query(
    "decoded_images", "S17 D2",
    """WITH p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, least(255, floor(abs(embedding[i + 1]::DOUBLE) * 400))::INT AS v FROM embeddings, (SELECT unnest(range(0, 64)) AS i))
    SELECT vec_id, 8 AS width, 8 AS height, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std FROM p GROUP BY vec_id""",
)
def decoded_images(spark, sf_dir):
    """Vectors as binary grey maps, decoded, and the statistics of their thumbnails."""
    grey = F.transform("embedding", lambda x: F.least(F.lit(255), F.floor(F.abs(x.cast("double")) * 400)).cast("int"))
    body = F.unhex(F.array_join(F.transform(grey, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    files = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.concat(F.encode(F.lit("P5\n# grey\n8 8 255\n"), "UTF-8"), body).alias("content"))
    d = media.with_thumb_statistics(images.decode_images(files, 8).where("error IS NULL"), "thumb", 8)
    return d.select(F.col("path").cast("long").alias("vec_id"), "width", "height", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


# Metric rows -------------------------------------------------------------------------------------------------------

_MASKED = "CASE WHEN sum({m}) > {n} THEN round(10 * log10(1 / greatest(sum(e * {m}) / sum({m}), 1e-10)), 5) END"


@query(
    "frame_metric_rows", "M10",
    f"""WITH p AS (SELECT l_returnflag AS sample, l_linenumber - 1 AS frame, l_tax AS o, l_discount AS r, pow(l_tax - l_discount, 2) AS e, l_tax - l_quantity / 100 AS le, l_discount - l_quantity / 200 AS ce, (l_suppkey % 3 <> 0)::INT::DOUBLE AS valid,
      (l_quantity > 40)::INT::DOUBLE AS detail, (CASE WHEN l_partkey % 5 = 0 THEN 1.0 ELSE 0.0 END) AS reactive, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.5 ELSE 0.0 END AS quality FROM lineitem)
    SELECT sample, frame, round(10 * log10(1 / greatest(avg(e), 1e-10)), 5) AS psnr_y, {_MASKED.format(m="(1 - valid)", n=50)} AS psnr_disocc, round(10 * log10(1 / greatest(sum(e * detail) / greatest(sum(detail), 1), 1e-10)), 5) AS psnr_detail,
      {_MASKED.format(m="(reactive > 0.1)::INT", n=50)} AS psnr_particles, CASE WHEN frame > 0 AND max(quality) >= 1 THEN round(sum(abs(le) * valid) / sum(valid), 6) END AS warp_err,
      CASE WHEN frame > 0 AND max(quality) > 0 THEN round(sum(abs(ce) * valid) / sum(valid), 6) END AS temporal_err, CASE WHEN frame > 0 AND frame % 4 = 0 THEN round(avg(r), 6) END AS tof
    FROM p WHERE frame >= 1 GROUP BY sample, frame""",
)
def frame_metric_rows(spark, sf_dir):
    quality = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 0.5).otherwise(0.0)
    p = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("sample"), (F.col("l_linenumber") - 1).alias("frame"), F.col("l_tax").alias("out"), F.col("l_discount").alias("ref"),
        (F.col("l_tax") - F.col("l_quantity") / 100).alias("last_error"), (F.col("l_discount") - F.col("l_quantity") / 200).alias("change_error"),
        (F.col("l_suppkey") % 3 != 0).cast("double").alias("valid"),
        (F.col("l_quantity") > 40).cast("double").alias("detail"), F.when(F.col("l_partkey") % 5 == 0, 1.0).otherwise(0.0).alias("reactive"),
        quality.alias("quality"), F.col("l_discount").alias("tof"),
    )
    rows = media.frame_rows(p, ["sample"])
    return rows.select("sample", "frame", *[F.round(c, 5).alias(c) for c in rows.columns[2:6]], *[F.round(c, 6).alias(c) for c in rows.columns[6:]])


@query(
    "sample_metric_rows", "M11",
    f"""WITH p AS (SELECT l_orderkey % 40 AS sample, l_tax AS o, l_discount AS r, pow(l_tax - l_discount, 2) AS e, CASE WHEN l_orderkey % 40 < 30 AND l_linenumber < 3 THEN 1.0 ELSE 0.0 END AS ui,
      (l_suppkey % 3 <> 0)::INT::DOUBLE AS valid FROM lineitem)
    SELECT sample, round(10 * log10(1 / greatest(avg(e), 1e-10)), 5) AS psnr, round(sqrt(avg(e)) * 255, 5) AS ie, CASE WHEN max(ui) > 0 THEN round(10 * log10(1 / greatest(sum(e * ui) / sum(ui), 1e-10)), 5) END AS psnr_ui,
      CASE WHEN max(ui) > 0 THEN round(avg((abs(o - r) > 0.1)::INT) FILTER (ui > 0.5), 6) END AS ui_ghost_rate, {_MASKED.format(m="(1 - valid)", n=50)} AS psnr_occluded FROM p GROUP BY sample""",
)
def sample_metric_rows(spark, sf_dir):
    sample = F.col("l_orderkey") % 40
    p = table(spark, sf_dir, "lineitem").select(
        sample.alias("sample"), F.col("l_tax").alias("out"), F.col("l_discount").alias("ref"),
        F.when((sample < 30) & (F.col("l_linenumber") < 3), 1.0).otherwise(0.0).alias("ui"), (F.col("l_suppkey") % 3 != 0).cast("double").alias("valid"),
    )
    rows = media.sample_rows(p, ["sample"])
    return rows.select("sample", *[F.round(c, 6 if c == "ui_ghost_rate" else 5).alias(c) for c in rows.columns[1:]])


@query(
    "method_table", "M13 K6",
    """WITH m AS (SELECT l_returnflag AS sequence, 'm' || l_linenumber AS method, 10 * log10(1 / greatest(avg(pow(l_tax - l_discount, 2)), 1e-10)) AS psnr FROM lineitem GROUP BY ALL),
    r AS (SELECT m.sequence, method, psnr, (substr(method, 2)::INT * 1000.0::DOUBLE * 1000 * 3 * 8 * 9) / 1e9 AS gmac FROM m)
    SELECT sequence, method, round(psnr, 5) AS psnr, round(gmac, 6) AS gmac FROM r UNION ALL SELECT 'mean', method, round(avg(psnr), 5), round(max(gmac), 6) FROM r GROUP BY method""",
)
def method_table(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("sequence"), F.concat(F.lit("m"), "l_linenumber").alias("method"), F.col("l_tax").alias("out"), F.col("l_discount").alias("ref")
    )
    layers = spark.range(1, 8).select(
        F.concat(F.lit("m"), "id").alias("method"), (F.col("id") * 1000.0).alias("height"), F.lit(1000).alias("width"), F.lit(3).alias("c_in"), F.lit(8).alias("c_out"), F.lit(3).alias("kernel"), F.lit(1).alias("groups")
    )
    rows = media.method_table(p, "sequence", "method", layers)
    return rows.select("sequence", "method", F.round("psnr", 5).alias("psnr"), F.round("gmac", 6).alias("gmac"))


@query(
    "window_cache", "K2 K3",
    f"""WITH p AS (SELECT conv_id AS item, turn AS start, role AS source, CASE WHEN turn % 3 = 0 THEN 1.0 WHEN turn % 3 = 1 THEN 0.5 END AS q, length(text) > 60 AS ok, {duck_draw("'8/' || conv_id || '/' || turn")} AS u FROM conversations),
    o AS (SELECT * FROM p ORDER BY u, item, start LIMIT 130), r AS (SELECT *, row_number() OVER (ORDER BY u, item, start) - 1 AS row_id FROM o WHERE ok)
    SELECT row_id::INT AS row_id, item, start, source, coalesce(q, 0) < 1 AS needs_motion, count(*) OVER (PARTITION BY source) AS n FROM r WHERE row_id < 100""",
)
def window_cache(spark, sf_dir):
    t = F.col("turn")
    plans = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("item"), t.alias("start"), F.col("role").alias("source"), F.when(t % 3 == 0, 1.0).when(t % 3 == 1, 0.5).alias("mv_quality"),
        (F.length("text") > 60).alias("ok"), hashing.draw(F.concat_ws("/", "conv_id", "turn"), 8).alias("u"),
    )
    rows, counts = media.window_cache(plans, 100, [F.col("u"), F.col("item"), F.col("start")])
    return rows.join(F.broadcast(counts), "source")  # a row a source


# Duplicates --------------------------------------------------------------------------------------------------------


@query(
    "verified_pairs", "J10 D8",
    """WITH m AS (SELECT l_orderkey // 12 AS a, l_orderkey // 12 + 1 AS b, CASE WHEN l_linenumber % 2 = 0 THEN 'direct' ELSE 'mirrored' END AS side, l_quantity * 5 AS x, l_discount * 2500 AS y, l_tax < 0.07 AS inlier, (l_orderkey // 12) % 4 AS kind FROM lineitem),
    s AS (SELECT a, b, side, CASE WHEN kind < 2 AND count(*) FILTER (inlier) >= 6 THEN count(DISTINCT least(greatest(floor(y / 32), 0), 7) * 8 + least(greatest(floor(x / 32), 0), 7)) FILTER (inlier) ELSE 0 END AS cells FROM m GROUP BY a, b, side, kind)
    SELECT a, b, max(cells)::INT AS cells FROM s GROUP BY a, b""",
)
def verified_pairs(spark, sf_dir):
    """Matches of pairs under four maps: two sound ones, one that mirrors, one that collapses."""
    a = F.floor(F.col("l_orderkey") / 12)
    maps = F.array(*[F.array(*map(F.lit, m)) for m in ((1.0, 0.1, 3.0, -0.1, 1.0, 2.0), (2.0, 0.0, 0.0, 0.0, 0.5, 0.0), (-1.0, 0.0, 0.0, 0.0, 1.0, 0.0), (0.1, 0.0, 0.0, 0.0, 1.0, 0.0))])
    matches = table(spark, sf_dir, "lineitem").select(
        a.alias("a"), (a + 1).alias("b"), F.when(F.col("l_linenumber") % 2 == 0, "direct").otherwise("mirrored").alias("side"), (F.col("l_quantity") * 5).alias("x"),
        (F.col("l_discount") * 2500).alias("y"), (F.col("l_tax") < 0.07).alias("inlier"), F.get(maps, F.pmod(a, F.lit(4)).cast("int")).alias("m"),
    )
    return media.verified_pairs(matches)


_DOT = "list_inner_product({0}.embedding::DOUBLE[], {1}.embedding::DOUBLE[])"
_SIGNS = "list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i] > 0 THEN (1::BIGINT << (i - 1)::INT) ELSE 0 END))::BIGINT"
_SIGNS2 = "list_sum(list_transform(range(33, 65), lambda i: CASE WHEN embedding[i] > 0 THEN (1::BIGINT << (i - 33)::INT) ELSE 0 END))::BIGINT"
_FEATURES = f"(SELECT vec_id AS k, vec_id // 3 AS grp, embedding, {_SIGNS} AS ph, {_SIGNS2} AS dh, vec_id % 7 <> 0 AS textured, vec_id % 11 <> 0 AS active FROM embeddings)"


def _frame_columns():
    """Vectors as key frames: groups of three, two hashes by signs, some without texture, some inactive."""
    return [
        F.col("vec_id").alias("k"), F.floor(F.col("vec_id") / 3).alias("grp"), "embedding", vectors.sign_bits(F.col("embedding"), 0, 32).alias("ph"),
        vectors.sign_bits(F.col("embedding"), 32, 32).alias("dh"), (F.col("vec_id") % 7 != 0).alias("textured"), (F.col("vec_id") % 11 != 0).alias("active"),
    ]


def _features(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(*_frame_columns())


@query(
    "duplicate_search", "R4 J5 J6 J7 J8 J9 R1",
    f"""WITH f AS (SELECT * FROM {_FEATURES} WHERE active), c1 AS (SELECT q, r FROM (SELECT a.k AS q, b.k AS r, {_DOT.format("a", "b")} AS s, row_number() OVER (PARTITION BY a.k ORDER BY {_DOT.format("a", "b")} DESC, b.k) AS n
      FROM f a JOIN f b ON a.grp <> b.grp) WHERE n <= 4 AND s >= 0.3::DOUBLE),
    h AS (SELECT a.k AS q, b.k AS r, bit_count(xor(a.ph, b.ph))::INT AS d FROM f a JOIN f b ON a.k < b.k AND a.grp <> b.grp AND a.textured AND b.textured WHERE bit_count(xor(a.ph, b.ph)) <= 8),
    t AS (SELECT coalesce((SELECT max(d) FROM (SELECT unnest(range(4, 9)) AS d) x WHERE (SELECT count(*) FROM h WHERE h.d <= x.d) <= (SELECT count(*) // 2 FROM f)), 4) AS radius),
    c AS (SELECT DISTINCT least(q, r) AS a, greatest(q, r) AS b FROM (SELECT q, r FROM c1 UNION ALL SELECT q, r FROM h WHERE d <= (SELECT radius FROM t))),
    s AS (SELECT c.a, c.b, round({_DOT.format("x", "y")}, 5) AS cosine, bit_count(xor(x.ph, y.ph))::INT AS hamming, bit_count(xor(x.dh, y.dh))::INT AS dhash, x.textured AND y.textured AS textured, (c.a + c.b) % 12 AS cells
      FROM c JOIN f x ON x.k = c.a JOIN f y ON y.k = c.b)
    SELECT a, b, cosine, hamming, rule FROM (SELECT *, CASE WHEN cells >= 10 THEN 'verified' WHEN cosine >= 0.4 THEN 'strong_embedding' WHEN textured AND hamming <= 6 AND dhash <= 16 THEN 'exact_hash' ELSE '' END AS rule FROM s) WHERE rule <> ''""",
)
def duplicate_search(spark, sf_dir):
    cells = lambda pairs: pairs.withColumn("cells", F.pmod(F.col("a") + F.col("b"), F.lit(12)))
    limits = LIMITS | {"t_strong": 0.4, "t_ret": 0.3, "h_exact": 6, "h_least": 4, "h_cand": 8}
    found = duplicates.find_duplicates(_features(spark, sf_dir), limits, cells, k=4, per_item=0.5, within=32)
    return found.select("a", "b", "cosine", "hamming", "rule")


@query(
    "calibration_scores", "R2 R3",
    f"""WITH f AS (SELECT * FROM {_FEATURES} WHERE active), o AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS at, count(*) OVER () AS n FROM f),
    d AS (SELECT id, floor({duck_draw("'5/a/' || id")} * n)::BIGINT AS i, floor({duck_draw("'5/b/' || id")} * n)::BIGINT AS j FROM (SELECT unnest(range(0, 400)) AS id), (SELECT max(n) AS n FROM o)),
    rn AS (SELECT x.k AS a, y.k AS b, 'random' AS kind FROM d JOIN o x ON x.at = d.i JOIN o y ON y.at = d.j WHERE x.grp <> y.grp),
    hd AS (SELECT DISTINCT least(q, r) AS a, greatest(q, r) AS b, 'hard' AS kind FROM (SELECT a.k AS q, b.k AS r, row_number() OVER (PARTITION BY a.k ORDER BY {_DOT.format("a", "b")} DESC, b.k) AS n FROM f a JOIN f b ON a.grp <> b.grp) WHERE n = 1)
    SELECT kind, a, b, round({_DOT.format("x", "y")}, 5) AS cosine, bit_count(xor(x.ph, y.ph))::INT AS hamming FROM (SELECT * FROM rn UNION ALL SELECT * FROM hd) p JOIN f x ON x.k = p.a JOIN f y ON y.k = p.b""",
)
def calibration_scores(spark, sf_dir):
    negatives = duplicates.negative_pairs(_features(spark, sf_dir), 400, 5)
    scored = duplicates.scored_pairs(negatives, _features(spark, sf_dir))
    return scored.select("kind", "a", "b", "cosine", "hamming")


def _shot_frames(spark, sf_dir):
    """``_features`` of vectors as shots of four frames, whose last is a remake of the one before: its embedding leans to it."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    last = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("last")).where(F.col("vec_id") % 4 == 3)
    mixed = F.zip_with("embedding", "last", lambda x, y: 0.35 * y + 0.94 * x)
    e = e.join(last, "vec_id", "left").select("vec_id", F.coalesce(mixed, "embedding").cast("array<float>").alias("embedding"))
    return e.select(*_frame_columns())


@query("curation_pipeline", "R15 R10 D7 D8 J10")
def curation_pipeline(spark, sf_dir):
    """From key frames to a leakage-safe split in one go, pairs verified by their pictures' features. No SQL, tested by brute force."""
    frames = _shot_frames(spark, sf_dir)
    std = F.when(F.col("k") % 13 == 0, 3.0).otherwise(40.0)
    frames = frames.select(
        "k", "grp", "embedding", "ph", "dh", "textured", F.when(F.col("k") % 29 == 0, "test").otherwise("train").alias("role"), F.lit("still").alias("kind"),
        F.lit(True).alias("ok"), F.lit(512).alias("width"), F.lit(512).alias("height"), std.alias("std"), F.lit(0.0).alias("letterbox"), F.lit(50.0).alias("sharpness"),
    )

    def cells(pairs):
        """The pictures of the pairs that are asked for, no others, are drawn and looked at."""
        pairs = scratch_table(pairs, "asked-pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
        found = scratch_table(features.with_local_features(pictures(spark, sf_dir, ends), "content"), "picture-features")
        return features.verified_by_features(pairs, found, "k", float(SIDE))

    limits = LIMITS | {"t_strong": 0.45, "t_ret": 0.3, "h_cand": 8}
    return duplicates.curate(frames, limits, cells, 0.2, 7, k=4, within=32).select("idx", "split", "reason", "component")


@query("nearest_by_cells", "J7")
def nearest_by_cells(spark, sf_dir):
    """Every fiftieth vector against all, through an inverted file; recall against the exact search is tested."""
    e = table(spark, sf_dir, "embeddings")
    n = joins.neighbours(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 5, "label", cells=32, probes=20)
    return n.select("query", "ref", F.round("similarity", 5).alias("similarity"), "rank")
