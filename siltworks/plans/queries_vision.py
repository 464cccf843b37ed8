"""Queries of image features, resampled windows and streams of job lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from siltworks.operators import batches, costs, degrade, features, images, jpeg, media, recurrence, resample, stills
from siltworks.plans.registry import duck_draw, query
from siltworks.scratch import scratch_path, scratch_table
from siltworks.ship import ship_code
from siltworks.sources.tables import table
from siltworks.streaming import jobs

#: Side of the pictures that vectors are shown as, and the frames of a shot, which show one picture.
SIDE, SHOT = 96, 4
#: Pictures that one task draws and looks at: a row is small and much work, so Spark's sizes of tasks do not fit.
TASK_PICTURES = 250


def draw_picture(vector: np.ndarray, frame: int) -> bytes:
    """A vector's 8 x 8 map as a smooth grey map file; later frames of a shot are shifted, every fourth is mirrored."""
    cell = SIDE // 8
    smooth = features._blurred(np.kron(np.asarray(vector, float).reshape(8, 8), np.ones((cell, cell))), cell / 4)
    grey = np.clip(127.5 + smooth * 400, 0, 255).astype(np.uint8)
    grey = np.roll(grey, (2 * frame, 3 * frame), (0, 1))
    return f"P5\n{SIDE} {SIDE} 255\n".encode() + (grey[:, ::-1] if frame == SHOT - 1 else grey).tobytes()


def pictures(spark, sf_dir, of=None):
    """``k, content``: the picture file of every vector, or of those with a row in ``of``, drawn from the first vector of its shot."""
    ship_code(spark)

    @F.pandas_udf("binary")
    def drawn(vector: pd.Series, frame: pd.Series) -> pd.Series:
        return pd.Series([draw_picture(v, int(f)) for v, f in zip(vector, frame, strict=True)])

    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    first = e.where(F.col("vec_id") % SHOT == 0).select(F.floor(F.col("vec_id") / SHOT).alias("shot"), "embedding")
    frames = e.select(F.col("vec_id").alias("k"), F.floor(F.col("vec_id") / SHOT).alias("shot"))
    frames, many = (frames, e.count()) if of is None else (frames.join(of.select("k"), "k", "left_semi"), of.count())
    frames = frames.join(first, "shot")
    # A number is given: by size alone adaptive execution would merge tasks.
    frames = frames.repartition(max(spark.sparkContext.defaultParallelism, -(-many // TASK_PICTURES)), "k")
    return frames.select("k", drawn("embedding", (F.col("k") % SHOT)).alias("content"))


@query("feature_pairs", "D7 D8 J10 S17")
def feature_pairs(spark, sf_dir):
    """Neighbouring pictures, from file to cells: features of picture and mirror, matches, affine map. Tested by plain loops."""
    found = features.with_local_features(pictures(spark, sf_dir), "content")
    found = scratch_table(found, "picture-features")
    pairs = found.select(F.col("k").alias("a"), (F.col("k") + 1).alias("b")).join(found.select(F.col("k").alias("b")), "b", "left_semi")
    return features.verified_by_features(pairs.select("a", "b"), found, "k", float(SIDE)).select("a", "b", "cells")


_OVERLAP = "greatest(0, least(({o} + 1) * 8.0::DOUBLE / n, {j} + 1) - greatest({o} * 8.0::DOUBLE / n, {j}))"


@query(
    "resampled_windows", "D11",
    f"""WITH c AS (SELECT vec_id, embedding, vec_id // 4 AS clip, round(8 * least(1.0::DOUBLE, greatest(0.5::DOUBLE + 0.5::DOUBLE * {duck_draw("'8/r/' || vec_id // 4")}, 4 * 1.02::DOUBLE / 8)))::INT AS n FROM embeddings),
    p AS (SELECT *, floor({duck_draw("'8/y/' || clip")} * (n - 3))::INT AS y, floor({duck_draw("'8/x/' || clip")} * (n - 3))::INT AS x FROM c),
    o AS (SELECT *, list_transform(range(0, 16), lambda i: (n / 8.0::DOUBLE) * (n / 8.0::DOUBLE) * list_sum(list_transform(range(0, 64), lambda j:
      {_OVERLAP.format(o="(y + i // 4)", j="(j // 8)")} * {_OVERLAP.format(o="(x + i % 4)", j="(j % 8)")} * embedding[j + 1]::DOUBLE))) AS image FROM p)
    SELECT clip, (vec_id % 4)::INT AS frame, n AS height, y, x, round(list_sum(list_transform(range(0, 16), lambda i: image[i + 1] * (i + 1))), 6) AS marked FROM o""",
)
def resampled_windows(spark, sf_dir):
    """Windows of four 8 x 8 maps at a drawn scale by area, cut to 4 x 4."""
    image = F.transform("embedding", lambda x: x.cast("double"))
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("clip"), (F.col("vec_id") % 4).alias("at"), image.alias("image"))
    w = resample.resampled_windows(e, "clip", "at", 4, 8, 4, (0.5, 1.0), 8, "area")
    marked = F.aggregate(F.transform("image", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return w.select("clip", "frame", "height", "y", "x", F.round(marked, 6).alias("marked"))


@query(
    "blended_maps", "T3 T5",
    """WITH RECURSIVE v AS (SELECT vec_id // 500 AS k, vec_id % 500 AS o, list_transform(embedding, lambda z: z::DOUBLE) AS x, [(vec_id % 3) - 1, (vec_id // 3) % 3 - 1] AS m FROM embeddings),
    s(k, o, h) AS (SELECT k, o, x FROM v WHERE o = 0 UNION ALL
      SELECT v.k, v.o, list_transform(range(0, 64), lambda i: 0.7::DOUBLE * least(greatest(s.h[least(greatest(i // 8 + v.m[2], 0), 7) * 8 + least(greatest(i % 8 + v.m[1], 0), 7) + 1], -0.2::DOUBLE), 0.2::DOUBLE) + 0.3::DOUBLE * v.x[i + 1]) FROM s JOIN v ON v.k = s.k AND v.o = s.o + 1)
    SELECT k * 500 + o AS vec_id, round(list_sum(list_transform(range(0, 64), lambda i: h[i + 1] * (i + 1))), 6) AS marked FROM s""",
)
def blended_maps(spark, sf_dir):
    """Vectors as 8 x 8 frames of clips of 500, each moved by up to a pixel, blended into their clamped history."""
    k, step = F.col("vec_id"), lambda i: (F.pmod(F.floor(F.col("vec_id") / i), F.lit(3)) - 1).cast("double")
    motion = F.flatten(F.array_repeat(F.array(step(1), step(3)), 64))
    e = table(spark, sf_dir, "embeddings").select(F.floor(k / 500).alias("k"), (k % 500).alias("o"), "embedding", motion.alias("m"))
    b = recurrence.blended_frames(e, "k", "o", "embedding", 0.3, -0.2, 0.2, motion="m", width=8)
    marked = F.aggregate(F.transform("state", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return b.select((F.col("k") * 500 + F.col("o")).alias("vec_id"), F.round(marked, 6).alias("marked"))


@query(
    "job_stream", "T1",
    """WITH e AS (SELECT user_id::VARCHAR AS job, event_id, event_id % 5 AS kind, value FROM events),
    l AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY event_id DESC) AS back FROM e)
    SELECT job, count(*) AS n_lines, count(*) FILTER (kind = 2) AS n_bad, count(*) FILTER (kind = 1) AS n_rounds, round(arg_max(value, event_id) FILTER (kind = 0), 6) AS progress,
      arg_max(event_id // 10, event_id) FILTER (kind = 1) AS round, round(arg_max(value, event_id) FILTER (kind = 1), 6) AS score, bool_or(kind = 4 AND event_id % 7 = 0) AS done,
      string_agg(event_id::VARCHAR, ' ' ORDER BY event_id) FILTER (back <= 40) AS tail FROM l GROUP BY job""",
)
def job_stream(spark, sf_dir):
    """Events as lines of one job a user, in files; two runs of the stream, the second over files that came after the first ended."""
    k = F.col("event_id")
    bodies = {
        0: F.concat(F.lit("PROGRESS "), F.to_json(F.struct(F.col("value").alias("progress")))),
        1: F.concat(F.lit("ROUND "), F.to_json(F.struct(F.floor(k / 10).cast("long").alias("round"), F.col("value").alias("score")))),
        2: F.lit("ROUND {bad"),
        3: F.concat(F.lit("text of step "), k),
        4: F.when(k % 7 == 0, F.concat(F.lit("DONE "), F.to_json(F.struct(k.alias("step"))))).otherwise(F.lit("LOG {}")),
    }
    line = F.coalesce(*[F.when(k % 5 == i, body) for i, body in bodies.items()])
    events = table(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", "user_id", "event_id", line).alias("value"))
    at = {name: scratch_path(spark, f"jobs-{name}") for name in ("lines", "checkpoint", "states")}
    half = events.agg(F.avg("event_id")).first()[0] or 0
    for part in (events.where(k <= half), events.where(k > half)):
        part.repartitionByRange(4, "event_id").select("value").write.mode("append").text(at["lines"])
        jobs.run_jobs(spark, at["lines"], at["checkpoint"], at["states"])
    s = jobs.latest_states(spark, at["states"])
    return s.select(
        "job", "n_lines", "n_bad", "n_rounds", F.round("progress", 6).alias("progress"), "round", F.round("score", 6).alias("score"), "done",
        F.array_join(F.col("tail_at").cast("array<string>"), " ").alias("tail"),
    )


@query(
    "jpeg_images", "S17 D2",
    """SELECT vec_id, CASE WHEN vec_id % 10 <> 9 THEN 24 END AS width, CASE WHEN vec_id % 10 <> 9 THEN 24 END AS height, CASE WHEN vec_id % 10 <> 9 THEN true END AS close, vec_id % 10 = 9 AS damaged,
      CASE WHEN vec_id % 10 <> 9 THEN true END AS mean_close FROM embeddings""",
)
def jpeg_images(spark, sf_dir):
    """Vectors as grey JPEG files of nine blocks, every tenth cut short, decoded again: within one grey level of what was encoded."""
    ship_code(spark)

    @F.pandas_udf("binary")
    def encoded(vector: pd.Series, k: pd.Series) -> pd.Series:
        grey = [np.kron(np.minimum(255, np.floor(np.abs(np.asarray(v, float)) * 400)).reshape(8, 8), np.ones((3, 3))) for v in vector]
        files = [jpeg.encode_jpeg(g) for g in grey]
        return pd.Series([f[: len(f) // 2] if i % 10 == 9 else f for f, i in zip(files, k, strict=True)])

    pixel = F.transform("embedding", lambda x: F.least(F.lit(255.0), F.floor(F.abs(x.cast("double")) * 400)))
    place = F.sequence(F.lit(0), F.lit(575))
    grey = F.transform(place, lambda i: F.get("pixel", (F.floor(F.floor(i / 24) / 3) * 8 + F.floor(F.pmod(i, F.lit(24)) / 3)).cast("int")))
    e = table(spark, sf_dir, "embeddings").select("vec_id", encoded("embedding", "vec_id").alias("content"), pixel.alias("pixel"))
    found = images.decode_images(e.select(F.col("vec_id").cast("string").alias("path"), "content"), 24)
    both = found.join(e.select(F.col("vec_id").cast("string").alias("path"), grey.alias("grey")), "path")
    off = F.array_max(F.zip_with("thumb", "grey", lambda a, b: F.abs(a - b)))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / 576
    return both.select(
        F.col("path").cast("long").alias("vec_id"), "width", "height", (off <= 1.0).alias("close"), F.col("error").isNotNull().alias("damaged"),
        (F.abs(mean("thumb") - mean("grey")) < 0.2).alias("mean_close"),
    )


@query("degraded_maps", "G7")
def degraded_maps(spark, sf_dir):
    """Vectors as 8 x 8 frames of clips of eight, shown as a video of half the resolution. No SQL, tested by plain loops."""
    image = F.transform("embedding", lambda x: F.least(F.lit(1.0), F.abs(x.cast("double")) * 2))
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("clip"), F.col("vec_id").alias("frame"), image.alias("image"))
    return degrade.degraded_frames(e, "clip", "frame", "image", 8, 2, 9, step=6.0)


@query(
    "video_inputs", "G7 F13",
    f"""WITH s AS (SELECT doc_id, doc_id % 3 AS kind, doc_id % 2 = 0 AS has_depth, doc_id / 1000.0::DOUBLE AS jitter, (doc_id % 5) / 4.0::DOUBLE AS q, {duck_draw("'4/video/' || doc_id")} < 0.4 AS v, {duck_draw("'4/motion/' || doc_id")} < 0.3 AS m FROM documents)
    SELECT doc_id, CASE WHEN v THEN 0 ELSE kind END AS kind, has_depth AND NOT v AS has_depth, CASE WHEN v THEN 0.0::DOUBLE ELSE jitter END AS jitter,
      CASE WHEN v AND m THEN least(q, 0.5::DOUBLE) WHEN v THEN 0.0 ELSE q END AS mv_quality, v AS is_video FROM s""",
)
def video_inputs(spark, sf_dir):
    k = F.col("doc_id")
    s = table(spark, sf_dir, "documents").select(
        "doc_id", (k % 3).alias("kind"), (k % 2 == 0).alias("has_depth"), (k / 1000.0).alias("jitter"), ((k % 5) / 4.0).alias("mv_quality")
    )
    return degrade.video_inputs(s, "doc_id", 4, 0.4, 0.3)


@query(
    "temporal_losses", "M12 M8",
    """WITH v AS (SELECT vec_id // 20 AS clip, vec_id % 20 AS frame, list_transform(embedding, lambda z: z::DOUBLE) AS o, list_transform(list_reverse(embedding), lambda z: z::DOUBLE) AS r FROM embeddings),
    p AS (SELECT a.clip, a.frame, list_transform(range(0, 64), lambda i: abs((a.o[i + 1] - b.o[least(greatest(i // 8 + (a.frame // 3) % 3 - 1, 0), 7) * 8 + least(greatest(i % 8 + a.frame % 3 - 1, 0), 7) + 1])
      - (a.r[i + 1] - b.r[least(greatest(i // 8 + (a.frame // 3) % 3 - 1, 0), 7) * 8 + least(greatest(i % 8 + a.frame % 3 - 1, 0), 7) + 1])) * ((i + a.frame) % 4 <> 0)::INT) AS gap FROM v a JOIN v b ON a.clip = b.clip AND a.frame = b.frame + 1)
    SELECT clip, frame, round(list_sum(gap) / 48, 6) AS temporal FROM p""",
)
def temporal_losses(spark, sf_dir):
    """Vectors as frames of clips of twenty, moved by up to a pixel; the output is the vector, the target its reverse."""
    k, place = F.col("vec_id"), F.sequence(F.lit(0), F.lit(63))
    frame = k % 20
    motion = F.flatten(F.array_repeat(F.array((frame % 3 - 1).cast("double"), (F.pmod(F.floor(frame / 3), F.lit(3)) - 1).cast("double")), 64))
    seen = F.transform(place, lambda i: F.when((i + frame) % 4 != 0, 1.0).otherwise(0.0))
    e = table(spark, sf_dir, "embeddings").select(F.floor(k / 20).alias("clip"), frame.alias("frame"), F.col("embedding").alias("out"), F.reverse("embedding").alias("ref"), motion.alias("motion"), seen.alias("seen"))
    t = degrade.with_temporal_loss(degrade.neighbouring(e, "clip", "frame", ["out", "ref"]), "out", "ref", "motion", "seen", 8)
    return t.select("clip", "frame", F.round("temporal", 6).alias("temporal"))


_WAVE = "list_sum(list_transform(range(0, 64), lambda i: {x}[i + 1]::DOUBLE * {f}(2 * pi() * ((i // 8) * (k // 5) + (i % 8) * (k % 5)) / 8))) / 8"


@query(
    "spectrum_losses", "M12",
    f"""SELECT vec_id, round(list_sum(list_transform(range(0, 40), lambda k: abs(sqrt(pow({_WAVE.format(x="embedding", f="cos")}, 2) + pow({_WAVE.format(x="embedding", f="sin")}, 2))
      - sqrt(pow({_WAVE.format(x="other", f="cos")}, 2) + pow({_WAVE.format(x="other", f="sin")}, 2))))) / 40, 6) AS spectrum FROM (SELECT vec_id, embedding,
      list_transform(range(0, 64), lambda i: embedding[(i * 5) % 64 + 1]) AS other FROM embeddings)""",
)
def spectrum_losses(spark, sf_dir):
    """Vectors as 8 x 8 images against their own pixels in another order."""
    other = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("embedding", F.pmod(i * 5, F.lit(64))))
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"), other.cast("array<double>").alias("b"))
    return media.with_losses(e, "a", "b", 8).select("vec_id", F.round("spectrum", 6).alias("spectrum"))


def _doubles(spark, sf_dir, *extra):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), *extra)


def _marked(c):
    """One number of a flat array that tells its order too."""
    return F.round(F.aggregate(F.transform(c, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v), 5).alias("marked")


@query(
    "jitter_upsampled", "G9",
    """WITH p AS (SELECT vec_id, unnest(range(0, 256)) AS i, embedding AS e FROM embeddings),
    s AS (SELECT *, least(greatest((i % 16 + 0.5::DOUBLE) / 2 - (vec_id % 4 * 0.25::DOUBLE - 0.375) - 0.5, 0), 7) AS sx, least(greatest((i // 16 + 0.5::DOUBLE) / 2 - (vec_id % 3 * 0.25::DOUBLE - 0.25) - 0.5, 0), 7) AS sy FROM p),
    g AS (SELECT *, floor(sx)::INT AS x0, floor(sy)::INT AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy, least(floor(sx)::INT + 1, 7) AS x1, least(floor(sy)::INT + 1, 7) AS y1 FROM s)
    SELECT vec_id, round(sum((i + 1) * ((e[y0 * 8 + x0 + 1]::DOUBLE * (1 - fx) + e[y0 * 8 + x1 + 1]::DOUBLE * fx) * (1 - fy) + (e[y1 * 8 + x0 + 1]::DOUBLE * (1 - fx) + e[y1 * 8 + x1 + 1]::DOUBLE * fx) * fy)), 5) AS marked FROM g GROUP BY vec_id""",
)
def jitter_upsampled(spark, sf_dir):
    """Vectors as 8 x 8 renders with a jitter of their own, on a grid twice as fine."""
    k = F.col("vec_id")
    e = _doubles(spark, sf_dir, F.array((k % 4) * 0.25 - 0.375, (k % 3) * 0.25 - 0.25).alias("jitter"))
    up = lambda v, j: resample.jitter_upsample(v.reshape(8, 8), (j[0], j[1]), 2)
    return resample.with_plane(e, ["v", "jitter"], up, "fine").select("vec_id", _marked("fine"))


@query(
    "depth_normals", "G9",
    """WITH p AS (SELECT vec_id, unnest(range(0, 64)) AS i, embedding AS e FROM embeddings),
    g AS (SELECT vec_id, i, (e[(i // 8) * 8 + least(i % 8 + 1, 7) + 1]::DOUBLE - e[(i // 8) * 8 + greatest(i % 8 - 1, 0) + 1]::DOUBLE) * 8 AS gx,
      (e[least(i // 8 + 1, 7) * 8 + i % 8 + 1]::DOUBLE - e[greatest(i // 8 - 1, 0) * 8 + i % 8 + 1]::DOUBLE) * 8 AS gy FROM p)
    SELECT vec_id, round(sum((-gx * (3 * i + 1) - gy * (3 * i + 2) + (3 * i + 3)) / sqrt(gx * gx + gy * gy + 1)), 5) AS marked FROM g GROUP BY vec_id""",
)
def depth_normals(spark, sf_dir):
    normals = resample.with_plane(_doubles(spark, sf_dir), ["v"], lambda v: resample.depth_normals(v.reshape(8, 8)), "normals")
    return normals.select("vec_id", _marked("normals"))


@query(
    "fine_flows", "G9 G6",
    """WITH p AS (SELECT vec_id, unnest(range(0, 192)) AS i, embedding AS e FROM embeddings),
    s AS (SELECT *, least(i // 2 // 12, 7) AS yy, least(i // 2 % 12, 15) AS xx, i % 2 AS c FROM p),
    t AS (SELECT *, least(greatest((least(yy, 7) + 0.5::DOUBLE) / 2 - 0.5, 0), 3) AS sy, least(greatest((least(xx, 9) + 0.5::DOUBLE) / 2 - 0.5, 0), 4) AS sx FROM s),
    g AS (SELECT *, floor(sx)::INT AS x0, floor(sy)::INT AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy, least(floor(sx)::INT + 1, 4) AS x1, least(floor(sy)::INT + 1, 3) AS y1 FROM t)
    SELECT vec_id, round(sum((i + 1) * 2 * ((e[(y0 * 5 + x0) * 2 + c + 1]::DOUBLE * (1 - fx) + e[(y0 * 5 + x1) * 2 + c + 1]::DOUBLE * fx) * (1 - fy) + (e[(y1 * 5 + x0) * 2 + c + 1]::DOUBLE * (1 - fx) + e[(y1 * 5 + x1) * 2 + c + 1]::DOUBLE * fx) * fy)), 5) AS marked FROM g GROUP BY vec_id""",
)
def fine_flows(spark, sf_dir):
    """The first 4 x 5 x 2 numbers of a vector as a field, twice as fine and padded to multiples of four: 8 x 12."""
    fine = lambda v: resample.pad_to(resample.upsample_flow(v[:40].reshape(4, 5, 2), 2), 4)
    return resample.with_plane(_doubles(spark, sf_dir), ["v"], fine, "flow").select("vec_id", _marked("flow"))


@query(
    "full_clips", "D12",
    """WITH c AS (SELECT vec_id // 4 AS clip, 3 - vec_id % 4 AS frame, embedding AS e FROM embeddings), n AS (SELECT clip FROM c GROUP BY clip HAVING count(*) = 4),
    f AS (SELECT clip, frame, e, list_transform(range(0, 24), lambda i: e[(i // 6 + 2) * 8 + i % 6 + 2]::DOUBLE) AS image, list_transform(range(0, 48), lambda i: CASE WHEN frame = 0 THEN 0 ELSE e[((i // 12 + 2) * 8 + i % 12 // 2 + 1) % 32 * 2 + i % 2 + 1]::DOUBLE END) AS flow FROM c)
    SELECT clip, 4 AS n, 2 AS y, 1 AS x, true AS exact, round(sum((frame + 1) * list_sum(list_transform(range(0, 24), lambda i: image[i + 1] * (i + 1)))), 5) AS images,
      round(sum((frame + 1) * list_sum(list_transform(range(0, 48), lambda i: flow[i + 1] * (i + 1)))), 5) AS flows FROM f WHERE clip IN (SELECT clip FROM n) GROUP BY clip""",
)
def full_clips(spark, sf_dir):
    """Vectors as clips of four 8 x 8 frames with a field of the same numbers twice, played backwards, the middle 4 x 6 of each."""
    k = F.col("vec_id")
    e = _doubles(spark, sf_dir).select(F.floor(k / 4).alias("clip"), (k % 4).alias("at"), F.col("v").alias("image"), F.concat("v", "v").alias("flow"))
    clips = resample.full_clips(e, "clip", "at", 4, 8, (4, 6))
    total = lambda plane: F.round(F.aggregate("frames", F.lit(0.0), lambda s, f: s + (f["frame"] + 1) * F.aggregate(F.transform(f[plane], lambda v, i: v * (i + 1)), F.lit(0.0), lambda t, v: t + v)), 5)
    return clips.select("clip", F.size("frames").alias("n"), "y", "x", "exact", total("image").alias("images"), total("flow").alias("flows"))


@query(
    "graph_costs", "N5",
    """WITH RECURSIVE p AS (SELECT p_partkey // 8 AS model, p_partkey % 8 AS node, p_partkey % 32 + 1 AS c, p_size + 8 AS h FROM part),
    r(model, i, hs, ws, cs, macs, params) AS (SELECT model, 0::BIGINT, [h::BIGINT], [16::BIGINT], [c::BIGINT], 0.0::DOUBLE, 0::BIGINT FROM p WHERE node = 0 UNION ALL
      SELECT model, j, list_append(hs, ho), list_append(ws, wo), list_append(cs, co), macs + CASE WHEN j IN (3, 6) THEN 0 WHEN j = 7 THEN hi * wi * ci * co * 9.0 ELSE ho * wo * ci * co * 9.0 END,
        params + CASE WHEN j IN (3, 6) THEN 0 ELSE ci * co * 9 + co END FROM (
        SELECT *, CASE j WHEN 4 THEN (hi + 1) // 2 WHEN 7 THEN hi * 2 ELSE hi END AS ho, CASE j WHEN 4 THEN (wi + 1) // 2 WHEN 7 THEN wi * 2 ELSE wi END AS wo, CASE WHEN j IN (3, 6) THEN ci ELSE c END::BIGINT AS co FROM (
          SELECT r.*, p.c, i + 1 AS j, hs[i + 1] AS hi, ws[i + 1] AS wi, CASE i + 1 WHEN 3 THEN cs[3] + cs[1] WHEN 6 THEN cs[6] + cs[5] ELSE cs[i + 1] END AS ci FROM r JOIN p ON p.model = r.model AND p.node = r.i + 1)))
    SELECT model, max(i) + 1 AS layers, round(max(macs) / 1e9, 9) AS gmac, max(params) AS parameters FROM r GROUP BY model""",
)
def graph_costs(spark, sf_dir):
    """Parts as layers of networks of eight, with two branches that join again."""
    ops = ("input", "conv", "conv", "concat", "conv", "conv", "concat", "deconv")
    k = F.col("p_partkey")
    nodes = table(spark, sf_dir, "part").select(
        F.floor(k / 8).alias("model"), (k % 8).alias("node"), F.element_at(F.array(*map(F.lit, ops)), (k % 8 + 1).cast("int")).alias("op"), (k % 32 + 1).alias("c_out"),
        F.lit(3).alias("kernel"), F.when((k % 8).isin(4, 7), 2).otherwise(1).alias("stride"), F.lit(1).alias("groups"), (F.col("p_size") + 8).alias("height"), F.lit(16).alias("width"),
    )
    leads = F.explode(F.when(F.col("node") == 3, F.array(F.lit(2), F.lit(0))).when(F.col("node") == 6, F.array(F.lit(5), F.lit(4))).otherwise(F.array((F.col("node") - 1).cast("int"))))
    edges = nodes.where("node > 0").select("model", F.col("node").alias("dst"), leads.alias("src"))
    return costs.graph_costs(nodes, edges).select("model", "layers", F.round("gmac", 9).alias("gmac"), "parameters")


@query("still_cache", "K2 P6 F5")
def still_cache(spark, sf_dir):
    """Vectors as 8 x 8 images, pieces of 5 x 5 at a drawn scale: a cache for a third of all pieces. No SQL, tested by plain loops."""
    grey = F.transform("embedding", lambda x: F.abs(x.cast("double")) * 500)
    e = table(spark, sf_dir, "embeddings").select("vec_id", grey.alias("image"))
    return stills.still_cache(e, "vec_id", "image", 8, e.count(), 5, 3, 7, (0.6, 1.0), 30.0)


@query("lengths_in_batches", "D10", "SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n, len(list_distinct(string_split(coalesce(text, ''), ' ')))::BIGINT AS words FROM documents")
def lengths_in_batches(spark, sf_dir):
    """A function of data frames over all rows, batch by batch, as an ordered thread map does on one machine."""

    def count(batch: pd.DataFrame) -> pd.DataFrame:
        texts = [t or "" for t in batch["text"]]
        return pd.DataFrame({"doc_id": batch["doc_id"], "n": [len(t) for t in texts], "words": [len(set(t.split(" "))) for t in texts]})

    return media.batches_of(table(spark, sf_dir, "documents").select("doc_id", "text"), count, "doc_id bigint, n bigint, words bigint")


@query("render_samples", "G6 P7")
def render_samples(spark, sf_dir):
    """Vectors as cached windows of four 8 x 8 frames, with motion, validity and depth at half that size. No SQL, tested by plain loops."""
    k, v = F.col("vec_id"), F.transform("embedding", lambda x: x.cast("double"))
    e = table(spark, sf_dir, "embeddings").select(F.floor(k / 4).alias("clip"), (k % 4).alias("frame"), v.alias("v"))
    w = e.select(
        "clip", "frame", F.transform("v", lambda x: F.least(F.lit(1.0), F.abs(x) * 2)).alias("image"), F.slice("v", 1, 32).alias("flow"),
        F.transform(F.slice("v", 33, 16), lambda x: F.when(x > 0, 1.0).otherwise(0.0)).alias("valid"), F.when(F.col("clip") % 3 != 0, F.slice("v", 49, 16)).alias("depth"),
    )
    return batches.render_samples(w, "clip", "frame", 8, 1, 2, 11)


@query(
    "frame_roles", "G6 P5",
    f"""WITH d AS (SELECT doc_id, {duck_draw("'12/extrap/' || doc_id")} < 0.4 AS e, {duck_draw("'12/many/' || doc_id")} < 0.5 AS m, {duck_draw("'12/second/' || doc_id")} < 0.5 AS s FROM documents)
    SELECT doc_id, e AS extrap, NOT e AND m AS many, CASE WHEN NOT e AND m THEN 3 ELSE 2 END AS i1, CASE WHEN e THEN 3 WHEN m AND s THEN 2 ELSE 1 END AS target,
      round(CASE WHEN e THEN 1.5 WHEN m AND s THEN 2.0 / 3 WHEN m THEN 1.0 / 3 ELSE 0.5 END::DOUBLE, 9) AS tau FROM d""",
)
def frame_roles(spark, sf_dir):
    r = table(spark, sf_dir, "documents").select("doc_id", batches.frame_roles(F.col("doc_id"), 12, 0.4, 0.5).alias("r"))
    return r.select("doc_id", "r.extrap", "r.many", "r.i1", "r.target", F.round("r.tau", 9).alias("tau"))


@query(
    "flow_distances", "M8",
    """SELECT a.vec_id, round(list_sum(list_transform(range(0, 32), lambda i: sqrt(pow(a.embedding[2 * i + 1]::DOUBLE - b.embedding[2 * i + 1]::DOUBLE, 2) + pow(a.embedding[2 * i + 2]::DOUBLE - b.embedding[2 * i + 2]::DOUBLE, 2)))) / 32, 6) AS distance
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1""",
)
def flow_distances(spark, sf_dir):
    """Vectors as estimated motion of an output against that of the frame before it: the input of a flow-based temporal metric."""
    e = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("clip"), "vec_id", F.col("embedding").alias("flow"))
    both = degrade.neighbouring(e, "clip", "vec_id", ["flow"])
    return both.select("vec_id", F.round(degrade.flow_distance(F.col("flow"), F.col("flow_before")), 6).alias("distance"))
