"""Metric rows, losses, cost counters and caches over tables of pixels, features and plans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.operators.arrays import ghost_rate, interpolation_error, masked_mean, psnr, thumb_statistics
from siltworks.operators.prefix import with_running
from siltworks.ship import ship_code

#: Cells along a side of the grid that matches are counted on.
GRID = 8


def with_thumb_statistics(df: DataFrame, image: str, width: int) -> DataFrame:
    """Add ``mean, std, sharpness, letterbox`` of a flat grey image with rows of ``width``; null arrays give nulls."""
    ship_code(df.sparkSession)

    @F.pandas_udf("mean double, std double, sharpness double, letterbox double")
    def statistics(cells: pd.Series) -> pd.DataFrame:
        names = ["mean", "std", "sharpness", "letterbox"]
        rows = [dict.fromkeys(names) if v is None else thumb_statistics(np.reshape(np.asarray(v, float), (-1, width))) for v in cells]
        return pd.DataFrame(rows, columns=names, dtype="float64")

    return df.withColumn("__s", statistics(image)).select(*df.columns, "__s.*")


def covered_cells(matches: DataFrame, pair: list[str], size: float = 256.0, least: int = 6) -> DataFrame:
    """``pair, cells``: cells of the first image that inlying matches ``x, y`` cover; 0 with fewer than ``least`` of them.

    ``m`` is the fitted map of the pair as an array of six: maps that mirror, or whose least and largest scale leave
    0.2 to 5, count for nothing.
    """
    a, b, c, d = (F.get("m", F.lit(i)) for i in (0, 1, 3, 4))
    det, squares = a * d - b * c, a * a + b * b + c * c + d * d
    root = F.sqrt(F.greatest(squares * squares - 4 * det * det, F.lit(0.0)))
    large, small = F.sqrt((squares + root) / 2), F.sqrt(F.greatest((squares - root) / 2, F.lit(0.0)))
    sound = F.coalesce((det > 0) & (small >= 0.2) & (large <= 5.0), F.lit(False))
    cell = lambda v: F.least(F.greatest(F.floor(F.col(v) * GRID / size), F.lit(0)), F.lit(GRID - 1))
    inside = F.col("inlier") & sound
    found = matches.groupBy(*pair).agg(
        F.count_if(inside).alias("n"), F.count_distinct(F.when(inside, cell("y") * GRID + cell("x"))).alias("cells")
    )
    return found.select(*pair, F.when(F.col("n") >= least, F.col("cells")).otherwise(0).cast("int").alias("cells"))


def verified_pairs(matches: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``a, b, cells``: the better of a pair's direct and mirrored score, by the ``side`` of its matches."""
    return covered_cells(matches, [a, b, "side"]).groupBy(a, b).agg(F.max("cells").alias("cells"))


def window_cache(plans: DataFrame, capacity: int, order: list[Column], over: float = 1.3) -> tuple[DataFrame, DataFrame]:
    """Rows of a cache of windows and the number of each source: ``(row_id, item, start, source, needs_motion)``, ``(source, n)``.

    ``over`` times ``capacity`` windows are planned, as some fail; those that were decoded (``ok``) fill the rows in order
    until the cache is full. Windows whose motion is not exact are marked. Plans are ranked over range partitions: a cache of
    any capacity is never one task's.
    """
    ok = F.coalesce(F.col("ok"), F.lit(False))
    ranked = with_running(plans.withColumn("ok", ok), order, {"filled": F.col("ok").cast("long")}, "at")
    rows = ranked.where(F.col("ok") & (F.col("at") <= int(capacity * over)) & (F.col("filled") <= capacity))
    rows = rows.withColumn("row_id", (F.col("filled") - 1).cast("int"))
    rows = rows.select("row_id", "item", "start", "source", (F.coalesce("mv_quality", F.lit(0.0)) < 1.0).alias("needs_motion"))
    return rows, rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def _masked_psnr(error: Column, mask: Column, least: int) -> Column:
    """Aggregate: PSNR over a mask, null where it has ``least`` pixels or fewer."""
    return F.when(F.sum(mask) > least, psnr(F.try_divide(F.sum(error * mask), F.sum(mask))))


def frame_rows(pixels: DataFrame, keys: list[str], every: int = 4, skip_first: int = 1) -> DataFrame:
    """One row of metrics a sample and frame from pixels ``out, ref, last_error, change_error, valid, detail, reactive,
    quality, tof``.

    PSNR over all pixels, those that were hidden before, detail and reactive ones (null where 50 or fewer are); the mean
    difference to the frame before along the motion (``last_error``) only for frames after the first with exact motion;
    that of the changes of output and target (``change_error``) only where motion is known at all; costly metrics (``tof``)
    every so many frames. Frames before ``skip_first`` are left out.
    """
    error = F.pow(F.col("out") - F.col("ref"), F.lit(2.0))
    n = F.col("frame")
    rows = pixels.where(n >= skip_first).groupBy(*keys, "frame").agg(
        psnr(F.avg(error)).alias("psnr_y"),
        _masked_psnr(error, 1.0 - F.col("valid"), 50).alias("psnr_disocc"),
        psnr(F.try_divide(F.sum(error * F.col("detail")), F.greatest(F.sum("detail"), F.lit(1.0)))).alias("psnr_detail"),
        _masked_psnr(error, (F.col("reactive") > 0.1).cast("double"), 50).alias("psnr_particles"),
        masked_mean(F.abs(F.col("last_error")), F.col("valid")).alias("warp"),
        masked_mean(F.abs(F.col("change_error")), F.col("valid")).alias("change"),
        F.max("quality").alias("quality"),
        F.avg("tof").alias("tof_mean"),
    )
    return rows.select(
        *keys, "frame", "psnr_y", "psnr_disocc", "psnr_detail", "psnr_particles",
        F.when((n > 0) & (F.col("quality") >= 1.0), F.col("warp")).alias("warp_err"),
        F.when((n > 0) & (F.col("quality") > 0), F.col("change")).alias("temporal_err"),
        F.when((n > 0) & (n % every == 0), F.col("tof_mean")).alias("tof"),
    )


def sample_rows(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """One row of metrics a sample from pixels ``out, ref, ui, valid``: over all, the interface and hidden pixels, ghosts."""
    error, ui = F.pow(F.col("out") - F.col("ref"), F.lit(2.0)), (F.col("ui") > 0.5).cast("double")
    return pixels.groupBy(*keys).agg(
        psnr(F.avg(error)).alias("psnr"),
        interpolation_error(F.col("out"), F.col("ref")).alias("ie"),
        F.when(F.max(ui) > 0, psnr(F.try_divide(F.sum(error * ui), F.sum(ui)))).alias("psnr_ui"),
        F.when(F.max(ui) > 0, ghost_rate(F.abs(F.col("out") - F.col("ref")), F.col("ui") > 0.5)).alias("ui_ghost_rate"),
        _masked_psnr(error, 1.0 - F.col("valid"), 50).alias("psnr_occluded"),
    )


def method_table(pixels: DataFrame, sequence: str, method: str, layers: DataFrame) -> DataFrame:
    """``sequence, method, psnr, gmac``: PSNR of each method on each sequence and its cost, and a ``mean`` row a method."""
    error = F.pow(F.col("out") - F.col("ref"), F.lit(2.0))
    rows = pixels.groupBy(sequence, method).agg(psnr(F.avg(error)).alias("psnr")).join(multiply_adds(layers, method).drop("parameters"), method)
    means = rows.groupBy(method).agg(F.avg("psnr").alias("psnr"), F.max("gmac").alias("gmac")).withColumn(sequence, F.lit("mean"))
    return rows.unionByName(means)


def multiply_adds(layers: DataFrame, model: str) -> DataFrame:
    """``model, gmac, parameters`` from convolutions ``height, width, c_in, c_out, kernel, groups``, biases included."""
    weights = F.col("c_in") * F.col("c_out") * F.col("kernel") * F.col("kernel") / F.col("groups")
    return layers.groupBy(model).agg(
        (F.sum(F.col("height") * F.col("width") * weights) / 1e9).alias("gmac"), F.sum(weights + F.col("c_out")).cast("long").alias("parameters")
    )


def with_losses(df: DataFrame, a: str, b: str, width: int) -> DataFrame:
    """Add ``gradient``, ``spectrum`` and ``census`` losses of two flat grey images with rows of ``width``.

    See ``gradient_loss``, ``spectrum_loss`` and ``census_loss``. Null where either is null.
    """
    ship_code(df.sparkSession)

    @F.pandas_udf("gradient double, spectrum double, census double")
    def losses(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        names = ["gradient", "spectrum", "census"]
        rows = []
        for p, q in zip(x, y, strict=True):
            if p is None or q is None:
                rows.append(dict.fromkeys(names))
                continue
            one, two = (np.reshape(np.asarray(v, float), (-1, width)) for v in (p, q))
            rows.append(dict(zip(names, (gradient_loss(one, two), spectrum_loss(one, two), census_loss(one, two)), strict=True)))
        return pd.DataFrame(rows, columns=names, dtype="float64")

    return df.withColumn("__l", losses(a, b)).select(*df.columns, "__l.*")


def gradient_loss(a: np.ndarray, b: np.ndarray) -> float:
    """Mean absolute difference of central differences along each axis, both added."""
    d = a - b
    return float(np.abs(d[:, 2:] - d[:, :-2]).mean() + np.abs(d[2:] - d[:-2]).mean())


def spectrum_loss(a: np.ndarray, b: np.ndarray) -> float:
    """Mean absolute difference of the magnitudes of the orthonormal spectra (their non-negative half)."""
    one, two = (np.abs(np.fft.rfft2(z, norm="ortho")) for z in (a, b))
    return float(np.abs(one - two).mean())


def census_loss(a: np.ndarray, b: np.ndarray, patch: int = 7) -> float:
    """Soft census distance: each neighbour's difference to the centre is squashed, squared differences of that saturate.

    Over pixels whose whole patch lies in the image; 0.81 and 0.1 are the published scales for values in 0 to 1.
    """
    half = patch // 2

    def squashed(z: np.ndarray) -> np.ndarray:
        d = np.lib.stride_tricks.sliding_window_view(z, (patch, patch)) - z[half:-half, half:-half, None, None]
        return d / np.sqrt(0.81 + d * d)

    gap = (squashed(a) - squashed(b)) ** 2
    return float((gap / (0.1 + gap)).mean())


def block_motion(pixels: DataFrame, keys: list[str], scale: int) -> DataFrame:
    """``keys, by, bx, mx, my, valid``: motion in blocks of ``scale`` pixels, in units of blocks; valid where all pixels are.

    Pixels are ``y, x, mx, my, valid``; a block at the edge has the pixels that are there.
    """
    block = lambda c: F.floor(F.col(c) / scale).alias(f"b{c}")
    return pixels.groupBy(*keys, block("y"), block("x")).agg(
        (F.avg("mx") / scale).alias("mx"), (F.avg("my") / scale).alias("my"), (F.avg(F.col("valid").cast("double")) > 0.999).alias("valid")
    )


def flip_flow(flow: Column, width: int) -> Column:
    """A flat flow field (x, y, x, y, ...) with rows of ``width`` mirrored left to right: places turn, x changes sign."""
    at = F.sequence(F.lit(0), (F.size(flow) / 2).cast("int") - 1)

    def cell(i: Column) -> Column:
        there = F.floor(i / width).cast("int") * width + (width - 1 - F.pmod(i, F.lit(width)))
        return F.array(-F.get(flow, 2 * there), F.get(flow, 2 * there + 1))

    return F.flatten(F.transform(at, cell))


def image_subset(files: DataFrame, role: str, n: int, seed: int) -> DataFrame:
    """``n`` images of each role, those with the least hash of path and seed; other files are left out."""
    from siltworks.functions.hashing import draw
    from siltworks.sources.catalogue import image_files

    line = Window.partitionBy(role).orderBy(draw(F.col("path"), seed), "path")
    return image_files(files).withColumn("__at", F.row_number().over(line)).where(F.col("__at") <= n).drop("__at")


def batches_of(rows: DataFrame, function, schema: str) -> DataFrame:
    """A function of data frames over all rows, in Arrow batches: what an ordered thread map does on one machine."""
    ship_code(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return rows.mapInPandas(run, schema)
