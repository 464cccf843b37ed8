"""Frames as ordinary video shows them: softened, at lower resolution, noisy, coded in blocks; and losses between neighbouring frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.hashing import draw
from siltworks.operators.arrays import backward_warp
from siltworks.operators.jpeg import quantised, restored
from siltworks.operators.resample import resample
from siltworks.ship import ship_code

FILTERS = ("bicubic", "bilinear", "area")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def uniforms(seed: int, n: int) -> np.ndarray:
    """``n`` numbers in [0, 1) that follow from a 64-bit seed alone, by mixing it with a counter."""
    z = np.uint64(seed % (1 << 64)) + _ODD * np.arange(1, n + 1, dtype=np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)


def noise(seed: int, n: int) -> np.ndarray:
    """``n`` normal numbers that follow from a seed alone, each of two uniform ones."""
    u = uniforms(seed, 2 * n)
    return np.sqrt(-2 * np.log1p(-u[:n])) * np.cos(2 * np.pi * u[n:])


def softened(image: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian over five pixels along both axes; edges are repeated."""
    at = np.arange(-2, 3)
    kernel = np.exp(-(at**2) / (2 * max(sigma, 1e-3) ** 2))
    kernel /= kernel.sum()
    for axis in (1, 0):
        pad = [(2, 2) if a == axis else (0, 0) for a in (0, 1)]
        image = np.lib.stride_tricks.sliding_window_view(np.pad(image, pad, mode="edge"), 5, axis) @ kernel
    return image


def degraded(image: np.ndarray, scale: int, sigma: float, mode: str, deviation: float, seed: int, step: float | None) -> np.ndarray:
    """One frame in 0 to 1: softened, ``scale`` times smaller, with noise, in 8 bits, its blocks coded in steps of ``step``."""
    h, w = image.shape
    out = resample(softened(image, sigma), h // scale, w // scale, mode)
    out = out + deviation * noise(seed, out.size).reshape(out.shape)
    out = np.rint(np.clip(out, 0, 1) * 255)
    if step:
        out = np.rint(restored(quantised(out, step), step, *out.shape))
    return out / 255


def degraded_frames(
    frames: DataFrame, key: str, order: str, image: str, width: int, scale: int, seed: int, sigma: float = 0.6, deviation: float = 2 / 255, step: float | None = None
) -> DataFrame:
    """``key, order, filter, sigma, deviation, small``: each frame of a clip as a video of ``scale`` times less resolution.

    The filter, the softness (up to ``sigma``) and the noise's ``deviation`` (up to that) are drawn once a clip, by key and seed; the noise
    itself once a frame. So reruns agree and no row has to meet another. Frames are flat arrays in 0 to 1 with rows of
    ``width``, whole multiples of ``scale``; null frames give null. ``step`` codes blocks of 8 x 8 in such steps.
    """
    ship_code(frames.sparkSession)
    d = lambda what: draw(F.concat_ws("/", F.lit(what), key), seed)
    rows = frames.select(
        key, order, F.element_at(F.array(*map(F.lit, FILTERS)), (F.floor(d("filter") * len(FILTERS)) + 1).cast("int")).alias("filter"),
        (d("sigma") * sigma).alias("sigma"), (d("noise") * deviation).alias("deviation"),
        F.xxhash64(F.lit(seed), key, order).alias("__seed"), F.col(image).cast("array<double>").alias("__image"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for mode, soft, noisy, own, flat in zip(*[batch.column(k).to_pylist() for k in range(2, 7)], strict=True):
                small = None if flat is None else degraded(np.reshape(flat, (-1, width)), scale, soft, mode, noisy, own, step)
                found.append(None if small is None else small.ravel().tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(found, pa.list_(pa.float64()))], names=[*batch.schema.names[:5], "small"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:5], T.StructField("small", T.ArrayType(T.DoubleType()))]))


def video_inputs(samples: DataFrame, key: str, seed: int, share: float, share_motion: float = 0.0) -> DataFrame:
    """Samples of which a ``share`` become ordinary video: ``is_video``; without depth and jitter, and motion at most estimated.

    Columns ``kind``, ``has_depth``, ``jitter``, ``mv_quality`` are changed for those: kind 0, no depth, no jitter, quality 0, or
    at most 0.5 for the share that keeps estimated motion.
    """
    d = lambda what: draw(F.concat_ws("/", F.lit(what), key), seed)
    video, keeps = d("video") < share, d("motion") < share_motion
    quality = F.when(video & keeps, F.least("mv_quality", F.lit(0.5))).when(video, 0.0).otherwise(F.col("mv_quality"))
    unless = lambda c, other: F.when(video, other).otherwise(F.col(c))
    return samples.withColumns({
        "mv_quality": quality, "kind": unless("kind", F.lit(0)), "has_depth": unless("has_depth", F.lit(False)), "jitter": unless("jitter", F.lit(0.0)), "is_video": video,
    })


def neighbouring(frames: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Each frame with ``<column>_before`` of the frame one earlier in its clip; frames without one are left out.

    Frames meet by key and number, so a clip of any length is spread.
    """
    before = frames.select(F.col(key), (F.col(order) + 1).alias(order), *[F.col(c).alias(f"{c}_before") for c in columns])
    return frames.join(before, [key, order])


def with_temporal_loss(df: DataFrame, out: str, ref: str, motion: str, valid: str, width: int) -> DataFrame:
    """Add ``temporal``: the mean difference of how output and target change along the motion, over valid pixels.

    Needs ``<out>_before`` and ``<ref>_before`` (``neighbouring``). Flat arrays with rows of ``width``; ``motion`` is x, y for each
    pixel; null where anything is, 0 without a valid pixel.
    """
    ship_code(df.sparkSession)
    keep = [c for c in df.columns if c != "temporal"]
    flat = [F.col(c).cast("array<double>").alias(f"__{i}") for i, c in enumerate((out, f"{out}_before", ref, f"{ref}_before", motion, valid))]
    slim = df.select(*flat, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for parts in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
                if any(p is None for p in parts):
                    found.append(None)
                    continue
                now, last, want, wanted, moved, seen = (np.asarray(p, float) for p in parts)
                flow = moved.reshape(-1, width, 2)
                change = lambda x, y: x.reshape(-1, width) - backward_warp(y.reshape(-1, width), flow)  # noqa: E731, B023
                gap = np.abs(change(now, last) - change(want, wanted)) * seen.reshape(-1, width)
                found.append(float(gap.sum() / max(seen.sum(), 1e-6)))
            yield pa.RecordBatch.from_arrays([*batch.columns[6:], pa.array(found, pa.float64())], names=[*keep, "temporal"])

    return slim.mapInArrow(run, T.StructType([*[slim.schema[c] for c in keep], T.StructField("temporal", T.DoubleType())]))


def flow_distance(a: Column, b: Column) -> Column:
    """The mean distance of two flat fields (x, y, ...) of equal size, pixel by pixel; null where either is null or a component is."""
    gap = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    pixels = F.sequence(F.lit(0), (F.size(a) / 2).cast("int") - 1)
    total = F.aggregate(F.transform(pixels, lambda i: F.sqrt(F.get(gap, 2 * i) + F.get(gap, 2 * i + 1))), F.lit(0.0), lambda s, x: s + x)
    return F.when(a.isNotNull() & b.isNotNull(), total / (F.size(a) / 2))
