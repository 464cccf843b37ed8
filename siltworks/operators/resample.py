"""Windows of frames at another scale: separable resampling of every plane, one crop for all frames of a window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.hashing import draw
from siltworks.ship import ship_code


def _cubic(x: np.ndarray) -> np.ndarray:
    x, a = np.abs(x), -0.5
    near, far = ((a + 2) * x - (a + 3)) * x * x + 1, ((x - 5) * x + 8) * x * a - 4 * a
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


#: Kernels by name with the distance they reach.
KERNELS = {
    "bilinear": (lambda x: np.maximum(1 - np.abs(x), 0.0), 1.0),
    "bicubic": (_cubic, 2.0),
    "lanczos": (lambda x: np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0), 3.0),
}


def weights(n: int, m: int, mode: str) -> np.ndarray:
    """How much each of ``n`` samples counts in each of ``m`` new ones, as (m, n); rows add up to 1.

    ``area`` weighs by overlap, ``nearest`` takes the sample at the new one's centre; kernels widen when there are fewer new
    samples, so that none is skipped.
    """
    step = n / m
    if mode == "nearest":
        return np.eye(n)[np.minimum(((np.arange(m) + 0.5) * step).astype(int), n - 1)]
    if mode == "area":
        low, at = np.arange(m)[:, None] * step, np.arange(n)[None]
        return np.clip(np.minimum(low + step, at + 1) - np.maximum(low, at), 0, None) / step
    kernel, reach = KERNELS[mode]
    wide = max(step, 1.0)
    apart = np.arange(n)[None] + 0.5 - (np.arange(m)[:, None] + 0.5) * step
    out = np.where(np.abs(apart) < reach * wide, kernel(apart / wide), 0.0)
    return out / out.sum(1, keepdims=True)


def resample(plane: np.ndarray, height: int, width: int, mode: str) -> np.ndarray:
    """A plane (h, w) or (h, w, channels) at another size; the same object where the size is the same."""
    h, w = plane.shape[:2]
    if (h, w) == (height, width):
        return plane
    down, across = weights(h, height, mode), weights(w, width, mode)
    return np.einsum("ij,jk...,lk->il...", down, plane, across, optimize=True)


def resample_flow(flow: np.ndarray, height: int, width: int) -> np.ndarray:
    """A field (h, w, 2) of x, y at another size, in pixels of the new size."""
    h, w = flow.shape[:2]
    return resample(flow, height, width, "bilinear") * np.array([width / w, height / h])


def relative_depth(depth: np.ndarray) -> np.ndarray:
    """``1 / (1 + d / median)``: near is 1, far is 0; all 0 where no depth is positive and finite."""
    sound = np.isfinite(depth) & (depth > 0)
    if not sound.any():
        return np.zeros(depth.shape)
    return np.where(sound, 1 / (1 + np.where(sound, depth, 1.0) / np.median(depth[sound])), 0.0)


def cut_frame(
    image: np.ndarray, flow: np.ndarray | None, valid: np.ndarray | None, depth: np.ndarray | None, height: int, width: int, y: int, x: int,
    size: tuple[int, int], mode: str, halve: bool = True,
) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None, np.ndarray | None]:
    """One frame of a window at ``height`` by ``width``, cut to ``size``; with ``halve`` motion, validity and depth at half that size.

    Motion stays in pixels of the cut, whatever the size of its own grid.
    """
    cut = (slice(y, y + size[0]), slice(x, x + size[1]))
    low = (size[0] // 2, size[1] // 2) if halve else size
    out = resample(image, height, width, mode)[cut]
    if depth is not None:
        depth = resample(relative_depth(resample(depth, height, width, "bilinear")[cut]), *low, "bilinear")
    if flow is not None:
        flow = resample_flow(resample_flow(flow, height, width)[cut], *low) * np.array([size[1] / low[1], size[0] / low[0]])
    if valid is not None:
        valid = resample(resample(valid, height, width, "nearest")[cut], *low, "nearest")
    return out, flow, valid, depth


PLANES = ("image", "flow", "valid", "depth")


def resampled_windows(
    frames: DataFrame, key: str, order: str, length: int, width: int, size: int, scales: tuple[float, float], seed: int, mode: str = "lanczos", channels: int = 1
) -> DataFrame:
    """``key, frame, height, width, y, x, image, flow, valid, depth, quality`` of each frame of windows of ``length``.

    Planes are flat arrays with rows of ``width`` pixels (``image`` with ``channels``, ``flow`` with x and y); all but the
    image may be null or missing. Scale and place are drawn by key and seed, so that all frames of a window have the
    same and no row has to meet another. The scale is at least what the cut needs; frames smaller than the cut are left
    out, so are null images. Windows with flow are played backwards: forward motion then points to the frame before, and
    their first frame has none. ``order`` counts a window's frames from 0.
    """
    d = lambda what: draw(F.concat_ws("/", F.lit(what), key), seed)
    rows = _sized(frames, width, channels)
    least = size * 1.02 / F.least(F.col("__h"), F.lit(width))
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(scales[0]) + (scales[1] - scales[0]) * d("r"), least))
    rows = rows.withColumns({"__new_h": F.round(F.col("__h") * ratio).cast("int"), "__new_w": F.round(F.lit(width) * ratio).cast("int")})
    rows = rows.where(F.least("__new_h", "__new_w") >= size)
    place = lambda axis, room: F.floor(d(axis) * (F.col(room) - size + 1)).cast("int")
    rows = rows.withColumns({"__y": place("y", "__new_h"), "__x": place("x", "__new_w")})
    return _cut(rows, key, order, length, width, channels, (size, size), mode, True)


def _sized(frames: DataFrame, width: int, channels: int) -> DataFrame:
    """Frames that have an image, with all planes and their height ``__h``."""
    rows = frames.withColumns({c: F.lit(None).cast("array<double>") for c in PLANES if c not in frames.columns})
    return rows.where(F.col("image").isNotNull()).withColumn("__h", (F.size("image") / (width * channels)).cast("int"))


def _cut(rows: DataFrame, key: str, order: str, length: int, width: int, channels: int, size: tuple[int, int], mode: str, halve: bool) -> DataFrame:
    """``cut_frame`` of every row, to ``__new_h`` by ``__new_w`` and from ``__y``, ``__x``; windows with flow are played backwards."""
    ship_code(rows.sparkSession)
    rows = rows.select(
        *[F.col(c).cast("array<double>").alias(c) for c in PLANES], "__h", F.col("__new_h").alias("height"), F.col("__new_w").alias("width"),
        F.col("__y").alias("y"), F.col("__x").alias("x"), key, F.when(F.col("flow").isNull(), F.col(order)).otherwise(length - 1 - F.col(order)).cast("int").alias("frame"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[], [], [], [], []]
            for i in range(len(batch)):
                flat = [None if (v := batch.column(k)[i]).as_py() is None else np.asarray(v.as_py(), float) for k in range(4)]
                h, height, new_width, y, x = (batch.column(k)[i].as_py() for k in range(4, 9))
                image = flat[0].reshape(h, width, channels)
                flow, valid, depth = (None if v is None else v.reshape(h, width, -1).squeeze(-1) if k else v.reshape(h, width, 2) for k, v in enumerate(flat[1:]))
                out = cut_frame(image, flow, valid, depth, height, new_width, y, x, size, mode, halve)
                out = [None if p is None else p.ravel() for p in out]
                if flow is not None and batch.column(10)[i].as_py() == 0:
                    out[1], out[2] = np.zeros_like(out[1]), None if out[2] is None else np.zeros_like(out[2])
                for column, p in zip(found, out, strict=False):
                    column.append(None if p is None else p.tolist())
                found[4].append(0.0 if flow is None else 1.0)
            arrays = [*[pa.array(c, pa.list_(pa.float64())) for c in found[:4]], pa.array(found[4], pa.float64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in (9, 10, 5, 6, 7, 8)], *arrays], names=[key, "frame", "height", "width", "y", "x", *PLANES, "quality"])

    numbers = T.ArrayType(T.DoubleType())
    fields = [rows.schema[c] for c in (key, "frame", "height", "width", "y", "x")]
    return rows.mapInArrow(run, T.StructType([*fields, *[T.StructField(p, numbers) for p in PLANES], T.StructField("quality", T.DoubleType())]))


def full_clips(
    frames: DataFrame, key: str, order: str, length: int, width: int, size: tuple[int, int], most: int | None = None, mode: str = "lanczos", channels: int = 1
) -> DataFrame:
    """``key, height, width, y, x, exact, has_depth, frames``: a test clip in one row, ``frames`` in order with all planes at full size.

    Frames are cut to ``size`` (height, width) at their centre, after the shorter side has come down to ``most``. Clips whose frames are
    too small, or of which fewer or more than ``length`` have an image, are left out. Else as ``resampled_windows``: a clip has ``length``
    frames and no more, so that is what a row holds.
    """
    rows = _sized(frames, width, channels)
    ratio = F.least(F.lit(1.0), F.lit(float(most)) / F.least(F.col("__h"), F.lit(width))) if most else F.lit(1.0)
    rows = rows.withColumns({"__new_h": F.round(F.col("__h") * ratio).cast("int"), "__new_w": F.round(F.lit(width) * ratio).cast("int")})
    rows = rows.where((F.col("__new_h") >= size[0]) & (F.col("__new_w") >= size[1]))
    middle = lambda room, side: F.floor((F.col(room) - side) / 2).cast("int")
    rows = rows.withColumns({"__y": middle("__new_h", size[0]), "__x": middle("__new_w", size[1])})
    whole = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == length).select(F.col(key).alias("__key"))
    rows = rows.join(whole, F.col(key).eqNullSafe(F.col("__key")), "left_semi")
    cut = _cut(rows, key, order, length, width, channels, size, mode, False)
    line = F.array_sort(F.collect_list(F.struct("frame", *PLANES)))
    first = [F.first(c).alias(c) for c in ("height", "width", "y", "x")]
    return cut.groupBy(key).agg(*first, (F.max("quality") > 0).alias("exact"), (F.count("depth") > 0).alias("has_depth"), line.alias("frames"))


def upsample_flow(flow: np.ndarray, scale: int) -> np.ndarray:
    """A field (h, w, 2) on a grid ``scale`` times as fine, in its pixels."""
    return resample_flow(flow, flow.shape[0] * scale, flow.shape[1] * scale)


def _taps(at: np.ndarray, n: int, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """The samples that count for real places on a line of ``n``, and how much; edges are repeated."""
    low = np.floor(at).astype(int)
    if mode == "bilinear":
        steps, weight = np.arange(2), lambda x: 1 - x
    else:  # the cubic of image libraries' grid sampling
        a, steps = -0.75, np.arange(-1, 3)
        weight = lambda x: np.where(x <= 1, ((a + 2) * x - (a + 3)) * x * x + 1, ((x - 5) * x + 8) * x * a - 4 * a)
    places = low[:, None] + steps
    return np.clip(places, 0, n - 1), weight(np.abs(at[:, None] - places))


def jitter_upsample(image: np.ndarray, jitter: tuple[float, float], scale: int, mode: str = "bilinear") -> np.ndarray:
    """An image (h, w) on a grid ``scale`` times as fine, its samples ``jitter`` (x, y pixels) off their centres; edges are repeated."""
    h, w = image.shape
    inside = lambda at, n: np.clip(at, 0, n - 1) if mode == "bilinear" else at
    rows, by = _taps(inside((np.arange(h * scale) + 0.5) / scale - jitter[1] - 0.5, h), h, mode)
    cols, bx = _taps(inside((np.arange(w * scale) + 0.5) / scale - jitter[0] - 0.5, w), w, mode)
    return np.einsum("ya,xb,yaxb->yx", by, bx, image[rows[:, :, None, None], cols[None, None]])


def pad_to(image: np.ndarray, multiple: int) -> np.ndarray:
    """An image with its last rows and columns repeated up to a multiple of ``multiple``."""
    h, w = image.shape[:2]
    return np.pad(image, [(0, -h % multiple), (0, -w % multiple), *[(0, 0)] * (image.ndim - 2)], mode="edge")


def depth_normals(depth: np.ndarray, slope: float = 8.0) -> np.ndarray:
    """Unit normals (h, w, 3) of relative depth by central differences; edges are repeated."""
    padded = np.pad(depth, 1, mode="edge")
    across, down = (padded[1:-1, 2:] - padded[1:-1, :-2]) * slope, (padded[2:, 1:-1] - padded[:-2, 1:-1]) * slope
    out = np.stack([-across, -down, np.ones(depth.shape)], -1)
    return out / np.linalg.norm(out, axis=-1, keepdims=True)


def with_plane(df: DataFrame, inputs: list[str], function, out: str) -> DataFrame:
    """Add ``out``: the flat result of a function of arrays, row by row in Arrow batches; null where an input is."""
    ship_code(df.sparkSession)
    keep = [c for c in df.columns if c != out]
    slim = df.select(*[F.col(c).cast("array<double>").alias(f"__{i}") for i, c in enumerate(inputs)], *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(k).to_pylist() for k in range(len(inputs))], strict=True)
            found = [None if any(v is None for v in row) else np.ravel(function(*[np.asarray(v, float) for v in row])).tolist() for row in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[len(inputs) :], pa.array(found, pa.list_(pa.float64()))], names=[*keep, out])

    return slim.mapInArrow(run, T.StructType([*[slim.schema[c] for c in keep], T.StructField(out, T.ArrayType(T.DoubleType()))]))
