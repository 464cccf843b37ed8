"""Training samples from cached frames: low-resolution reads with a jitter, roles of frames, mirrored with their motion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.hashing import draw
from siltworks.operators.resample import resample
from siltworks.operators.sampling import jitter
from siltworks.ship import ship_code


def mirrored(plane: np.ndarray, across: bool, down: bool, vectors: bool = False) -> np.ndarray:
    """A plane (h, w[, channels]) mirrored along its axes; the components of vectors (x, y) along those change their sign."""
    out = plane[::-1] if down else plane
    out = out[:, ::-1] if across else out
    return out * np.array([-1.0 if across else 1.0, -1.0 if down else 1.0]) if vectors else out


def read_at(plane: np.ndarray, rows: int, columns: int, offset: tuple[float, float], nearest: bool = False) -> np.ndarray:
    """A plane (h, w[, channels]) at the centres of a coarser grid, off by ``offset`` (x, y) of its pixels; edges are repeated."""
    h, w = plane.shape[:2]
    y = np.clip((np.arange(rows) + 0.5 + offset[1]) * h / rows - 0.5, 0, h - 1)
    x = np.clip((np.arange(columns) + 0.5 + offset[0]) * w / columns - 0.5, 0, w - 1)
    if nearest:
        return plane[np.ix_(np.rint(y).astype(int), np.rint(x).astype(int))]
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0).reshape(-1, 1, *[1] * (plane.ndim - 2)), (x - x0).reshape(1, -1, *[1] * (plane.ndim - 2))
    top = plane[np.ix_(y0, x0)] * (1 - fx) + plane[np.ix_(y0, x1)] * fx
    return top * (1 - fy) + (plane[np.ix_(y1, x0)] * (1 - fx) + plane[np.ix_(y1, x1)] * fx) * fy


def exposed(image: np.ndarray, gain: float) -> np.ndarray:
    """Values of 0 to 1 in the usual transfer curve after their light is multiplied by ``gain``; what is too bright is cut."""
    light = np.where(image <= 0.04045, image / 12.92, ((np.clip(image, 0, None) + 0.055) / 1.055) ** 2.4) * gain
    light = np.clip(light, 0, 1)
    return np.where(light <= 0.0031308, light * 12.92, 1.055 * light ** (1 / 2.4) - 0.055)


RENDERED = ("lr", "hr", "mv_lr", "valid_lr", "mv_hr", "valid_hr", "depth_lr")


def render_samples(frames: DataFrame, key: str, order: str, size: int, channels: int, scale: int, seed: int, phases: int = 16, stops: float = 0.8) -> DataFrame:
    """``key, order, exposure, jx, jy`` and the planes ``RENDERED`` of each frame of cached windows (``resampled_windows``).

    Frames have ``image`` (values 0 to 1, ``size`` by ``size`` with ``channels``) and, at half that size, ``flow``, ``valid`` and ``depth``, any of which may be
    null. A window is mirrored along each axis or not, and brightened by up to ``stops``, by draws of key and seed; its jitter
    starts at a drawn phase and goes on by frame. The small frame is a single read of the large one at jittered centres, as a render of
    low resolution is. Motion is in pixels of its own frame. No row has to meet another.
    """
    ship_code(frames.sparkSession)
    d = lambda what: draw(F.concat_ws("/", F.lit(what), key), seed)
    phase = F.floor(d("phase") * phases) + F.col(order)
    rows = frames.select(
        key, order, ((d("gain") * 2 - 1) * stops).alias("exposure"), jitter(phase.cast("long"), phases).alias("__j"), (d("x") < 0.5).alias("__fx"), (d("y") < 0.5).alias("__fy"),
        *[F.col(c).cast("array<double>").alias(f"__{c}") for c in ("image", "flow", "valid", "depth")],
    )
    rows = rows.select(key, order, "exposure", F.col("__j.x").alias("jx"), F.col("__j.y").alias("jy"), *rows.columns[4:])
    half, low = size // 2, size // scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[] for _ in RENDERED]
            for stop, jx, jy, fx, fy, *flat in zip(*[batch.column(k).to_pylist() for k in range(2, 11)], strict=True):
                image, flow, valid, depth = (None if v is None else np.asarray(v, float) for v in flat)
                read = lambda p, nearest=False: None if p is None else read_at(p, low, low, (jx, jy), nearest)  # noqa: E731, B023
                hr = None if image is None else exposed(mirrored(image.reshape(size, size, channels), fx, fy), 2.0**stop)
                flow = None if flow is None else mirrored(flow.reshape(half, half, 2), fx, fy, True)
                valid, depth = (None if p is None else mirrored(p.reshape(half, half), fx, fy) for p in (valid, depth))
                # motion is in pixels of the large frame: only its grid is finer, not its unit
                fine = None if flow is None else resample(flow, size, size, "bilinear")
                small = read(flow)
                planes = (read(hr), hr, None if small is None else small / scale, read(valid, True), fine, None if valid is None else resample(valid, size, size, "nearest"), read(depth))
                for column, p in zip(found, planes, strict=True):
                    column.append(None if p is None else np.ravel(p).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *[pa.array(c, pa.list_(pa.float64())) for c in found]], names=[*batch.schema.names[:5], *RENDERED])

    planes = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in RENDERED]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:5], *planes]))


def frame_roles(key: Column, seed: int, extrapolated: float = 0.5, multiple: float = 0.0) -> Column:
    """A struct ``extrap, many, i1, target, tau``: which of four frames in a row plays which role, by draws of key and seed.

    The first frame is always the one before. Between: frame 1 between 0 and 2. Ahead (a share ``extrapolated``): frame 3 after 0 and 2, at 1.5. A
    share ``multiple`` of the others: frame 1 or 2 between 0 and 3, at a third or two.
    """
    d = lambda what: draw(F.concat_ws("/", F.lit(what), key), seed)
    ahead = d("extrap") < extrapolated
    many, second = ~ahead & (d("many") < multiple), d("second") < 0.5
    target = F.when(ahead, 3).when(many & second, 2).otherwise(1)
    tau = F.when(ahead, 1.5).when(many & second, 2.0 / 3.0).when(many, 1.0 / 3.0).otherwise(0.5)
    return F.struct(ahead.alias("extrap"), many.alias("many"), F.when(many, 3).otherwise(2).alias("i1"), target.alias("target"), tau.alias("tau"))


ROLES = ("i0", "i1", "target", "mv1", "flow_t0", "flow_t1")


def generation_samples(quads: DataFrame, key: str, size: int, channels: int, seed: int, extrapolated: float = 0.5, multiple: float = 0.0) -> DataFrame:
    """``key, extrap, many, tau, ok, known_t0`` and the planes ``ROLES`` of four frames in a row with their estimated motion.

    ``frames`` are four flat images, ``flows`` four fields at half their size: from 2 to 0, 1 to 0, 1 to 2 and 3 to 2; ``flow_ok`` whether they are
    sound. A sample is mirrored by draws; roles are those of ``frame_roles``. Motion of multiple frames is not known, nor is that
    back to the first frame from one ahead.
    """
    ship_code(quads.sparkSession)
    d = lambda what: draw(F.concat_ws("/", F.lit(what), key), seed)
    rows = quads.withColumn("__r", frame_roles(F.col(key), seed, extrapolated, multiple))
    ok = F.col("flow_ok") & ~F.col("__r.many")
    rows = rows.select(
        key, "__r.extrap", "__r.many", "__r.tau", ok.alias("ok"), (ok & ~F.col("__r.extrap")).alias("known_t0"),
        F.col("frames").cast("array<array<double>>"), F.col("flows").cast("array<array<double>>"), "__r.i1", "__r.target", (d("x") < 0.5).alias("__fx"), (d("y") < 0.5).alias("__fy"),
    )
    half = size // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[] for _ in ROLES]
            for ahead, frames, flows, i1, target, fx, fy in zip(*[batch.column(k).to_pylist() for k in (1, *range(6, 12))], strict=True):
                if frames is None or flows is None:
                    for column in found:
                        column.append(None)
                    continue
                image = lambda k: mirrored(np.reshape(frames[k], (size, size, channels)), fx, fy)  # noqa: E731, B023
                field = lambda k: resample(mirrored(np.reshape(flows[k], (half, half, 2)), fx, fy, True), size, size, "bilinear")  # noqa: E731, B023
                planes = (image(0), image(i1), image(target), field(0), field(1), field(3 if ahead else 2))
                for column, p in zip(found, planes, strict=True):
                    column.append(np.ravel(p).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], *[pa.array(c, pa.list_(pa.float64())) for c in found]], names=[*batch.schema.names[:6], *ROLES])

    planes = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ROLES]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:6], *planes]))
