"""Local features of images: points of a scale space with the gradients around them, for an image and its mirror."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.operators.images import decode_image, match_cells
from siltworks.ship import ship_code

#: Numbers of a descriptor: a grid of cells around the point, directions of gradients in each.
CELLS, DIRECTIONS = 4, 8
WIDTH = CELLS * CELLS * DIRECTIONS


@dataclass(frozen=True)
class Detector:
    """How points are found. ``contrast`` is for values in 0 to 1; ``edge`` is the largest ratio of a point's curvatures."""

    steps: int = 3
    sigma: float = 1.6
    contrast: float = 0.04
    edge: float = 10.0
    second_peak: float = 0.8


def _blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur along both axes; edges are repeated."""
    half = max(1, int(np.ceil(4 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        pad = [(half, half) if a == axis else (0, 0) for a in (0, 1)]
        image = np.lib.stride_tricks.sliding_window_view(np.pad(image, pad, mode="edge"), 2 * half + 1, axis) @ kernel
    return image


@lru_cache(maxsize=256)
def _blur_matrix(n: int, sigma: float) -> np.ndarray:
    """The matrix by which ``_blurred`` blurs a line of ``n``; edges are repeated."""
    half = max(1, int(np.ceil(4 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    out = np.zeros((n, n))
    at = np.clip(np.arange(n)[:, None] + np.arange(-half, half + 1), 0, n - 1)
    np.add.at(out, (np.arange(n)[:, None], at), kernel / kernel.sum())
    return out


def _soft(image: np.ndarray, sigma: float) -> np.ndarray:
    """``_blurred`` of a small image, whose lines meet one matrix; a large one, where most of the matrix would be zeros, is blurred by its kernel."""
    if max(image.shape) > 512:
        return _blurred(image, sigma)
    sigma = float(sigma)
    return _blur_matrix(image.shape[0], sigma) @ image @ _blur_matrix(image.shape[1], sigma).T


def _octaves(image: np.ndarray, d: Detector) -> Iterator[tuple[int, np.ndarray]]:
    """For each halving of the image its stack of blurred copies, ``steps + 3`` of them, from sharp to soft."""
    factor = 2 ** (1 / d.steps)
    now, k = _soft(image, np.sqrt(max(d.sigma**2 - 0.25, 0.01))), 0  # images count as blurred by half a pixel
    while min(now.shape) >= 12:
        stack = [now]
        for i in range(1, d.steps + 3):
            before = d.sigma * factor ** (i - 1)
            stack.append(_soft(stack[-1], before * np.sqrt(factor**2 - 1)))
        yield k, np.stack(stack)
        now, k = stack[d.steps][::2, ::2], k + 1


def _extrema(stack: np.ndarray, d: Detector) -> np.ndarray:
    """``level, y, x, strength`` of the sound extrema of an octave's differences, refined to parts of a pixel."""
    dog = np.diff(stack, axis=0)
    mid, top, low = dog[1:-1, 1:-1, 1:-1], dog, dog
    for axis in range(3):  # the largest and least of 3 x 3 x 3 neighbours, an axis at a time
        part = lambda z, lo: z[(slice(None),) * axis + (slice(lo, z.shape[axis] - 2 + lo),)]  # noqa: E731, B023
        top, low = (pick(pick(part(z, 0), part(z, 1)), part(z, 2)) for pick, z in ((np.maximum, top), (np.minimum, low)))
    peak = ((mid == top) & (mid > 0) | (mid == low) & (mid < 0)) & (np.abs(mid) > 0.5 * d.contrast / d.steps)
    at = np.argwhere(peak) + 1
    if not len(at):
        return np.zeros((0, 4))
    s, y, x = at.T
    near = lambda ds, dy, dx: dog[s + ds, y + dy, x + dx]
    slope = np.stack([near(1, 0, 0) - near(-1, 0, 0), near(0, 1, 0) - near(0, -1, 0), near(0, 0, 1) - near(0, 0, -1)], 1) / 2
    here = near(0, 0, 0)
    curve = np.empty((len(at), 3, 3))
    steps = np.eye(3, dtype=int)
    for i in range(3):
        curve[:, i, i] = near(*steps[i]) + near(*-steps[i]) - 2 * here
        for j in range(i):
            cross = near(*(steps[i] + steps[j])) + near(*-(steps[i] + steps[j])) - near(*(steps[i] - steps[j])) - near(*(steps[j] - steps[i]))
            curve[:, i, j] = curve[:, j, i] = cross / 4
    sound = np.abs(np.linalg.det(curve)) > 1e-18
    at, slope, here, curve = at[sound], slope[sound], here[sound], curve[sound]
    if not len(at):
        return np.zeros((0, 4))
    shift = -np.linalg.solve(curve, slope[..., None])[..., 0]
    height = np.abs(here + 0.5 * (slope * shift).sum(1))
    trace, det = curve[:, 1, 1] + curve[:, 2, 2], curve[:, 1, 1] * curve[:, 2, 2] - curve[:, 1, 2] ** 2
    flat = (det > 0) & (trace**2 * d.edge < (d.edge + 1) ** 2 * det)
    keep = flat & (np.abs(shift).max(1) < 1.0) & (height > d.contrast / d.steps)
    return np.column_stack([at[keep] + shift[keep], height[keep]])


def _gathered(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values of an image at real places; 0 outside."""
    return _gathered_from((image,), y, x)[0]


def _gathered_from(images: tuple[np.ndarray, ...], y: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """Bilinear values of images of one size at real places; 0 outside."""
    h, w = images[0].shape
    inside = (y >= 0) & (y <= h - 1) & (x >= 0) & (x <= w - 1)
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.minimum(y.astype(int), h - 2), np.minimum(x.astype(int), w - 2)
    fy, fx = y - y0, x - x0
    at, gx, gy = y0 * w + x0, 1 - fx, 1 - fy
    out = []
    for flat in (np.ascontiguousarray(image).ravel() for image in images):
        top = flat[at] * gx + flat[at + 1] * fx
        out.append((top * gy + (flat[at + w] * gx + flat[at + w + 1] * fx) * fy) * inside)
    return out


def _directions(gy: np.ndarray, gx: np.ndarray, points: np.ndarray, sigma: np.ndarray, d: Detector) -> tuple[np.ndarray, np.ndarray]:
    """The main directions of the gradients around each point: indices of points, as often as they have directions."""
    ring = np.arange(-8, 9) / 8 * 3  # places within three times the weight's width
    dy, dx = np.meshgrid(ring, ring, indexing="ij")
    reach = (1.5 * sigma)[:, None, None]
    y, x = points[:, 0, None, None] + dy * reach, points[:, 1, None, None] + dx * reach
    a, b = _gathered_from((gy, gx), y, x)
    weight = np.hypot(a, b) * np.exp(-0.5 * (dy**2 + dx**2))
    angle = np.arctan2(a, b) * 36 / (2 * np.pi) % 36
    low = np.floor(angle).astype(int)
    part, first = angle - low, np.arange(len(points))[:, None, None] * 36
    at = np.concatenate([(first + low % 36).ravel(), (first + (low + 1) % 36).ravel()])
    bins = np.bincount(at, np.concatenate([(weight * (1 - part)).ravel(), (weight * part).ravel()]), len(points) * 36).reshape(-1, 36)
    for _ in range(2):
        bins = (np.roll(bins, 1, 1) + bins + np.roll(bins, -1, 1)) / 3
    before, after = np.roll(bins, 1, 1), np.roll(bins, -1, 1)
    which, at = np.nonzero((bins > before) & (bins > after) & (bins >= d.second_peak * bins.max(1, keepdims=True)) & (bins > 0))
    l, m, r = before[which, at], bins[which, at], after[which, at]
    return which, (at + 0.5 * (l - r) / (l - 2 * m + r)) * 2 * np.pi / 36


def _described(gy: np.ndarray, gx: np.ndarray, points: np.ndarray, sigma: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Histograms of gradient directions in the cells of a grid, turned with the point, as bytes."""
    n = 4 * CELLS
    line = (np.arange(n) + 0.5) / 4 - CELLS / 2  # places in units of cells, four a cell
    v, u = np.meshgrid(line, line, indexing="ij")
    cos, sin, cell = np.cos(turn)[:, None, None], np.sin(turn)[:, None, None], (3 * sigma)[:, None, None]
    y = points[:, 0, None, None] + (u * sin + v * cos) * cell
    x = points[:, 1, None, None] + (u * cos - v * sin) * cell
    a, b = _gathered_from((gy, gx), y, x)
    weight = np.hypot(a, b) * np.exp(-(u**2 + v**2) / (2 * (CELLS / 2) ** 2))
    angle = (np.arctan2(a, b) - turn[:, None, None]) * DIRECTIONS / (2 * np.pi) % DIRECTIONS
    low = np.floor(angle).astype(int)
    row, col = v + CELLS / 2 + 0.5, u + CELLS / 2 + 0.5  # in the grid with a border of one cell
    r, c = np.floor(row).astype(int), np.floor(col).astype(int)
    part, first = angle - low, np.arange(len(points))[:, None, None] * ((CELLS + 2) ** 2 * DIRECTIONS)
    ends = ((low % DIRECTIONS, 1 - part), ((low + 1) % DIRECTIONS, part))
    at, much = [], []
    for dr in (0, 1):
        for dc in (0, 1):
            share = np.abs(1 - dr - (row - r)) * np.abs(1 - dc - (col - c)) * weight
            place = first + ((r + dr) * (CELLS + 2) + c + dc) * DIRECTIONS
            for turned, by in ends:
                at.append((place + turned).ravel())
                much.append((share * by).ravel())
    out = np.bincount(np.concatenate(at), np.concatenate(much), len(points) * (CELLS + 2) ** 2 * DIRECTIONS).reshape(len(points), CELLS + 2, CELLS + 2, DIRECTIONS)
    flat = out[:, 1:-1, 1:-1].reshape(len(points), WIDTH)
    for _ in range(2):
        flat = np.minimum(flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-12), 0.2)
    flat /= np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-12)
    return np.minimum(flat * 512, 255).astype(np.uint8)


def _of_octaves(octaves: list[tuple[int, np.ndarray]], most: int, detector: Detector) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` strongest points of an image's octaves, and their descriptors."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for octave, stack in octaves:
        points = _extrema(stack, detector)
        level = np.clip(np.rint(points[:, 0]).astype(int), 1, detector.steps)
        for s in np.unique(level):
            some = points[level == s]
            sigma = detector.sigma * 2 ** (some[:, 0] / detector.steps)
            gy, gx = np.gradient(stack[s])
            which, turn = _directions(gy, gx, some[:, 1:3], sigma, detector)
            if len(which):
                described = _described(gy, gx, some[which, 1:3], sigma[which], turn)
                found.append((some[which][:, 2:0:-1] * 2**octave, described, some[which, 3]))
    if not found:
        return np.zeros((0, 2), np.float32), np.zeros((0, WIDTH), np.uint8)
    points, described, strength = (np.concatenate(part) for part in zip(*found, strict=True))
    best = np.lexsort((points[:, 0], points[:, 1], -strength))[:most]
    return points[best].astype(np.float32), described[best]


def local_features(grey: np.ndarray, most: int = 400, detector: Detector = Detector()) -> tuple[np.ndarray, np.ndarray]:
    """``points`` (x, y) and ``descriptors`` (128 bytes each) of the ``most`` strongest points of a grey image in 0 to 255.

    A point with two directions is there twice. Images without structure, or too small, have no points.
    """
    octaves = _octaves(np.asarray(grey, float) / 255, detector) if min(grey.shape, default=0) >= 12 else []
    return _of_octaves(list(octaves), most, detector)


def _grey(image: np.ndarray) -> np.ndarray:
    return image[..., :3] @ np.array([0.299, 0.587, 0.114]) if image.shape[-1] >= 3 else image[..., 0].astype(float)


NAMES = ("points", "features", "points_m", "features_m")


def with_local_features(files: DataFrame, content: str, most: int = 400) -> DataFrame:
    """Add ``points, features, points_m, features_m`` (packed 32-bit places, bytes) of an image file and its mirror, and ``error``.

    A file that cannot be read has nulls and its error. Each file is decoded in its task, nothing shuffles.
    """
    ship_code(files.sparkSession)
    keep = [c for c in files.columns if c not in (*NAMES, "error")]
    slim = files.select(F.col(content).alias("__content"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for data in batch.column(0):
                try:
                    grey = _grey(decode_image(data.as_py() or b""))
                    ends = (*local_features(grey, most), *local_features(grey[:, ::-1], most))
                    rows.append((*[x.tobytes() for x in ends], None))
                except (ValueError, IndexError) as bad:
                    rows.append((None, None, None, None, str(bad)[:200]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            arrays = [*[pa.array(c, pa.binary()) for c in columns[:4]], pa.array(columns[4], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *arrays], names=[*keep, *NAMES, "error"])

    added = [*[T.StructField(n, T.BinaryType()) for n in NAMES], T.StructField("error", T.StringType())]
    return slim.mapInArrow(run, T.StructType([*[slim.schema[c] for c in keep], *added]))


def unpacked(points: bytes | None, features: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    places = np.frombuffer(points or b"", np.float32).reshape(-1, 2).astype(float)
    return places, np.frombuffer(features or b"", np.uint8).reshape(-1, WIDTH).astype(float)


def verified_by_features(pairs: DataFrame, features: DataFrame, key: str, size: float, a: str = "a", b: str = "b") -> DataFrame:
    """``pairs`` with ``cells``: of the first image, those that the better of the direct and the mirrored match covers.

    ``features`` has a row a ``key``, as ``with_local_features`` makes them; an end without features scores 0. ``size`` is
    the side of the images. A pair brings three lists of points together, joined by key.
    """
    ship_code(pairs.sparkSession)
    one = features.select(F.col(key).alias(a), F.col("points").alias("__pa"), F.col("features").alias("__fa"))
    two = features.select(F.col(key).alias(b), *[F.col(c).alias(f"__b{i}") for i, c in enumerate(NAMES)])
    keep = [c for c in pairs.columns if c != "cells"]
    both = pairs.select(*keep).join(one, a, "left").join(two, b, "left").select("__pa", "__fa", *[f"__b{i}" for i in range(4)], *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in zip(*[batch.column(k) for k in range(6)], strict=True):
                ends = [unpacked(row[k].as_py(), row[k + 1].as_py()) for k in (0, 2, 4)]
                found.append(max(match_cells(ends[0], ends[1], size), match_cells(ends[0], ends[2], size)))
            yield pa.RecordBatch.from_arrays([*batch.columns[6:], pa.array(found, pa.int32())], names=[*keep, "cells"])

    return both.mapInArrow(run, T.StructType([*[both.schema[c] for c in keep], T.StructField("cells", T.IntegerType())]))
