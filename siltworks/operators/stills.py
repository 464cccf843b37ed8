"""A cache of still crops: pieces of images at a drawn scale that have enough structure, in random order, up to a capacity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.hashing import draw
from siltworks.operators.degrade import uniforms
from siltworks.operators.prefix import with_running
from siltworks.operators.resample import resample
from siltworks.ship import ship_code


def still_crops(image: np.ndarray, size: int, crops: int, scales: tuple[float, float], least: float, seed: int, mode: str = "lanczos") -> list[tuple]:
    """``y, x, std, crop`` of up to ``crops`` pieces of an image (h, w), out of three times as many places.

    The image comes to a drawn scale first, not below what a piece needs; places are drawn until enough pieces deviate by ``least``.
    """
    h, w = image.shape
    u = uniforms(seed, 1 + 6 * crops)
    ratio = min(1.0, max(scales[0] + (scales[1] - scales[0]) * u[0], size * 1.02 / min(h, w)))
    height, width = int(np.floor(h * ratio + 0.5)), int(np.floor(w * ratio + 0.5))
    if min(height, width) < size:
        return []
    small = np.clip(resample(image, height, width, mode), 0, 255)
    found: list[tuple] = []
    for i in range(3 * crops):
        if len(found) == crops:
            break
        y, x = int(u[1 + 2 * i] * (height - size + 1)), int(u[2 + 2 * i] * (width - size + 1))
        piece = small[y : y + size, x : x + size]
        if piece.std() >= least:
            found.append((y, x, float(piece.std()), piece.ravel().tolist()))
    return found


def still_cache(
    images: DataFrame, key: str, image: str, width: int, capacity: int, size: int, crops: int, seed: int, scales: tuple[float, float] = (0.5, 1.0), least: float = 8.0
) -> DataFrame:
    """``row_id, key, y, x, std, crop``: the cache's rows, numbered from 0, at most ``capacity``.

    Images (flat arrays of 0 to 255 with rows of ``width``) are taken in an order drawn by key and seed, each cut in its task; all their
    pieces are ranked over range partitions, so that no task holds the cache. Null images and ones too small give none.
    """
    ship_code(images.sparkSession)
    rows = images.select(F.col(key), F.col(image).cast("array<double>").alias("__image"), F.xxhash64(F.lit(seed), key).alias("__seed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which: list[int] = []
            found: list[tuple] = []
            for i, (flat, own) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                some = [] if flat is None else still_crops(np.reshape(flat, (-1, width)), size, crops, scales, least, own)
                which += [i] * len(some)
                found += [(j, *piece) for j, piece in enumerate(some)]
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            arrays = [*[pa.array(c, pa.int32()) for c in columns[:3]], pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int32())), *arrays], names=[key, "piece", "y", "x", "std", "crop"])

    numbers = [T.StructField(c, T.IntegerType()) for c in ("piece", "y", "x")]
    schema = T.StructType([rows.schema[key], *numbers, T.StructField("std", T.DoubleType()), T.StructField("crop", T.ArrayType(T.DoubleType()))])
    pieces = rows.mapInArrow(run, schema)
    ranked = with_running(pieces, [draw(F.col(key), seed), F.col(key), F.col("piece")], {}, "row_id")
    return ranked.where(F.col("row_id") <= capacity).withColumn("row_id", F.col("row_id") - 1).drop("piece")
