"""Array kernels: perceptual hashes, image metrics and binary formats, in Arrow batches where NumPy is needed."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.operators.prefix import group_quantiles
from siltworks.scratch import scratch_table
from siltworks.ship import ship_code

#: Fixed value: the tag that a Middlebury flow file begins with.
FLO_TAG = 202021.25


def cosine_basis(n: int) -> np.ndarray:
    """Orthonormal type-II cosine basis, a row a frequency."""
    angle = np.pi / (2 * n) * np.outer(np.arange(n), 2 * np.arange(n) + 1)
    out = np.cos(angle) * np.sqrt(2 / n)
    out[0] = np.sqrt(1 / n)
    return out


def low_frequency_bits(grey: np.ndarray) -> int:
    """64 bits of a square grey image: low-frequency coefficients above the median of all but the constant one."""
    basis = cosine_basis(len(grey))[:8]
    low = (basis @ grey.astype(np.float64) @ basis.T).ravel()
    flags = low > np.median(low[1:])
    return int(np.packbits(flags, bitorder="little").view("<i8")[0])


def gradient_bits(grey: np.ndarray) -> int:
    """64 bits of an 8 x 9 grey image: whether brightness rises to the right."""
    return int(np.packbits((np.diff(grey.astype(np.float64), axis=1) > 0).ravel(), bitorder="little").view("<i8")[0])


def with_hashes(df: DataFrame, square: str, wide: str) -> DataFrame:
    """Add ``phash`` and ``dhash`` from flat arrays of a 32 x 32 and an 8 x 9 grey image; null arrays give null."""
    ship_code(df.sparkSession)

    @F.pandas_udf("bigint")
    def phash(cells: pd.Series) -> pd.Series:
        return cells.map(lambda v: None if v is None else low_frequency_bits(np.reshape(v, (32, 32)))).astype("Int64")

    @F.pandas_udf("bigint")
    def dhash(cells: pd.Series) -> pd.Series:
        return cells.map(lambda v: None if v is None else gradient_bits(np.reshape(v, (8, 9)))).astype("Int64")

    return df.withColumn("phash", phash(square)).withColumn("dhash", dhash(wide))


def psnr(squared_error: Column) -> Column:
    """Peak signal-to-noise ratio in decibels from a mean squared error of values in 0..1; 100 at most."""
    return 10 * F.log10(1.0 / F.greatest(squared_error, F.lit(1e-10)))


def group_psnr(pixels: DataFrame, keys: list[str], a: str, b: str, mask: str | None = None, min_pixels: int = 50) -> DataFrame:
    """PSNR of each group of pixels; with a mask its weighted one, null where it has ``min_pixels`` or fewer."""
    error = F.pow(F.col(a).cast("double") - F.col(b).cast("double"), F.lit(2.0))
    if mask is None:
        return pixels.groupBy(*keys).agg(psnr(F.avg(error)).alias("psnr"))
    weight = F.col(mask).cast("double")
    value = F.when(F.sum(weight) > min_pixels, psnr(F.try_divide(F.sum(error * weight), F.sum(weight))))
    return pixels.groupBy(*keys).agg(value.alias("psnr"))


def interpolation_error(a: Column, b: Column) -> Column:
    """Aggregate: root mean squared difference on a scale of 0 to 255."""
    return F.sqrt(F.avg(F.pow(a.cast("double") - b.cast("double"), F.lit(2.0)))) * 255


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def to_ycocg(r: Column, g: Column, b: Column) -> Column:
    """Luma and two chroma differences."""
    return F.struct((r / 4 + g / 2 + b / 4).alias("y"), (r / 2 - b / 2).alias("co"), (-r / 4 + g / 2 - b / 4).alias("cg"))


def from_ycocg(y: Column, co: Column, cg: Column) -> Column:
    return F.struct((y + co - cg).alias("r"), (y + cg).alias("g"), (y - co - cg).alias("b"))


def quantise(x: Column) -> Column:
    """The nearest of 256 levels, half to even."""
    return F.bround(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 255) / 255


def charbonnier(a: Column, b: Column, eps: float = 1e-3) -> Column:
    """Aggregate: a smooth absolute error."""
    return F.avg(F.sqrt(F.pow(a - b, F.lit(2.0)) + eps * eps))


def srgb_to_linear(x: Column) -> Column:
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(x: Column) -> Column:
    return F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)


def apply_affine(m: Column, x: Column, y: Column) -> Column:
    """A point under a 2 x 3 matrix given as an array of six."""
    return F.struct((m[0] * x + m[1] * y + m[2]).alias("x"), (m[3] * x + m[4] * y + m[5]).alias("y"))


def invert_affine(m: Column) -> Column:
    """The inverse 2 x 3 matrix; null if there is none."""
    det = m[0] * m[4] - m[1] * m[3]
    q = lambda v: F.try_divide(v, det)
    a, b, d, e = q(m[4]), q(-m[1]), q(-m[3]), q(m[0])
    return F.array(a, b, -(a * m[2] + b * m[5]), d, e, -(d * m[2] + e * m[5]))


def detail_mask(pixels: DataFrame, image: str, x: str, y: str, value: str, share: float = 0.85) -> DataFrame:
    """Pixels with ``detail``: a gradient at or above the ``share`` quantile of the image's gradients.

    An image may have any number of pixels. Its gradients are often a bit or two apart, so the quantile is that of SQL to
    the last bit (``group_quantiles``).
    """
    from pyspark.sql import Window

    along, down = Window.partitionBy(image, y).orderBy(x), Window.partitionBy(image, x).orderBy(y)
    gx = F.coalesce(F.lead(value).over(along) - F.col(value), F.lit(0.0))
    gy = F.coalesce(F.lead(value).over(down) - F.col(value), F.lit(0.0))
    edges = scratch_table(pixels.withColumn("gradient", F.sqrt(gx * gx + gy * gy)), "gradients")
    cut = group_quantiles(edges, [image], "gradient", share, "cut", to_compare=True)
    return edges.join(cut, image).withColumn("detail", F.col("gradient") >= F.col("cut")).drop("cut")


def ssim(a: np.ndarray, b: np.ndarray, size: int = 11, sigma: float = 1.5) -> float:
    """Structural similarity of two grey images in 0..1: Gaussian windows that lie inside the image."""
    at = np.arange(size) - (size - 1) / 2
    kernel = np.exp(-(at**2) / (2 * sigma**2))
    kernel /= kernel.sum()

    def blur(z: np.ndarray) -> np.ndarray:
        rows = np.lib.stride_tricks.sliding_window_view(z, size, axis=0) @ kernel
        return np.lib.stride_tricks.sliding_window_view(rows, size, axis=1) @ kernel

    ma, mb = blur(a), blur(b)
    va, vb, cov = blur(a * a) - ma**2, blur(b * b) - mb**2, blur(a * b) - ma * mb
    c1, c2 = 0.01**2, 0.03**2
    return float(np.mean((2 * ma * mb + c1) * (2 * cov + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2))))


def with_ssim(df: DataFrame, a: str, b: str, width: int) -> DataFrame:
    """Add ``ssim`` of two flat grey images with rows of ``width``; null where either is null."""
    ship_code(df.sparkSession)

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = zip(x, y, strict=True)
        shape = lambda v: np.reshape(np.asarray(v, np.float64), (-1, width))
        return pd.Series([None if p is None or q is None else ssim(shape(p), shape(q)) for p, q in pairs], dtype="float64")

    return df.withColumn("ssim", score(a, b))


def backward_warp(image: np.ndarray, flow: np.ndarray) -> np.ndarray:
    """Bilinear gather of an image (h, w) at each pixel plus its flow (h, w, 2); edges are repeated."""
    h, w = image.shape
    gy, gx = np.mgrid[0:h, 0:w]
    x, y = np.clip(gx + flow[..., 0], 0, w - 1), np.clip(gy + flow[..., 1], 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1, fx, fy = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1), x - np.floor(x), y - np.floor(y)
    top = image[y0, x0] * (1 - fx) + image[y0, x1] * fx
    return top * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy


def thumb_statistics(grey: np.ndarray, dark: float = 8.0) -> dict:
    """Mean, population deviation, Laplacian variance and letterbox share of a grey image on a scale of 0 to 255."""
    inner = grey[1:-1, 1:-1]
    lap = grey[:-2, 1:-1] + grey[2:, 1:-1] + grey[1:-1, :-2] + grey[1:-1, 2:] - 4 * inner
    bright = np.flatnonzero(grey.mean(1) >= dark)
    share = 1.0 if not len(bright) else 1 - (bright[-1] - bright[0] + 1) / len(grey)
    return {"mean": float(grey.mean()), "std": float(grey.std()), "sharpness": float(lap.var()), "letterbox": float(share)}


def read_flow(data: bytes) -> np.ndarray:
    """A Middlebury flow file as (h, w, 2); raises if its tag is wrong."""
    if len(data) < 12 or np.frombuffer(data, "<f4", 1)[0] != np.float32(FLO_TAG):
        raise ValueError("not a flow file")
    w, h = np.frombuffer(data, "<i4", 2, 4)
    return np.frombuffer(data, "<f4", 2 * w * h, 12).reshape(h, w, 2)


def read_array(data: bytes) -> np.ndarray:
    """A ``.npy`` file without objects."""
    return np.load(io.BytesIO(data), allow_pickle=False)


def packed_depth(rgb: np.ndarray, far: float = 1000.0) -> np.ndarray:
    """Metres from 24 bits in three channels, red the lowest."""
    whole = rgb[..., 0].astype(np.float64) + 256.0 * rgb[..., 1] + 65536.0 * rgb[..., 2]
    return whole / (256.0**3 - 1) * far


def nearness(depth: np.ndarray) -> np.ndarray:
    """1 / (1 + depth / median); 0 where the depth is not finite."""
    known = np.isfinite(depth)
    middle = np.median(depth[known]) if known.any() else 1.0
    return np.where(known, 1 / (1 + np.where(known, depth, 0) / max(float(middle), 1e-6)), 0.0)


def decode_flows(files: DataFrame) -> DataFrame:
    """``path, width, height, mean_x, mean_y, error`` of binary flow files; a bad file gives its error."""
    ship_code(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    f = read_flow(bytes(data))
                    rows.append((path, f.shape[1], f.shape[0], float(f[..., 0].mean()), float(f[..., 1].mean()), None))
                except ValueError as bad:
                    rows.append((path, None, None, None, None, str(bad)[:200]))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "mean_x", "mean_y", "error"])

    return files.select("path", "content").mapInPandas(
        run, "path string, width int, height int, mean_x double, mean_y double, error string"
    )


def encode_flow(flow: np.ndarray) -> bytes:
    """A flow field (h, w, 2) as a Middlebury file."""
    h, w = flow.shape[:2]
    return np.float32(FLO_TAG).tobytes() + np.array([w, h], "<i4").tobytes() + flow.astype("<f4").tobytes()


def with_warp_error(df: DataFrame, before: str, after: str, shift: str, width: int) -> DataFrame:
    """Add ``warp_error``: mean absolute difference of ``before`` and ``after`` gathered along a constant ``shift``.

    Images are flat arrays with rows of ``width``; pixels whose source lies outside do not count; null without any.
    """
    ship_code(df.sparkSession)

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series, s: pd.Series) -> pd.Series:
        out = []
        for x, y, d in zip(a, b, s, strict=True):
            one, two = np.reshape(np.asarray(x, float), (-1, width)), np.reshape(np.asarray(y, float), (-1, width))
            flow = np.zeros((*one.shape, 2))
            flow[..., 0] = d
            seen = (np.arange(width) + d >= 0) & (np.arange(width) + d <= width - 1)
            error = np.abs(one - backward_warp(two, flow))[:, seen]
            out.append(float(error.mean()) if error.size else None)
        return pd.Series(out, dtype="float64")

    return df.withColumn("warp_error", score(before, after, shift))


def masked_mean(error: Column, mask: Column) -> Column:
    """Aggregate: mean error where the mask is positive, weighted by it; null without mask."""
    return F.try_divide(F.sum(error * mask), F.sum(mask))


def ghost_rate(error: Column, ui: Column, limit: float = 0.1) -> Column:
    """Aggregate: share of interface pixels whose error exceeds ``limit``; null without any."""
    return F.avg(F.when(ui, (error > limit).cast("double")))


def accept_crops(df: DataFrame, key: str, image: str, width: int, size: int, n: int, min_std: float, seed: int) -> DataFrame:
    """``key, y, x, std``: up to ``n`` crops of ``size`` from ``3 * n`` places drawn by hash, those with structure first come."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, flat in zip(batch[key], batch[image], strict=True):
                cells = np.reshape(np.asarray(flat, float), (-1, width))
                rng, taken = np.random.default_rng([seed, int(k)]), 0
                for _ in range(3 * n):
                    y, x = int(rng.integers(0, cells.shape[0] - size + 1)), int(rng.integers(0, width - size + 1))
                    std = float(cells[y : y + size, x : x + size].std())
                    if std >= min_std and taken < n:
                        rows.append((k, y, x, std))
                        taken += 1
            yield pd.DataFrame(rows, columns=[key, "y", "x", "std"])

    return df.select(key, image).mapInPandas(run, f"{key} bigint, y int, x int, std double")
