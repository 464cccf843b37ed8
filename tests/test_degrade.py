"""JPEG decoding and video degradation against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks.functions.hashing import draw
from siltworks.operators import degrade, images, jpeg
from siltworks.plans import catalogue
from tests.test_vision import _direct

AC = [0x00, 0xF0, *(16 * run + size for run in range(16) for size in range(1, 11))]


def _diagonals():
    """Places of a block from its corner along its diagonals, up and down in turn."""
    y = x = 0
    up, out = True, []
    while len(out) < 64:
        out.append((y, x))
        if up:
            if x == 7:
                y, up = y + 1, False
            elif y == 0:
                x, up = x + 1, False
            else:
                y, x = y - 1, x + 1
        elif y == 7:
            x, up = x + 1, True
        elif x == 0:
            y, up = y + 1, True
        else:
            y, x = y + 1, x - 1
    return out


def _spectrum(block):
    c = lambda k: math.sqrt(1 / 8) if k == 0 else 0.5
    cos = [[math.cos((2 * i + 1) * k * math.pi / 16) for i in range(8)] for k in range(8)]
    return [[c(u) * c(v) * sum(block[y][x] * cos[u][y] * cos[v][x] for y in range(8) for x in range(8)) for v in range(8)] for u in range(8)]


def _colour_jpeg(planes, height, width, samples, restart):
    """A baseline file of three planes at ``samples`` (across, down) each, all coefficients in steps of 2."""
    seg = lambda m, b: bytes([255, m]) + (len(b) + 2).to_bytes(2, "big") + b
    out = b"\xff\xd8" + seg(0xE0, b"JFIF\0junk") + seg(0xDB, bytes([0] + [2] * 64))
    out += seg(0xC0, bytes([8, *divmod(height, 256), *divmod(width, 256), 3]) + b"".join(bytes([i + 1, h * 16 + v, 0]) for i, (h, v) in enumerate(samples)))
    out += seg(0xC4, bytes([0x00, 0, 0, 0, 12] + [0] * 12 + list(range(12)))) + seg(0xC4, bytes([0x10] + [0] * 7 + [len(AC)] + [0] * 8 + AC))
    out += (seg(0xDD, restart.to_bytes(2, "big")) if restart else b"") + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    top_h, top_v = max(h for h, _ in samples), max(v for _, v in samples)
    across, down = -(-width // (8 * top_h)), -(-height // (8 * top_v))
    bits, last, chunks, marks = "", [0, 0, 0], [], 0
    number = lambda x, s: format(x if x >= 0 else x + (1 << s) - 1, f"0{s}b") if s else ""

    def flush():
        whole = bits + "1" * (-len(bits) % 8)
        return bytes(int(whole[i : i + 8], 2) for i in range(0, len(whole), 8)).replace(b"\xff", b"\xff\x00")

    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            chunks.append(flush() + bytes([255, 0xD0 + marks % 8]))
            bits, last, marks = "", [0, 0, 0], marks + 1
        for c, (h, v) in enumerate(samples):
            for b in range(h * v):
                y0, x0 = (unit // across * v + b // h) * 8, (unit % across * h + b % h) * 8
                spectrum = _spectrum([[float(planes[c][y0 + y][x0 + x]) - 128 for x in range(8)] for y in range(8)])
                line = [round(spectrum[y][x] / 2) for y, x in _diagonals()]
                size = abs(line[0] - last[c]).bit_length()
                bits += format(size, "04b") + number(line[0] - last[c], size)
                last[c], run = line[0], 0
                for k in range(1, 64):
                    if not line[k]:
                        run += 1
                        continue
                    while run > 15:
                        bits, run = bits + format(AC.index(0xF0), "08b"), run - 16
                    size = abs(line[k]).bit_length()
                    bits, run = bits + format(AC.index(16 * run + size), "08b") + number(line[k], size), 0
                if run:
                    bits += format(0, "08b")
    return out + b"".join(chunks) + flush() + b"\xff\xd9"


def test_zigzag_and_transform():
    assert jpeg.ZIGZAG.tolist() == [8 * y + x for y, x in _diagonals()]
    block = np.random.default_rng(1).normal(size=(8, 8))
    assert np.allclose(jpeg.COSINES @ block @ jpeg.COSINES.T, _spectrum(block))


@pytest.mark.parametrize(("samples", "restart"), [([(1, 1)] * 3, 0), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 2), ([(2, 2), (1, 1), (1, 1)], 3)])
def test_colour_files_within_a_grey_level(samples, restart):
    rng = np.random.default_rng(3)
    height, width = 27, 41
    top_h, top_v = max(h for h, _ in samples), max(v for _, v in samples)
    H, W = -(-height // (8 * top_v)) * 8, -(-width // (8 * top_h)) * 8
    smooth = lambda h, w: np.clip(rng.integers(60, 190) + np.cumsum(rng.normal(size=(h, w)) * 4, 1), 0, 255).round()
    planes = [smooth(H * v, W * h) for h, v in samples]
    got = images.decode_image(_colour_jpeg(planes, height, width, samples, restart)).astype(float)
    y, cb, cr = (p.repeat(top_v // v, 0).repeat(top_h // h, 1)[:height, :width] for p, (h, v) in zip(planes, samples, strict=True))
    want = np.clip(np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], -1), 0, 255)
    assert got.shape == (height, width, 3)
    # coefficients in steps of 2 move a plane by some levels at most; most by one
    assert np.abs(got - want).max() <= 8 and np.abs(got - want).mean() < 1.6


def test_grey_files_within_a_grey_level():
    rng = np.random.default_rng(4)
    for shape in ((8, 8), (1, 1), (19, 33), (64, 40)):
        grey = rng.integers(0, 256, shape)
        assert np.abs(images.decode_image(jpeg.encode_jpeg(grey))[..., 0].astype(int) - grey).max() <= 1
        coarse = images.decode_image(jpeg.encode_jpeg(grey, 20))[..., 0]
        assert np.abs(coarse - jpeg.restored(jpeg.quantised(grey, 20), 20, *shape)).max() <= 0.5 + 1e-9


def test_damaged_files_are_errors(spark):
    rng = np.random.default_rng(5)
    good = jpeg.encode_jpeg(rng.integers(0, 256, (40, 40)))
    rows = [("good", good), ("empty", b"\xff\xd8"), ("progressive", good.replace(b"\xff\xc0", b"\xff\xc2", 1)), ("null", None), ("no tables", good[:2] + good[good.index(b"\xff\xc0") :])]
    rows += [(f"cut {n}", good[:n]) for n in (3, 20, 100, 500, len(good) // 2)]
    out = {r["path"]: r for r in images.decode_images(spark.createDataFrame(rows, "path string, content binary"), 8).collect()}
    assert out.pop("good")["error"] is None and all(r["error"] and r["width"] is None for r in out.values())
    for _ in range(300):  # bytes that changed give an image or an error, nothing else
        broken = bytearray(good)
        for at in rng.integers(2, len(good), 3):
            broken[at] = rng.integers(0, 256)
        try:
            images.decode_image(bytes(broken))
        except (ValueError, IndexError):
            pass


def _noise(seed, n):
    mask, out = (1 << 64) - 1, []
    for i in range(1, 2 * n + 1):
        z = (seed + 0x9E3779B97F4A7C15 * i) & mask
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        out.append(((z ^ (z >> 31)) >> 11) / 2**53)
    return [math.sqrt(-2 * math.log1p(-u)) * math.cos(2 * math.pi * v) for u, v in zip(out[:n], out[n:], strict=True)]


def _degraded(image, scale, sigma, mode, deviation, seed, step):
    h, w = len(image), len(image[0])
    kernel = [math.exp(-(k * k) / (2 * max(sigma, 1e-3) ** 2)) for k in range(-2, 3)]
    kernel = [k / sum(kernel) for k in kernel]
    soft = [[sum(kernel[d + 2] * image[y][min(max(x + d, 0), w - 1)] for d in range(-2, 3)) for x in range(w)] for y in range(h)]
    soft = [[sum(kernel[d + 2] * soft[min(max(y + d, 0), h - 1)][x] for d in range(-2, 3)) for x in range(w)] for y in range(h)]
    small = _direct(np.array(soft), h // scale, w // scale, mode)
    z = _noise(seed, len(small) * len(small[0]))
    levels = [[round(min(max(v + deviation * z[y * len(row) + x], 0), 1) * 255) for x, v in enumerate(row)] for y, row in enumerate(small)]
    if step:
        H, W = len(levels), len(levels[0])
        back = [[0.0] * W for _ in range(H)]
        for y0 in range(0, H, 8):
            for x0 in range(0, W, 8):
                block = [[levels[min(y0 + y, H - 1)][min(x0 + x, W - 1)] - 128 for x in range(8)] for y in range(8)]
                kept = np.round(np.array(_spectrum(block)) / step) * step
                plain = jpeg.COSINES.T @ kept @ jpeg.COSINES
                for y in range(min(8, H - y0)):
                    for x in range(min(8, W - x0)):
                        back[y0 + y][x0 + x] = round(min(max(plain[y][x] + 128, 0), 255))
        levels = back
    return np.array(levels) / 255


def test_noise_follows_from_the_seed():
    assert degrade.noise(-5, 50) == pytest.approx(_noise(-5 % 2**64, 50))
    many = degrade.noise(7, 20_000)
    assert abs(many.mean()) < 0.03 and abs(many.std() - 1) < 0.03


@pytest.mark.parametrize("mode", degrade.FILTERS)
def test_degraded_frames_by_plain_loops(mode):
    image = np.random.default_rng(6).random((20, 24))
    for sigma, deviation, step in ((0.0, 0.0, None), (0.55, 0.007, None), (0.3, 0.004, 9.0)):
        got = degrade.degraded(image, 2, sigma, mode, deviation, 99, step)
        assert np.abs(got - _degraded(image.tolist(), 2, sigma, mode, deviation, 99, step)).max() < 1 / 255 + 1e-9
        assert np.mean(got == _degraded(image.tolist(), 2, sigma, mode, deviation, 99, step)) > 0.98  # ties of rounding aside


def test_degraded_maps_by_plain_loops(spark, sf_dir):
    out = catalogue.QUERIES["degraded_maps"](spark, sf_dir)
    first, again = out.orderBy("frame").limit(60).collect(), {r["frame"]: r["small"] for r in catalogue.QUERIES["degraded_maps"](spark, sf_dir).collect()}
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 60").collect()}
    seeds = {r["k"]: r["s"] for r in spark.range(60).select(F.col("id").alias("k"), F.xxhash64(F.lit(9), F.floor(F.col("id") / 8), F.col("id")).alias("s")).collect()}
    same = 0
    for r in first:
        assert r["small"] == again[r["frame"]]
        image = np.minimum(1, np.abs(np.array(vectors[r["frame"]], float)) * 2).reshape(8, 8)
        want = _degraded(image.tolist(), 2, r["sigma"], r["filter"], r["deviation"], seeds[r["frame"]] % 2**64, 6.0)
        same += np.abs(np.array(r["small"]) - want.ravel()).max() < 1.5 / 255
    assert same >= 58 and len({r["filter"] for r in first}) > 1
    assert len({(r["clip"], r["filter"], r["sigma"]) for r in first}) == len({r["clip"] for r in first})
    drawn = spark.range(8).select(draw(F.concat_ws("/", F.lit("sigma"), F.col("id")), 9).alias("u"), "id").collect()
    assert {r["clip"]: round(r["sigma"], 9) for r in first}.items() <= {r["id"]: round(r["u"] * 0.6, 9) for r in drawn}.items()


def test_temporal_loss_of_odd_frames(spark):
    flat, still = [float(i % 8) for i in range(64)], [0.0] * 128
    rows = [(1, 0, flat, flat, still, [1.0] * 64), (1, 1, flat, [x + 1 for x in flat], still, [1.0] * 64), (1, 2, None, flat, still, [1.0] * 64), (1, 4, flat, flat, still, [0.0] * 64)]
    df = spark.createDataFrame(rows, "clip long, frame long, o array<double>, r array<double>, m array<double>, v array<double>")
    out = {r["frame"]: r["temporal"] for r in degrade.with_temporal_loss(degrade.neighbouring(df, "clip", "frame", ["o", "r"]), "o", "r", "m", "v", 8).collect()}
    assert out == {1: pytest.approx(1.0), 2: None}
