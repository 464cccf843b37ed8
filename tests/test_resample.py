"""Whole clips, finer grids and network graphs against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks.functions.hashing import draw
from siltworks.operators import costs, resample, stills
from siltworks.plans import catalogue
from tests.test_vision import _direct


@pytest.mark.parametrize("mode", ["bilinear", "bicubic"])
def test_jittered_samples_by_a_loop(mode):
    image = np.random.default_rng(1).normal(size=(5, 7))
    a = -0.75

    def weight(x):
        x = abs(x)
        if mode == "bilinear":
            return max(0.0, 1 - x)
        return (a + 2) * x**3 - (a + 3) * x * x + 1 if x <= 1 else a * (x**3 - 5 * x * x + 8 * x - 4) if x < 2 else 0.0

    for scale, (jx, jy) in ((2, (0.0, 0.0)), (3, (0.4, -0.3)), (2, (-0.5, 0.5))):
        got = resample.jitter_upsample(image, (jx, jy), scale, mode)
        for Y in range(5 * scale):
            for X in range(7 * scale):
                y, x = (Y + 0.5) / scale - jy - 0.5, (X + 0.5) / scale - jx - 0.5
                if mode == "bilinear":
                    y, x = min(max(y, 0), 4), min(max(x, 0), 6)
                want = sum(
                    weight(y - j) * weight(x - i) * image[min(max(j, 0), 4), min(max(i, 0), 6)]
                    for j in range(math.floor(y) - 2, math.floor(y) + 4) for i in range(math.floor(x) - 2, math.floor(x) + 4)
                )
                assert got[Y, X] == pytest.approx(want, abs=1e-9)


def test_padding_and_normals():
    image = np.arange(15.0).reshape(3, 5)
    padded = resample.pad_to(image, 4)
    assert padded.shape == (4, 8) and padded[3].tolist() == padded[2].tolist() and padded[0, 5:].tolist() == [4.0] * 3
    assert resample.pad_to(image, 5).shape == (5, 5) and resample.pad_to(image[:, :4][:2], 2).shape == (2, 4)
    flat = resample.depth_normals(np.full((4, 4), 0.5))
    assert flat.tolist() == [[[0.0, 0.0, 1.0]] * 4] * 4
    slope = resample.depth_normals(np.tile(np.arange(5.0) / 16, (3, 1)))
    assert slope[1, 2] == pytest.approx(np.array([-1, 0, 1]) / math.sqrt(2)) and np.allclose(np.linalg.norm(slope, axis=-1), 1)


def test_fine_flows_keep_their_motion():
    flow = np.tile(np.array([1.5, -0.5]), (3, 4, 1))
    assert np.allclose(resample.upsample_flow(flow, 2), np.tile(np.array([3.0, -1.0]), (6, 8, 1)))


def test_full_clips_by_direct_sums(spark):
    rng = np.random.default_rng(5)
    h, w, length = 10, 14, 3
    rows = []
    for key in ("a", "b"):
        for t in range(length):
            rows.append((key, t, rng.random(h * w * 2).tolist(), rng.normal(size=h * w * 2).tolist() if key == "a" else None, [1.0] * (h * w) if key == "a" else None, (rng.random(h * w) + 1).tolist()))
    rows += [("short", t, rng.random(h * w * 2).tolist(), None, None, None) for t in range(2)]
    rows += [("gap", t, None if t == 1 else rng.random(h * w * 2).tolist(), None, None, None) for t in range(3)] + [("low", t, rng.random(5 * w * 2).tolist(), None, None, None) for t in range(3)]
    df = spark.createDataFrame(rows, "clip string, t long, image array<double>, flow array<double>, valid array<double>, depth array<double>").repartition(5)
    out = {r["clip"]: r for r in resample.full_clips(df, "clip", "t", length, w, (6, 8), most=8, mode="bilinear", channels=2).collect()}
    assert set(out) == {"a", "b"} and out["a"]["exact"] and not out["b"]["exact"] and out["a"]["has_depth"]
    for key, r in out.items():
        H, W = 8, 11  # the shorter side comes down to 8
        y, x = (H - 6) // 2, (W - 8) // 2
        assert (r["height"], r["width"], r["y"], r["x"]) == (H, W, y, x) and [f["frame"] for f in r["frames"]] == [0, 1, 2]
        for f in r["frames"]:
            _, _, image, flow, _, depth = next(z for z in rows if z[0] == key and z[1] == (length - 1 - f["frame"] if key == "a" else f["frame"]))
            planes = np.reshape(image, (h, w, 2))
            want = np.stack([np.array(_direct(planes[..., c], H, W, "bilinear"))[y : y + 6, x : x + 8] for c in range(2)], -1)
            assert np.allclose(f["image"], want.ravel())
            near = resample.relative_depth(np.array(_direct(np.reshape(depth, (h, w)), H, W, "bilinear"))[y : y + 6, x : x + 8])
            assert np.allclose(f["depth"], near.ravel())
            if key == "a" and f["frame"]:
                field = np.reshape(flow, (h, w, 2))
                moved = [np.array(_direct(field[..., c], H, W, "bilinear"))[y : y + 6, x : x + 8] * s for c, s in ((0, W / w), (1, H / h))]
                assert np.allclose(f["flow"], np.stack(moved, -1).ravel()) and f["valid"] == [1.0] * 48
            elif key == "a":
                assert not any(f["flow"]) and not any(f["valid"])


def test_graph_costs_by_hand(spark):
    nodes = [
        ("m", 0, "input", 3, None, None, None, 10, 15), ("m", 1, "conv", 8, 3, 2, 1, None, None), ("m", 2, "up", None, None, 2, None, None, None),
        ("m", 3, "concat", None, None, None, None, None, None), ("m", 4, "conv", 4, 1, 1, 1, None, None), ("m", 5, "deconv", 2, 4, 2, 1, None, None),
        ("m", 6, "add", None, None, None, None, None, None), ("m", 7, "conv", 6, 3, 1, 2, None, None), ("m", 8, "conv", 1, 3, 1, 1, None, None), ("m", 9, "conv", 1, 3, 1, 1, None, None),
        ("n", 0, "input", 5, None, None, None, 4, 4), ("n", 1, "conv", 5, 3, 1, 1, None, None), ("o", 1, "conv", 5, 3, 1, 1, None, None),
    ]
    edges = [("m", 0, 1), ("m", 1, 2), ("m", 2, 3), ("m", 0, 3), ("m", 3, 4), ("m", 4, 5), ("m", 4, 6), ("m", 4, 6), ("m", 6, 7), ("m", 8, 9), ("m", 9, 8), ("n", 0, 1), ("o", 0, 1)]
    n = spark.createDataFrame(nodes, "model string, node long, op string, c_out long, kernel long, stride long, groups long, height long, width long")
    e = spark.createDataFrame(edges, "model string, src long, dst long")
    shapes = {(r["model"], r["node"]): (r["height"], r["width"], r["channels"], r["macs"], r["parameters"]) for r in costs.graph_shapes(n, e).collect()}
    assert shapes == {
        ("m", 0): (10, 15, 3, 0, 0), ("m", 1): (5, 8, 8, 5 * 8 * 8 * 3 * 9, 8 * 3 * 9 + 8), ("m", 2): (10, 16, 8, 0, 0), ("m", 3): (10, 16, 11, 0, 0),
        ("m", 4): (10, 16, 4, 10 * 16 * 11 * 4, 11 * 4 + 4), ("m", 5): (20, 32, 2, 10 * 16 * 4 * 2 * 16, 4 * 2 * 16 + 2), ("m", 6): (10, 16, 4, 0, 0),
        ("m", 7): (10, 16, 6, 10 * 16 * 4 * 6 * 9 / 2, 4 * 6 * 9 // 2 + 6), ("n", 0): (4, 4, 5, 0, 0), ("n", 1): (4, 4, 5, 16 * 25 * 9, 25 * 9 + 5),
    }  # fmt: skip; the cycle of 8 and 9, and "o" without its input, never get ready
    totals = {r["model"]: (r["layers"], r["parameters"]) for r in costs.graph_costs(n, e).collect()}
    assert totals["n"] == (2, 230) and totals["m"][0] == 8
    assert costs.graph_shapes(n.where("false"), e).count() == 0


def _uniform(seed, n):
    mask, out = (1 << 64) - 1, []
    for i in range(1, n + 1):
        z = (seed + 0x9E3779B97F4A7C15 * i) & mask
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        out.append(((z ^ (z >> 31)) >> 11) / 2**53)
    return out


def test_still_cache_by_plain_loops(spark, sf_dir):
    """Every image's pieces, tried in order; images in drawn order; the first so many fill the cache."""
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    facts = spark.createDataFrame([(k,) for k in rows], "k long").select("k", F.xxhash64(F.lit(7), "k").alias("s"), draw(F.col("k"), 7).alias("u")).collect()
    out = catalogue.QUERIES["still_cache"](spark, sf_dir).orderBy("row_id").collect()
    want = []
    for r in sorted(facts, key=lambda r: (r["u"], r["k"])):
        image = np.abs(np.array(rows[r["k"]], float)).reshape(8, 8) * 500
        u = _uniform(r["s"] % 2**64, 19)
        n = math.floor(8 * min(1.0, max(0.6 + 0.4 * u[0], 5 * 1.02 / 8)) + 0.5)
        small = np.clip(_direct(image, n, n, "lanczos"), 0, 255)
        taken = 0
        for i in range(9):
            y, x = int(u[1 + 2 * i] * (n - 4)), int(u[2 + 2 * i] * (n - 4))
            piece = small[y : y + 5, x : x + 5]
            if taken < 3 and piece.std() >= 30:
                taken += 1
                want.append((r["k"], y, x, piece))
        if len(want) >= len(rows):
            break
    assert [r["row_id"] for r in out] == list(range(len(rows))) and len(want) >= len(rows)
    for r, (k, y, x, piece) in zip(out, want):
        assert (r["vec_id"], r["y"], r["x"]) == (k, y, x) and np.allclose(r["crop"], piece.ravel()) and r["std"] == pytest.approx(piece.std())
    odd = spark.createDataFrame([(1, None), (2, [5.0] * 16), (3, [float(i * 37 % 200) for i in range(64)])], "k long, v array<double>").where("k <> 2 OR v IS NOT NULL")
    kept = stills.still_cache(odd, "k", "v", 8, 100, 5, 2, 1, least=1.0).collect()
    assert {r["k"] for r in kept} == {3} and len(kept) == 2
