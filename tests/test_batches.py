"""Samples from cached frames against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks.functions.hashing import draw
from siltworks.operators import batches, sampling
from siltworks.plans import catalogue
from tests.test_vision import _direct


def _read(plane, n, jx, jy, nearest=False):
    """A square plane at jittered centres of an n x n grid, one by one."""
    size = len(plane)
    out = []
    for Y in range(n):
        for X in range(n):
            y, x = (min(max((c + 0.5 + j) * size / n - 0.5, 0), size - 1) for c, j in ((Y, jy), (X, jx)))
            if nearest:
                out.append(plane[round(y)][round(x)])
                continue
            y0, x0 = math.floor(y), math.floor(x)
            y1, x1 = min(y0 + 1, size - 1), min(x0 + 1, size - 1)
            out.append((plane[y0][x0] * (1 - x + x0) + plane[y0][x1] * (x - x0)) * (1 - y + y0) + (plane[y1][x0] * (1 - x + x0) + plane[y1][x1] * (x - x0)) * (y - y0))
    return out


def _flip(plane, fx, fy):
    rows = [list(r)[::-1] if fx else list(r) for r in plane]
    return np.array(rows[::-1] if fy else rows)


def _lit(x, gain):
    light = (x / 12.92 if x <= 0.04045 else ((x + 0.055) / 1.055) ** 2.4) * gain
    light = min(light, 1.0)
    return light * 12.92 if light <= 0.0031308 else 1.055 * light ** (1 / 2.4) - 0.055


def test_render_samples_by_plain_loops(spark, sf_dir):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 48").collect()}
    out = catalogue.QUERIES["render_samples"](spark, sf_dir).where("clip < 12").collect()
    d = lambda what: draw(F.concat_ws("/", F.lit(what), "k"), 11).alias(what)
    draws = {r["k"]: r for r in spark.range(12).select(F.col("id").alias("k")).select("k", *[d(w) for w in ("gain", "phase", "x", "y")]).collect()}
    offsets = {r["id"]: (r["j"]["x"], r["j"]["y"]) for r in spark.range(64).select("id", sampling.jitter(F.col("id")).alias("j")).collect()}
    assert len(out) == 48 and len({(draws[k]["x"] < 0.5, draws[k]["y"] < 0.5) for k in draws}) > 1
    for r in out:
        v, u = vectors[4 * r["clip"] + r["frame"]], draws[r["clip"]]
        fx, fy = u["x"] < 0.5, u["y"] < 0.5
        jx, jy = offsets[math.floor(u["phase"] * 16) + r["frame"]]
        assert (r["jx"], r["jy"]) == pytest.approx((jx, jy)) and r["exposure"] == pytest.approx((u["gain"] * 2 - 1) * 0.8)
        image = _flip(np.minimum(1, np.abs(v) * 2).reshape(8, 8), fx, fy)
        hr = np.array([[_lit(x, 2 ** r["exposure"]) for x in row] for row in image])
        assert np.allclose(r["hr"], hr.ravel()) and np.allclose(r["lr"], _read(hr, 4, jx, jy))
        flow = [_flip(v[:32].reshape(4, 4, 2)[..., c], fx, fy) * (-1 if f else 1) for c, f in ((0, fx), (1, fy))]
        assert np.allclose(np.reshape(r["mv_lr"], (-1, 2)).T, [np.array(_read(p, 4, jx, jy)) / 2 for p in flow])
        assert np.allclose(np.reshape(r["mv_hr"], (8, 8, 2)), np.stack([_direct(p, 8, 8, "bilinear") for p in flow], -1))
        valid = _flip((v[32:48] > 0).astype(float).reshape(4, 4), fx, fy)
        assert r["valid_lr"] == _read(valid, 4, jx, jy, True) and np.allclose(r["valid_hr"], np.ravel(_direct(valid, 8, 8, "nearest")))
        if r["clip"] % 3 == 0:
            assert r["depth_lr"] is None
        else:
            assert np.allclose(r["depth_lr"], _read(_flip(v[48:].reshape(4, 4), fx, fy), 4, jx, jy))


def test_generation_samples_by_plain_loops(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.random((4, 72)).tolist(), rng.normal(size=(4, 18)).tolist(), k % 4 != 0) for k in range(40)] + [(40, None, None, True)]
    df = spark.createDataFrame(rows, "k long, frames array<array<double>>, flows array<array<double>>, flow_ok boolean")
    out = {r["k"]: r for r in batches.generation_samples(df, "k", 6, 2, 5, 0.4, 0.5).collect()}
    d = lambda what: draw(F.concat_ws("/", F.lit(what), "k"), 5).alias(what)
    draws = {r["k"]: r for r in df.select("k", *[d(w) for w in ("extrap", "many", "second", "x", "y")]).collect()}
    kinds = set()
    for k, frames, flows, ok in rows[:-1]:
        r, u = out[k], draws[k]
        ahead = u["extrap"] < 0.4
        many = not ahead and u["many"] < 0.5
        second = u["second"] < 0.5
        kinds.add((ahead, many, second and many))
        i1, target, tau = (2, 3, 1.5) if ahead else (3, 2, 2 / 3) if many and second else (3, 1, 1 / 3) if many else (2, 1, 0.5)
        assert (r["extrap"], r["many"], r["tau"], r["ok"], r["known_t0"]) == (ahead, many, pytest.approx(tau), ok and not many, ok and not many and not ahead)
        fx, fy = u["x"] < 0.5, u["y"] < 0.5
        for name, at in (("i0", 0), ("i1", i1), ("target", target)):
            want = np.stack([_flip(np.reshape(frames[at], (6, 6, 2))[..., c], fx, fy) for c in range(2)], -1)
            assert np.allclose(r[name], want.ravel())
        for name, at in (("mv1", 0), ("flow_t0", 1), ("flow_t1", 3 if ahead else 2)):
            field = [_flip(np.reshape(flows[at], (3, 3, 2))[..., c], fx, fy) * (-1 if f else 1) for c, f in ((0, fx), (1, fy))]
            assert np.allclose(np.reshape(r[name], (6, 6, 2)), np.stack([_direct(p, 6, 6, "bilinear") for p in field], -1))
    assert len(kinds) == 4 and all(out[40][name] is None for name in batches.ROLES)
