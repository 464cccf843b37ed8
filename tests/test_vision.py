"""Local features, resampled windows, job streams and pruned searches against plain Python."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks.operators import features, images, joins, resample
from siltworks.plans import catalogue, queries_vision
from siltworks.streaming import jobs


def _picture(seed, n=192):
    noise = np.random.default_rng(seed).normal(size=(24, 24))
    smooth = features._blurred(np.kron(noise, np.ones((n // 24, n // 24))), 2.0)
    return (smooth - smooth.min()) / (smooth.max() - smooth.min()) * 255


def _moved(image, degrees, scale, dx, dy):
    n = len(image)
    y, x = np.mgrid[0:n, 0:n]
    c, a = (n - 1) / 2, np.radians(degrees)
    u, v = (x - c - dx) / scale, (y - c - dy) / scale
    return features._gathered(image, -np.sin(a) * u + np.cos(a) * v + c, np.cos(a) * u + np.sin(a) * v + c)


def _cells(a, b):
    ends = [(p.astype(float), d.astype(float)) for p, d in (features.local_features(a), features.local_features(b))]
    return images.match_cells(*ends, 192.0)


def test_features_follow_known_maps():
    a = _picture(1)
    assert _cells(a, a) >= 55
    assert _cells(a, np.roll(a, (7, 11), (0, 1))) >= 40
    for degrees, scale in ((20, 1.0), (-75, 1.0), (180, 1.0), (6, 1.3), (0, 0.75)):
        assert _cells(a, _moved(a, degrees, scale, 4, 2)) >= 15, (degrees, scale)
    assert _cells(a, np.rot90(a).copy()) >= 40 and _cells(a, np.clip(a * 0.7 + 20, 0, 255)) >= 40
    assert _cells(a, a[:, ::-1]) == 0 and _cells(a, _picture(2)) == 0  # the mirror is matched by its own features only


def test_points_of_a_shift_are_shifted():
    """Nearest descriptors, one by one, lie where the shift puts them."""
    a = _picture(3)
    b = np.roll(a, (5, 9), (0, 1))
    (p, d), (q, e) = features.local_features(a), features.local_features(b)
    off = []
    for x, one in zip(p, d.astype(float), strict=True):
        order = sorted(range(len(e)), key=lambda j: float(((e[j].astype(float) - one) ** 2).sum()))
        if 40 < x[0] < 150 and 40 < x[1] < 150:
            off.append(np.abs(q[order[0]] - x - [9, 5]).max())
    assert len(off) > 20 and np.mean(np.array(off) < 0.5) > 0.9


def test_features_of_odd_images(spark):
    flat = b"P5\n40 40 255\n" + bytes([7]) * 1600
    tiny = b"P5\n4 4 255\n" + bytes(range(16))
    rows = [(1, flat), (2, tiny), (3, b"junk"), (4, None), (5, queries_vision.draw_picture(np.arange(64) % 7 / 9 - 0.3, 0))]
    out = {r["k"]: r for r in features.with_local_features(spark.createDataFrame(rows, "k long, content binary"), "content").collect()}
    assert [len(out[k]["points"]) for k in (1, 2)] == [0, 0] and out[1]["error"] is None
    assert out[3]["points"] is None and out[3]["error"] and out[4]["error"] and len(out[5]["points"]) > 0
    pairs = spark.createDataFrame([(5, 5), (5, 1), (3, 5), (9, 5)], "a long, b long")
    feats = features.with_local_features(spark.createDataFrame(rows, "k long, content binary"), "content")
    got = {(r["a"], r["b"]): r["cells"] for r in features.verified_by_features(pairs, feats, "k", 96.0).collect()}
    assert got[5, 5] >= 4 and [got[x] for x in ((5, 1), (3, 5), (9, 5))] == [0, 0, 0]


def test_feature_pairs_by_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 60").orderBy("vec_id").collect()
    vectors = [r["embedding"] for r in rows]
    found = {r["a"]: r["cells"] for r in catalogue.QUERIES["feature_pairs"](spark, sf_dir).where("b < 60").collect()}
    side = queries_vision.SIDE
    grey = [np.frombuffer(queries_vision.draw_picture(vectors[k - k % 4], k % 4)[-side * side :], np.uint8).reshape(side, side).astype(float) for k in range(60)]
    points = [[(p.astype(float), d.astype(float)) for p, d in (features.local_features(g), features.local_features(g[:, ::-1]))] for g in grey]
    want = {k: max(images.match_cells(points[k][0], points[k + 1][0], side), images.match_cells(points[k][0], points[k + 1][1], side)) for k in range(59)}
    assert found == want
    same = [found[k] for k in range(59) if k % 4 != 3]
    assert np.mean(np.array(same) >= 10) > 0.7 and all(found[k] == 0 for k in range(59) if k % 4 == 3)


def _direct(plane, height, width, mode):
    """Every new sample as a sum over all old ones, weights by the definition of each mode."""
    h, w = plane.shape
    kernels = {
        "bilinear": (lambda x: max(0.0, 1 - abs(x)), 1), "lanczos": (lambda x: 0.0 if abs(x) >= 3 else float(np.sinc(x) * np.sinc(x / 3)), 3),
        "bicubic": (lambda x: 1.5 * abs(x) ** 3 - 2.5 * x * x + 1 if abs(x) < 1 else -0.5 * abs(x) ** 3 + 2.5 * x * x - 4 * abs(x) + 2 if abs(x) < 2 else 0.0, 2),
    }

    def line(n, m, i):
        step = n / m
        if mode == "nearest":
            return [float(j == min(int((i + 0.5) * step), n - 1)) for j in range(n)]
        if mode == "area":
            return [max(0.0, min((i + 1) * step, j + 1) - max(i * step, j)) / step for j in range(n)]
        kernel, reach = kernels[mode]
        wide = max(1.0, step)
        some = [kernel((j + 0.5 - (i + 0.5) * step) / wide) if abs(j + 0.5 - (i + 0.5) * step) < reach * wide else 0.0 for j in range(n)]
        return [s / sum(some) for s in some]

    rows, cols = [line(h, height, i) for i in range(height)], [line(w, width, i) for i in range(width)]
    return [[sum(r[y] * c[x] * plane[y, x] for y in range(h) for x in range(w)) for c in cols] for r in rows]


@pytest.mark.parametrize("mode", ["area", "nearest", "bilinear", "bicubic", "lanczos"])
def test_resampling_by_direct_sums(mode):
    plane = np.random.default_rng(2).normal(size=(9, 12))
    for height, width in ((5, 7), (9, 12), (4, 12), (13, 20), (1, 1)):
        assert np.allclose(resample.resample(plane, height, width, mode), _direct(plane, height, width, mode), atol=1e-9)


def test_windows_by_direct_sums(spark):
    """All planes of a window that is played backwards, with one crop, half-size motion in pixels of the cut."""
    rng = np.random.default_rng(4)
    h, w, size, length = 12, 16, 6, 3
    rows = []
    for key in ("a", "b", "c"):
        for t in range(length):
            image, flow, depth = rng.random(h * w * 3), rng.normal(size=h * w * 2), rng.random(h * w) * 9 + 1
            valid = (rng.random(h * w) < 0.7).astype(float)
            rows.append((key, t, image.tolist(), None if key == "b" else flow.tolist(), None if key == "b" else valid.tolist(), None if key == "c" else depth.tolist()))
    rows += [("d", 0, [0.5] * (4 * w * 3), None, None, None), ("e", 0, None, None, None, None)]  # too low for a cut; no image
    df = spark.createDataFrame(rows, "clip string, t long, image array<double>, flow array<double>, valid array<double>, depth array<double>")
    out = resample.resampled_windows(df, "clip", "t", length, w, size, (0.5, 0.9), 3, "bicubic", 3).collect()
    assert sorted({r["clip"] for r in out}) == ["a", "b", "c"] and len(out) == 9
    for key in ("a", "b", "c"):
        assert len({(r["height"], r["width"], r["y"], r["x"]) for r in out if r["clip"] == key}) == 1
    for r in out:
        t = r["frame"] if r["clip"] == "b" else length - 1 - r["frame"]
        _, _, image, flow, valid, depth = next(x for x in rows if x[0] == r["clip"] and x[1] == t)
        H, W, cut = r["height"], r["width"], (slice(r["y"], r["y"] + size), slice(r["x"], r["x"] + size))
        planes = np.reshape(image, (h, w, 3))
        want = np.stack([np.array(_direct(planes[..., c], H, W, "bicubic"))[cut] for c in range(3)], -1)
        assert np.allclose(r["image"], want.ravel()) and r["quality"] == (0.0 if r["clip"] == "b" else 1.0)
        if flow is None:
            assert r["flow"] is None and r["valid"] is None
        elif r["frame"] == 0:
            assert not any(r["flow"]) and not any(r["valid"])
        else:
            field = np.reshape(flow, (h, w, 2))
            moved = [np.array(_direct(np.array(_direct(field[..., c], H, W, "bilinear"))[cut] * s, 3, 3, "bilinear")) for c, s in ((0, W / w), (1, H / h))]
            assert np.allclose(r["flow"], np.stack(moved, -1).ravel())
            kept = np.array(_direct(np.array(_direct(np.reshape(valid, (h, w)), H, W, "nearest"))[cut], 3, 3, "nearest"))
            assert np.allclose(r["valid"], kept.ravel())
        if depth is None:
            assert r["depth"] is None
        else:
            near = np.array(_direct(np.reshape(depth, (h, w)), H, W, "bilinear"))[cut]
            assert np.allclose(r["depth"], np.ravel(_direct(1 / (1 + near / np.median(near)), 3, 3, "bilinear")))


def _told(lines):
    """A job's state by reading its lines in order."""
    s = {"n": 0, "bad": 0, "rounds": 0, "progress": None, "round": None, "score": None, "done": False, "tail": []}
    for at, line in sorted(lines):
        s["n"] += 1
        s["tail"] = (s["tail"] + [at])[-40:]
        kind, _, body = line.partition(" ")
        if kind not in ("PROGRESS", "ROUND", "DONE", "LOG"):
            continue
        try:
            data = json.loads(body)
        except ValueError:
            data = None
        if not isinstance(data, dict):
            s["bad"] += 1
        elif kind == "PROGRESS":
            s["progress"] = data.get("progress")
        elif kind == "ROUND":
            s["rounds"], s["round"], s["score"] = s["rounds"] + 1, data.get("round"), data.get("score")
        elif kind == "DONE":
            s["done"] = True
    return s


def test_job_states_survive_a_restart(spark, tmp_path):
    rng = np.random.default_rng(6)
    kinds = ['PROGRESS {"progress": %d}', 'ROUND {"round": %d, "score": 0.5}', "ROUND {%d", "text %d", 'LOG {"msg": "%d"}', "PROGRESS [%d]", "DONE", 'ROUND {"score": "x", "round": %d}']
    lines = {}
    for at in range(900):
        job = "hot" if rng.random() < 0.5 else f"j{rng.integers(0, 6)}"
        kind = kinds[int(rng.integers(0, len(kinds)))]
        lines.setdefault(job, []).append((at, kind % at if "%" in kind else kind))
    lines["j1"].append((2000, 'DONE {"step": 1}'))
    flat = [(at, f"{job} {at} {line}") for job, some in lines.items() for at, line in some]
    rng.shuffle(flat)
    source, state, out = (str(tmp_path / d) for d in ("in", "state", "out"))
    for lo, hi in ((0, 500), (500, len(flat))):  # the second part comes after the first run has ended
        part = [(f,) for _, f in flat[lo:hi]] + [("no number here",), ("",)]
        spark.createDataFrame([(f,) for _, f in flat[lo:hi]] + part[-2:], "value string").repartition(3).write.mode("append").text(source)
        assert jobs.run_jobs(spark, source, state, out, files_per_batch=2) == 2
    got = {r["job"]: r for r in jobs.latest_states(spark, out).collect()}
    assert set(got) == set(lines)
    for job, some in lines.items():
        want, r = _told(some), got[job]
        score = want["score"] if isinstance(want["score"], float) else None
        assert (r["n_lines"], r["n_bad"], r["n_rounds"], r["progress"], r["round"], r["score"], r["done"], r["tail_at"]) == (
            want["n"], want["bad"], want["rounds"], want["progress"], want["round"], score, want["done"], [int(i) for i in want["tail"]]
        )
        assert len(r["tail"]) == min(40, want["n"])
    assert jobs.run_jobs(spark, source, state, out) == 0


def test_clustered_vectors_leave_few_block_pairs(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 24))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    points = centres[np.arange(1200) % 40] + rng.normal(size=(1200, 24)) * 0.03
    points[1000:1100] = points[1000]  # copies
    df = spark.createDataFrame([(i, v, i % 5) for i, v in enumerate(points.tolist())], "k long, v array<double>, g long").repartition(3)
    exact = points.astype(np.float32).astype(float)
    sims = exact @ exact.T
    got = {(r["a"], r["b"]) for r in joins.pairs_above(df, "k", "v", 0.9).collect()}
    assert got == {(i, j) for i in range(1200) for j in range(i + 1, 1200) if sims[i, j] >= 0.9}
    near = {}
    for r in joins.neighbours(df.where("k % 50 = 0"), df, "k", "v", 4, "g").collect():
        near.setdefault(r["query"], []).append((r["rank"], r["ref"]))
    for i in range(0, 1200, 50):
        order = sorted((j for j in range(1200) if j % 5 != i % 5), key=lambda j: (-round(sims[i, j], 12), j))[:4]
        assert [round(sims[i, j], 9) for _, j in sorted(near[i])] == [round(sims[i, j], 9) for j in order]
    cells = joins.fit_cells(df, "k", "v", joins.PIVOTS)
    blocks = joins._packed(df, "k", "v", None, "test-blocks", cells)
    n, met = blocks.count(), joins.meeting_blocks(blocks, blocks, cells, F.lit(0.9)).count()
    assert n > 40 and met < n * n / 8
    assert joins.meeting_blocks(blocks, blocks, cells, F.lit(-9.0)).count() == n * n  # nothing to prune by


def test_bounds_hold_for_vectors_of_any_length(spark):
    rng = np.random.default_rng(9)
    points = rng.normal(size=(300, 5)) * rng.uniform(0, 30, (300, 1))
    points[7] = 0
    df = spark.createDataFrame([(i, v) for i, v in enumerate(points.tolist())], "k long, v array<double>")
    exact = points.astype(np.float32).astype(float)
    for threshold in (-50.0, 0.0, 400.0, 1500.0):
        got = {(r["a"], r["b"]) for r in joins.pairs_above(df, "k", "v", threshold, pivots=20).collect()}
        assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if exact[i] @ exact[j] >= threshold}
    assert joins.pairs_above(df.where("false"), "k", "v", 0.5).count() == 0 and joins.neighbours(df, df.where("false"), "k", "v", 3).count() == 0
