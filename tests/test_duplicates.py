"""The duplicate search from key frames to splits, inverted files and losses, against plain Python."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks.operators import duplicates, features, images, joins, media, prefix, sequence
from siltworks.plans import catalogue, queries_vision


def vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    return [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float), [r["label"] for r in rows]


def bits(v):
    return sum(1 << i for i, x in enumerate(v) if x > 0)


def test_curation_by_brute_force(spark, sf_dir):
    """Filter, candidates, rule, split and audit again, one frame at a time."""
    ids, e, _ = vectors(spark, sf_dir)
    n, side = len(ids), queries_vision.SIDE
    grey = [np.frombuffer(queries_vision.draw_picture(e[i - i % 4], i % 4)[-side * side :], np.uint8).reshape(side, side).astype(float) for i in range(n)]
    e = np.array([0.35 * e[i - 1] + 0.94 * e[i] if i % 4 == 3 else e[i] for i in range(n)]).astype(np.float32).astype(float)
    points, cells, verified = {}, {}, set()

    def covered(i, j):
        for x in (i, j):
            if x not in points:
                points[x] = [(p.astype(float), d.astype(float)) for p, d in (features.local_features(g) for g in (grey[x], grey[x][:, ::-1]))]
        if (i, j) not in cells:
            cells[i, j] = max(images.match_cells(points[i][0], side_, side) for side_ in points[j])
        return cells[i, j]

    active = [k % 13 != 0 for k in ids]
    ph, dh = [bits(v[:32]) for v in e], [bits(v[32:]) for v in e]
    tex, grp = [k % 7 != 0 for k in ids], [k // 3 for k in ids]
    cos = np.round(e.astype(np.float32).astype(float) @ e.astype(np.float32).astype(float).T, 5)
    ham = lambda a, b: bin(a ^ b).count("1")

    def nearest(queries, refs):
        found = set()
        for i in queries:
            order = sorted((j for j in refs if grp[i] != grp[j]), key=lambda j: (-float(e[i] @ e[j]), ids[j]))[:4]
            found |= {(min(i, j), max(i, j), float(e[i] @ e[j])) for j in order}
        return found

    def rule(i, j):
        if covered(i, j) >= 10:
            verified.add((i, j))
            return True
        if cos[i, j] >= 0.45:
            return True
        return tex[i] and tex[j] and ham(ph[i], ph[j]) <= 6 and ham(dh[i], dh[j]) <= 16

    on = [i for i in range(n) if active[i]]
    cand = {(i, j) for i, j, s in nearest(on, on) if s >= 0.3}
    close = {(i, j): ham(ph[i], ph[j]) for i in on for j in on if i < j and grp[i] != grp[j] and tex[i] and tex[j] and ham(ph[i], ph[j]) <= 8}
    radius = 8
    while radius > 4 and sum(d <= radius for d in close.values()) > 0.5 * len(on):
        radius -= 1
    cand |= {p for p, d in close.items() if d <= radius}
    edges = {p for p in cand if rule(*p)}
    test = {i for i in on if ids[i] % 29 == 0}

    def components(nodes, links):
        root = {i: i for i in nodes}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            if a in root and b in root:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
        return {i: find(i) for i in nodes}

    def split():
        dup = components(on, edges)
        reached = {dup[i] for i in test}
        held = {grp[i] for i in test}
        out = {i: ("filtered", None) for i in range(n) if not active[i]} | {i: ("test", None) for i in test}
        for i in on:
            if i not in test and grp[i] in held:
                out[i] = ("drop", "test_group")
            elif i not in test and dup[i] in reached:
                out[i] = ("drop", "test_duplicate")
        rest = [i for i in on if i not in out]
        same = lambda nodes: {(i, j) for i in nodes for j in nodes if i < j and j - i < 3 and grp[i] == grp[j]}
        roots = components(rest, edges | same(rest))
        whole = components(on, edges | same(on))
        for i in rest:
            draw = int(hashlib.md5(f"7/item/{ids[roots[i]]}".encode()).hexdigest(), 16) % 10_000
            out[i] = ("val" if draw / 10_000 < 0.2 else "train", None)
        return out, whole

    for _ in range(3):
        out, whole = split()
        side = {s: [i for i in on if out[i][0] == s] for s in ("train", "val", "test")}
        found = {(i, j) for i, j, s in nearest(side["val"], side["train"]) | nearest(side["test"], side["train"] + side["val"]) if s >= 0.45 and rule(i, j)}
        if not found:
            break
        edges |= found
    got = {r["idx"]: (r["split"], r["reason"], r["component"]) for r in catalogue.QUERIES["curation_pipeline"](spark, sf_dir).collect()}
    assert got == {ids[i]: (*out[i], ids[whole[i]] if active[i] else -1) for i in range(n)}
    assert {s for s, _, _ in got.values()} >= {"train", "val", "test", "filtered", "drop"} and edges
    assert len({p for p in verified if cos[p] < 0.45}) >= 5  # pairs that only their pictures make duplicates


def test_cells_find_nine_of_ten(spark, sf_dir):
    ids, e, labels = vectors(spark, sf_dir)
    got = {}
    for r in catalogue.QUERIES["nearest_by_cells"](spark, sf_dir).collect():
        got.setdefault(r["query"], set()).add(r["ref"])
    asked = [i for i, k in enumerate(ids) if k % 50 == 0]
    hits = total = 0
    for i in asked:
        order = sorted((j for j in range(len(ids)) if labels[i] != labels[j]), key=lambda j: (-float(e[i] @ e[j]), ids[j]))[:5]
        hits += len({ids[j] for j in order} & got[ids[i]])
        total += len(order)
    assert hits / total >= 0.9
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    exact = joins.pairs_above(frame, "vec_id", "embedding", 0.35).count()
    assert joins.pairs_above(frame, "vec_id", "embedding", 0.35, cells=8, probes=8).count() == exact


@pytest.mark.parametrize(("radius", "within", "n"), [(2, 16, 2), (2, 16, 10**6), (6, 64, 10**9), (3, 24, 10**5)])
def test_masks_hold_every_near_pair(radius, within, n):
    masks = joins.band_masks(radius, within, n)
    rng = np.random.default_rng(4)
    for _ in range(300):
        x = int(rng.integers(0, 1 << 62)) % (1 << within)
        y = x
        for b in rng.choice(within, radius, replace=False):
            y ^= 1 << int(b)
        assert any((x ^ y) & m == 0 for m in masks)
    assert len(masks) <= joins.MAX_MASKS


def test_hamming_join_by_brute_force(spark):
    rng = np.random.default_rng(5)
    xs = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 200)]
    xs += [(x % (1 << 64)) ^ (1 << 63 if x < 0 else 5) for x in xs[:60]]
    xs = [x - (1 << 64) if x >= 1 << 63 else x for x in xs]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)] + [(999, None)], "k long, x long")
    got = {(r["a"], r["b"], r["hamming"]) for r in joins.hamming_join(df, "k", "x", 2).collect()}
    mask = (1 << 64) - 1
    assert got == {(i, j, d) for i in range(len(xs)) for j in range(i + 1, len(xs)) if (d := bin((xs[i] ^ xs[j]) & mask).count("1")) <= 2}


def test_the_row_before_in_a_global_order(spark):
    rows = [(i, (i * 7919) % 1009) for i in range(1009)]
    df = spark.createDataFrame(rows, "k long, x long").repartition(5)
    out = sorted(prefix.with_running(df, [F.col("x")], {"upto": F.col("x")}, lags={"last": F.col("k")}).collect(), key=lambda r: r["x"])
    order = sorted(rows, key=lambda r: r[1])
    assert [r["rank"] for r in out] == list(range(1, 1010)) and [r["upto"] for r in out] == list(np.cumsum([x for _, x in order]))
    assert [r["last"] for r in out] == [None, *(k for k, _ in order[:-1])]
    assert prefix.with_running(df.where("false"), [F.col("x")], lags={"last": F.col("k")}).count() == 0


def test_quantiles_of_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(g, float(x)) for g, n in (("a", 400), ("b", 1), ("c", 7)) for x in rng.integers(0, 30, n)] + [("a", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    for p in (0.0, 0.3, 0.95, 1.0):
        got = {r["g"]: r["q"] for r in prefix.group_quantiles(df, ["g"], "x", p, "q").collect()}
        want = {g: np.quantile([x for h, x in rows if h == g and x is not None], p) for g in ("a", "b", "c", None)}
        assert got == pytest.approx(want)
    assert prefix.group_quantiles(df.where("false"), [], "x", 0.5, "q").where("q IS NOT NULL").count() == 0


def test_last_average_of_long_histories(spark):
    rng = np.random.default_rng(7)
    rows = [(k, i, float(rng.random())) for k, n in ((1, 3000), (2, 1), (None, 50)) for i in range(n)]
    got = {r["k"]: r["last"] for r in sequence.last_ema(spark.createDataFrame(rows, "k long, i long, x double"), "k", "i", "x", 0.9).collect()}
    for key in (1, 2, None):
        s = None
        for n, x in enumerate((x for k, _, x in rows if k == key), 1):
            d = min(0.9, (1 + n) / (10 + n))
            s = x if s is None else d * s + (1 - d) * x
        assert got[key] == pytest.approx(s, rel=1e-9)


def test_states_stream_over_batches(spark):
    rows = [(i % 3, i, float(i % 7) if i % 11 else None) for i in range(900)]
    out = sequence.blended(spark.createDataFrame(rows, "k long, i long, x double"), "k", "i", "x", 1.0, 4.0, 0.5).collect()
    for key in range(3):
        h, want = None, {}
        for _, i, x in (r for r in rows if r[0] == key):
            h = h if x is None else x if h is None else min(max(h, 1.0), 4.0) * 0.5 + x * 0.5
            want[i] = h
        assert {r["i"]: r["blended"] for r in out if r["k"] == key} == pytest.approx(want, nan_ok=True)


def test_losses_by_hand():
    a, b = np.arange(90.0).reshape(9, 10) / 90, np.zeros((9, 10))
    assert media.gradient_loss(a, b) == pytest.approx((2 + 20) / 90)
    assert media.spectrum_loss(a, a) == 0 and media.spectrum_loss(np.ones((4, 4)), np.zeros((4, 4))) == pytest.approx(4 / 12)
    total = 0.0
    for y in range(3, 6):
        for x in range(3, 7):
            for v in range(-3, 4):
                for u in range(-3, 4):
                    d = a[y + v, x + u] - a[y, x]
                    s = (d / (0.81 + d * d) ** 0.5) ** 2
                    total += s / (0.1 + s) / (12 * 49)
    assert media.census_loss(a, b) == pytest.approx(total) and media.census_loss(a, a) == 0


def test_losses_of_missing_images(spark):
    flat = [float(i % 8) for i in range(64)]
    df = spark.createDataFrame([(1, flat, [0.0] * 64), (2, None, [0.0] * 64)], "k long, a array<double>, b array<double>")
    out = {r["k"]: (r["gradient"], r["spectrum"], r["census"]) for r in media.with_losses(df, "a", "b", 8).collect()}
    assert out[1][0] == pytest.approx(2.0) and out[1][2] > 0 and out[2] == (None, None, None)
    same = media.batches_of(df.select("k"), lambda b: b.assign(k=b["k"] * 2), "k long")
    assert sorted(r["k"] for r in same.collect()) == [2, 4] and same.agg(F.sum("k")).first()[0] == 6


def test_pairs_are_counted_without_being_made(spark):
    rng = np.random.default_rng(12)
    base = [int(x) for x in rng.integers(0, 1 << 30, 6)]
    rows = [(i, None if i % 9 == 0 else i % 5, base[0] if i < 60 else base[i % 6] ^ (1 << (i % 4)) if i % 3 else base[i % 6]) for i in range(150)] + [(900, 1, None)]
    df = spark.createDataFrame(rows, "k long, grp long, ph long").withColumn("textured", F.lit(True))
    want = {}
    for i, (a, g, x) in enumerate(rows):
        for b, h, y in rows[i + 1 :]:
            if x is not None and y is not None and g != h and bin(x ^ y).count("1") <= 6:
                want[min(a, b), max(a, b)] = bin(x ^ y).count("1")
    near = [(x, y, bin(x ^ y).count("1")) for x in set(r[2] for r in rows if r[2] is not None) for y in set(r[2] for r in rows if r[2] is not None) if x < y and bin(x ^ y).count("1") <= 6]
    counts = duplicates.hash_pair_counts(spark.createDataFrame(near, "x long, y long, hamming int"), df.where("ph IS NOT NULL"))
    got = {r["hamming"]: r["n"] for r in counts.collect() if r["n"]}
    assert got == {d: sum(v == d for v in want.values()) for d in set(want.values())}
    for most in (10**9, 12, 1):
        radius = 6
        while radius > 1 and sum(v <= radius for v in want.values()) > most:
            radius -= 1
        pairs = duplicates.hash_candidates(df, 1, {"h_least": 1, "h_cand": 6}, most, 30)
        assert {(r["a"], r["b"]) for r in pairs.collect()} == {p for p, d in want.items() if d <= radius}
