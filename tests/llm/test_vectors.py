"""Search and whitening of vectors against plain loops."""

import math

import numpy as np
import pyarrow as pa
import pytest

from siltworks.llm import topk, whitening
from siltworks.llm.whitening import Summary, Whitening

SCHEMA = "vec_id long, embedding array<double>, k int, v string, n int"


def _table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)


def _odd_vectors():
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(0, 300, 2)]
    rows += [(i, [0.5, -0.25, 0.125, 1.0, -1.0, 0.001]) for i in range(301, 401)]  # one vector many times: ties
    rows += [(500, rows[0][1]), (500, rows[0][1]), (550, rows[1][1]), (550, rows[2][1])]  # a row and an id that repeat
    rows += [(600, None), (601, [None] * 6), (650, [1.0, 2.0, None, 0.0, 0.0, 0.0]), (700, [math.nan] + [0.0] * 5), (701, [math.inf] + [0.0] * 5)]
    rows += [(750, [1.0, 2.0]), (751, [3.0, -1.0]), (800, []), (801, []), (850, [7.0]), (None, [0.1] * 6), (900, [0.0] * 6)]
    return rows


def _whole(v, scale, limit):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [max(-limit, min(limit, math.floor(scale * x))) for x in v]


def _nearest(rows, k=5):
    whole = [(i, _whole(v, 256, topk.LIMIT)) for i, v in rows]
    whole = [(i, v) for i, v in whole if v is not None and i is not None]
    out = []
    for q, v in sorted({(i, tuple(v)) for i, v in whole if i % 50 == 0}):
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q and len(w) == len(v))
        out += [(q, r + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_search_by_brute_force(spark):
    rows = _odd_vectors()
    df = _table(spark, rows)
    assert sorted(map(tuple, topk.search_report(df).collect())) == _nearest(rows)
    whole = topk.integer_vectors(df, "vec_id", "embedding")
    tiny = topk.top_inner_products(whole.where("k % 50 = 0"), whole, leaf=3, shard_bytes=400)  # dozens of shards, deep trees
    assert sorted(map(tuple, tiny.collect())) == _nearest(rows)


def test_search_of_huge_components(spark):
    rows = [(i, [s * 10.0**e, 1e300 * s, -3.0]) for i, (s, e) in enumerate([(1, 5), (-1, 5), (1, 8), (-1, 300), (1, 0), (0.5, 7)])]
    rows += [(50, [1e300] * 3), (100, [8e6, 1.0, 1.0])]
    assert sorted(map(tuple, topk.search_report(_table(spark, rows)).collect())) == _nearest(rows)


def test_search_of_nothing(spark):
    assert topk.search_report(_table(spark, [])).count() == 0
    assert topk.search_report(_table(spark, [(0, [1.0])])).count() == 0
    assert topk.search_report(_table(spark, [(1, [1.0]), (2, [1.0])])).count() == 0
    assert topk.search_report(_table(spark, [(0, None), (2, [1.0])])).count() == 0


def _tree(ids, vectors, leaf):
    rows = pa.table({"k": pa.array(ids), "v": pa.array(vectors.tolist(), pa.list_(pa.int32()))})
    leaves = topk._tree_of(leaf)((pa.scalar(vectors.shape[1]), pa.scalar(0)), rows)
    return topk.Tree(leaves, vectors.shape[1], leaf), leaves


def test_boxes_are_tight_and_rule_leaves_out():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(16, 8)) * 400
    vectors = (centres[np.arange(4096) % 16] + rng.normal(size=(4096, 8)) * 3).astype(np.int32)
    tree, leaves = _tree(np.arange(4096), vectors, 64)
    assert len(leaves) == 64 and sorted(tree.ids.tolist()) == list(range(4096))
    for (lo, hi), low, high in zip(tree.nodes, tree.low, tree.high, strict=True):
        assert (tree.vectors[lo:hi].min(0) == low).all() and (tree.vectors[lo:hi].max(0) == high).all()
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            seen.append(at)
            return super().__getitem__(at)

    class Watched:
        def __init__(self, whole):
            self.whole = whole

        def astype(self, kind):
            return self.whole.astype(kind).view(Counted)

    queries = vectors[:4].astype(np.int64)
    tree.vectors = Watched(tree.vectors)
    found = list(tree.search(np.arange(4), queries, 5, [None] * 4))
    assert len(seen) < 4 * 32  # of 4 x 64 leaves
    scores = queries @ vectors.T.astype(np.int64)
    told = []
    for i in range(4):
        want = sorted((-int(s), j) for j, s in enumerate(scores[i]) if j != i)[:5]
        assert found[i] == want
        told.append(want[-1])
    seen.clear()
    again = list(tree.search(np.arange(4), queries, 5, [(s - 10**9, 0) for s, _ in told]))  # a better k-th result from elsewhere
    assert again == [[], [], [], []] and not seen


def test_equal_vectors_fill_one_leaf_only():
    vectors = np.tile(np.array([[3, -4, 5]], np.int32), (5000, 1))
    ids = np.random.default_rng(1).permutation(5000)
    tree, _ = _tree(ids, vectors, 50)
    found = next(tree.search(np.array([2]), np.array([[3, -4, 5]]), 5, [None]))
    assert found == [(-50, 0), (-50, 1), (-50, 3), (-50, 4), (-50, 5)]


def _whitened(rows, components=8):
    x = np.array([_whole(v, 1024, whitening.LIMIT) for _, v in rows], np.float64) + 100_000
    c = x - x.mean(0)
    e, axes = np.linalg.eigh(c.T @ c / len(x))
    e, axes = e[::-1][:components], axes[:, ::-1][:, :components]
    return c @ axes / np.sqrt(e), e / np.trace(c.T @ c / len(x)), x


@pytest.mark.parametrize("parts", [1, 7, 19])
def test_whitening_by_brute_force(spark, parts):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(400, 12)) * np.arange(1, 13) / 9 + 3
    points[50:180] = points[7]  # a third of all rows is one vector
    rows = [(i, v) for i, v in enumerate(points.tolist())]
    want, explained, x = _whitened(rows)
    bad = [(1000, None), (1001, [None] * 12), (1002, [math.nan] * 12), (1003, [math.inf] * 12), (1004, [1.0]), (1005, [])]
    out = whitening.whitening_report(_table(spark, rows + bad).repartition(parts)).collect()
    assert len(out) == 400 * 8 and {r["n"] for r in out} == {400}
    got = np.zeros((400, 8))
    exact = [[int(v) for v in row] for row in x]
    sums = [sum(c) for c in zip(*exact, strict=True)]
    for r in out:
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == sum((400 * a - s) ** 2 for a, s in zip(exact[r["vec_id"]], sums, strict=True))
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9
    signs = np.sign((got * want).sum(0))
    assert np.abs(got * signs - want).max() < 1e-6


def test_summaries_lose_nothing():
    rng = np.random.default_rng(11)
    rows = (rng.normal(size=(300, 20)) * 1000).astype(np.int64) + 10**9
    whole = Summary.of(rows)
    parts = [Summary.of(rows[lo:hi]) for lo, hi in ((0, 1), (1, 2), (2, 9), (9, 150), (150, 300))]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.merge(part)
    assert merged.sums == whole.sums and merged.n == 300
    gram = lambda s: (s.values[:, None] * s.axes).T @ (s.values[:, None] * s.axes)
    centred = rows - rows.mean(0)
    assert np.allclose(gram(merged), centred.T @ centred, rtol=1e-9, atol=1e-3) and np.allclose(gram(whole), gram(merged), rtol=1e-9, atol=1e-3)


def test_whitening_of_huge_entries_keeps_exact_sums():
    rows = np.array([[1 << 52, 5], [-(1 << 52), 7], [3, 9]], np.int64)
    s = Summary.of(rows)
    assert s.sums == [3, 21]
    model = Whitening.of(s)
    assert model.deviations(rows) == [sum((3 * int(a) - t) ** 2 for a, t in zip(row, s.sums, strict=True)) for row in rows]


def test_whitening_of_odd_tables(spark):
    assert whitening.whitening_report(_table(spark, [])).count() == 0
    assert whitening.whitening_report(_table(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whitening_report(_table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    flat = whitening.whitening_report(_table(spark, [(1, [1.0, 2.0]), (None, [1.0, 3.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0])])).collect()
    assert sorted(r["component"] for r in flat) == [1] * 4 and {r["explained"] for r in flat} == {1.0}  # one axis has variance
    assert sorted(abs(round(r["whitened"], 9)) for r in flat) == [0.577350269] * 3 + [1.732050808]
    assert [r["vec_id"] for r in flat].count(None) == 1
    huge = whitening.whitening_report(_table(spark, [(i, [1e300 * (-1) ** i, float(i)]) for i in range(6)])).collect()
    assert {r["deviation"] for r in huge} == {None} and all(math.isfinite(r["whitened"]) for r in huge)
