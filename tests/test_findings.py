"""Cases of single findings: one small test each, that failed before."""

import hashlib

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from siltworks import scratch
from siltworks.functions import numbers
from siltworks.llm import minhash
from siltworks.operators import duplicates, features, images, joins, jpeg, prefix, sampling, sequence
from siltworks.plans import catalogue, queries_vision
from tests.compare import assert_same


def test_detail_mask_of_gradients_a_bit_apart(spark, tmp_path):
    """The quantile of each image lies between two gradients that differ in their last bit; rounding decides who reaches it."""
    rows = []
    for image in range(20):
        high = 90.11 + 0.37 * image
        low = float(np.nextafter(high, 0))
        line = [high, 0.0, *[low, 0.0] * 7, high, 0.0, low]  # gradients: 15 low ones, 3 high ones and a zero
        rows += [(image, 1000 * image + i, v) for i, v in enumerate(line)]
    spark.createDataFrame(pd.DataFrame(rows, columns=["user_id", "event_id", "value"])).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert_same(catalogue.QUERIES["detail_mask"](spark, str(tmp_path)), con, catalogue.ORACLES["detail_mask"])


def test_jpeg_of_one_level_where_rounding_adds_up():
    """One block in some hundred thousand: the remainders of its 64 coefficients push one pixel the same way."""
    block = [
        154, 86, 11, 223, 81, 238, 244, 24, 44, 164, 89, 248, 109, 16, 84, 247,
        149, 97, 3, 113, 49, 133, 86, 226, 254, 212, 217, 10, 171, 161, 122, 194,
        225, 243, 21, 250, 71, 157, 16, 171, 60, 161, 148, 130, 216, 177, 254, 33,
        169, 189, 199, 3, 196, 123, 104, 111, 165, 129, 211, 7, 93, 112, 29, 104,
    ]
    grey = np.reshape(block, (8, 8))
    assert np.abs(np.rint(jpeg.restored(jpeg.quantised(grey, 1), 1, 8, 8)) - grey).max() > 1
    wide = np.pad(grey, ((0, 13), (8, 3)), mode="edge")  # among other blocks, which are not whole
    for picture in (grey, wide):
        assert np.abs(images.decode_image(jpeg.encode_jpeg(picture))[..., 0].astype(int) - picture).max() <= 1


def test_hashes_under_masks_are_not_broadcast(spark, capsys):
    """Each hash is there once a mask: what is broadcast of a small file is many times as large."""
    rows = spark.range(500).selectExpr("id AS k", "xxhash64(id) & 16777215 AS x")
    joins.hamming_join(rows, "k", "x", 3, within=24).explain()
    plan = capsys.readouterr().out
    at_masks = [line for line in plan.splitlines() if "Join" in line and "mask" in line]
    assert at_masks and all("SortMergeJoin" in line for line in at_masks)


def test_members_of_one_component_are_not_paired(spark):
    """A short list of 30 near copies: its hub links them, and then no pair is left; of two components one member each meets."""
    texts = [(i, "a b c d e f g h i j k l m n o p q r s t " + f"x{i}", i) for i in range(30)]
    search = minhash._Search(spark.createDataFrame(texts, "doc_id long, text string, text_hash long"), 4, 80, 100)
    members = search.with_hub(search.sets.selectExpr("7L AS key", "v", "n"))
    vs = sorted(r["v"] for r in search.sets.select("v").collect())
    assert search.hub_pairs(members).count() == 29
    stars = spark.createDataFrame([(v, vs[0]) for v in vs[1:]], "vertex long, root long")
    assert search.paired(members, stars).count() == 0
    apart = spark.createDataFrame([(v, vs[0]) for v in vs[1:28]] + [(vs[29], vs[28])], "vertex long, root long")
    got = {(r["a"], r["b"]) for r in search.paired(members, apart).collect()}
    assert got == {(v, w) for v in vs[1:28] for w in vs[28:]}


def test_weights_of_hot_sets_make_no_row_a_common_value(spark, monkeypatch):
    """600 sets share five values, 40 of them one more: common values are summed where they lie (before: a joined row each)."""
    rows = [(v, sorted([-7, 1, 2, 3, 2**62, *([9] if v < 40 else []), 1000 + v])) for v in range(600)]
    made = []

    def counted(df, name, by=None):
        out = scratch.scratch_table(df, name, by)
        if name == "top-weights":
            made.append(out.selectExpr("sum(size(others))").first()[0])
        return out

    monkeypatch.setattr(minhash, "scratch_table", counted)
    got = {r["v"]: r["weight"] for r in minhash._weights(spark.createDataFrame(rows, "v long, sketch array<long>"), len(rows)).collect()}
    assert made == [640]
    assert all(abs(got[v] - (5 * np.log(600) + (np.log(40) if v < 40 else 0))) < 1e-9 for v in range(600)) and len(got) == 600


def test_crowd_below_the_threshold_makes_no_pairs(spark, monkeypatch):
    """A family and a crowd that shares 0.71 to 0.76 with its members: parities tell them apart, links stay (before: pairs of both)."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]

    def copy(spots, mark):
        return " ".join(f"{mark}_{i}" if i in spots else w for i, w in enumerate(base))

    texts = [copy({3 + 5 * (i % 20)}, f"a{i}") for i in range(60)]  # one family
    texts += [copy(set(rng.choice(np.arange(6, 110, 5), 4, replace=False).tolist()), "b") for _ in range(120)]
    asked = []
    before = minhash._rest_pairs

    def counted(search, members):
        out = before(search, members)
        asked.append((members.where("open").count(), out.count()))
        return out

    monkeypatch.setattr(minhash, "_rest_pairs", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_dedup(docs, shingle_words=4).collect()}
    sets = [{tuple(t.split()[i : i + 4]) for i in range(117)} for t in texts]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert got == dict(enumerate(root))
    assert asked[0][1] < 4_000  # 5,393 without parities


def test_parities_bound_how_sets_differ(spark):
    """Never above the true difference, near it for sets of some hundred, and a link at the threshold is not left out."""
    rng = np.random.default_rng(3)
    rows = []
    for n, own in ((9, 1), (90, 10), (90, 30), (900, 100), (4500, 500), (180, 60)):
        common, x, y = (rng.integers(-(2**62), 2**62, m) for m in (n - own, own, own))
        px, py = (minhash._parity(np.unique(np.concatenate([common, z]))) for z in (x, y))
        differ = int(np.bitwise_count((px ^ py).view(np.uint64)).sum())
        assert differ <= 2 * own and (n > 200 or differ >= 1.6 * own)
        rows.append((n, n, px.tolist(), py.tolist(), 10 * (n - own) >= 8 * (n + own)))
    df = spark.createDataFrame(rows, "nx long, ny long, px array<long>, py array<long>, linked boolean")
    fit = [(r["linked"], r["fit"]) for r in df.withColumn("fit", minhash._parities_fit(80, 100)).collect()]
    assert all(fits for linked, fits in fit if linked) and (False, False) in fit


def test_best_of_a_block_sorts_what_reaches_the_floor():
    """Ties to the lesser key, numbers that are none, groups and rows with and without a floor, as a plain sort finds them."""
    rng = np.random.default_rng(2)
    sims, kb = rng.integers(0, 9, (40, 60)).astype(float), rng.permutation(60)
    sims[3], sims[4, 5], sims[5, ::2] = -np.inf, np.nan, np.nan
    ga, gb = (np.array([None if g == 3 else str(g) for g in rng.integers(0, 5, n)], object) for n in (40, 60))
    one, two = joins._codes(ga, gb)
    same = one[:, None] == two[None, :]
    assert same.tolist() == [[a is not None and a == b for b in gb] for a in ga] and same.any()
    sims[same] = -np.inf
    for k in (1, 4, 60, 99):
        plain = [sorted((-s, key) for s, key in zip(row, kb, strict=True) if np.isfinite(s))[:k] for row in sims]
        floor = np.array([-row[-1][0] if len(row) == k and i % 3 else -np.inf for i, row in enumerate(plain)])
        for least in (None, floor):
            x = sims.copy()
            rows, cols = joins._best(x, kb, k, least)
            assert [[(-x[r, c], kb[c]) for r, c in zip(rows, cols, strict=True) if r == i] for i in range(40)] == plain


def test_pictures_are_dealt_by_number(spark, tmp_path, monkeypatch):
    """As many tasks as there are pictures to share, however small the rows (before: merged to one by their size)."""
    spark.range(200).selectExpr("id AS vec_id", "array_repeat(float(id), 64) AS embedding", "int(id) AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(queries_vision, "TASK_PICTURES", 20)
    parts = queries_vision.pictures(spark, str(tmp_path)).select("k", F.spark_partition_id().alias("part")).collect()
    assert len(parts) == 200 and len({r["part"] for r in parts}) == 10


def _pacing_rows(spark, tmp_path, quantities):
    rows = [("R", i // 7, i % 7, q) for i, q in enumerate(quantities)]
    spark.createDataFrame(rows, "l_returnflag string, l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert_same(catalogue.QUERIES["frame_pacing"](spark, str(tmp_path)), con, catalogue.ORACLES["frame_pacing"])


def test_frame_pacing_orders_frames_once(spark, tmp_path, monkeypatch):
    """No table that it writes has more rows than there are frames (before: four and seven times as many)."""
    written = []

    def counted(df, name, by=None):
        out = scratch.scratch_table(df, name, by)
        written.append(out.count())
        return out

    monkeypatch.setattr(sequence, "scratch_table", counted)
    monkeypatch.setattr(prefix, "scratch_table", counted)
    _pacing_rows(spark, tmp_path, [float(1 + i * 37 % 50) for i in range(700)])
    assert max(written) == 700


def test_frame_pacing_of_frames_shown_out_of_order(spark, tmp_path):
    """A cheap frame after a dear one is shown before that one's generated frame."""
    _pacing_rows(spark, tmp_path, [float(400 if i % 9 == 4 else 1 + i * 37 % 50) for i in range(700)])


def test_metric_formats_look_at_a_name_once(spark):
    """No list of words is made, and odd numbers look as before."""
    rows = [("x_ms", -0.01), ("x_ms", -1.26), ("items", 1234.5678), ("lpips", float("nan")), ("flips", 0.5), ("a flip", 0.5), ("ssim", None), ("ssim", 0.995), ("warp", -12345.6), (None, 2.0)]
    df = spark.createDataFrame(rows, "c string, v double")
    out = df.select(numbers.format_metric(F.col("c"), F.col("v")).alias("shown"))
    assert [r["shown"] for r in out.collect()] == ["0.0", "-1.3", "1,235", "NaN", "0.5", "0.500", None, "0.9950", "-12,345.6000", "2"]
    assert "regexp_extract_all" not in out._jdf.queryExecution().toString()


def test_synthetic_copies_take_one_hash_a_word(spark):
    """No column expression hashes each word of a text; keys and texts that are null, and other alphabets, as before."""
    rows = [(1, "straße über  alles " * 20), (None, "a b c d e f g h " * 9), (2, None), (3, ""), (4, " ")]
    out = sampling.text_copies(spark.createDataFrame(rows, "k long, t string"), "k", "t", 3)
    plain = []
    for key, text in rows:
        for kind, by in (("light", 1.0), ("heavy", 3.0)):
            kept = []
            for i, word in enumerate(text.split(" ") if text is not None else []):
                name = "/".join([*([str(key)] if key is not None else []), kind, str(i)])
                u = int(hashlib.md5(f"3/{name}".encode()).hexdigest()[:13], 16) / 2**52
                if word and u >= 0.05 * by:
                    kept.append("".join(c.upper() if "a" <= c <= "z" else c for c in word) if u < (0.05 + 0.1) * by else word)
            plain.append((key, kind, None if text is None else " ".join(kept)))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(plain, key=str)
    assert "md5" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_distances_are_counted_without_pairs(spark, tmp_path, monkeypatch):
    """Counts of a dense set against all pairs, and ``adaptive_radius`` makes none (before: a row a pair, a terabyte of them in all)."""
    rng = np.random.default_rng(8)
    for within, n in ((2, 3), (9, 300), (13, 900)):
        xs = sorted({int(x) for x in rng.integers(0, 1 << within, n)})
        got = {r["hamming"]: r["n"] for r in joins.distance_counts(spark.createDataFrame([(x,) for x in [*xs, *xs[:5], None]], "x long"), "x", within).collect()}
        ds = [(x ^ y).bit_count() for i, x in enumerate(xs) for y in xs[i + 1 :]]
        assert got == {d: ds.count(d) for d in range(1, within + 1)}
    # Texts that repeat, are missing or have no number, and a number that two texts share.
    rows = [(i, f"text {i % 900}") for i in range(1200)] + [(5, "five"), (5, "other"), (-1, "a"), (-1, "b"), (None, "text 3"), (None, "none"), (7000, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    monkeypatch.delattr(joins, "hamming_join")
    assert_same(catalogue.QUERIES["adaptive_radius"](spark, str(tmp_path)), con, catalogue.ORACLES["adaptive_radius"])


def test_hash_candidates_write_no_pair_beyond_the_radius(spark, monkeypatch):
    """180,000 pairs within 8 bits, of which the radius leaves some thousand: they are counted in blocks (before: all were written first)."""
    rng = np.random.default_rng(9)
    rows = [(i, None if i % 50 == 0 else i % 40, int(x)) for i, x in enumerate(rng.integers(0, 1 << 12, 600))] + [(900, 1, None)]
    written = []

    def counted(df, name, by=None):
        out = scratch.scratch_table(df, name, by)
        written.append(out.count())
        return out

    for module in (duplicates, joins):
        monkeypatch.setattr(module, "scratch_table", counted)
    monkeypatch.setattr(duplicates, "HASH_BLOCK", 100, raising=False)
    df = spark.createDataFrame(rows, "k long, grp long, ph long").withColumn("textured", F.lit(True))
    ds = {(a, b): (x ^ y).bit_count() for i, (a, g, x) in enumerate(rows[:-1]) for b, h, y in rows[i + 1 : -1] if g != h}
    for most in (20, 3):
        radius = max([r for r in range(1, 9) if sum(d <= r for d in ds.values()) <= most * 600], default=1)
        got = [(r["a"], r["b"]) for r in duplicates.hash_candidates(df, 600, {"h_least": 1, "h_cand": 8}, most, 12).collect()]
        assert len(got) == len(set(got)) and set(got) == {p for p, d in ds.items() if d <= radius} and radius < 8
    assert max(written) <= 601


def test_curation_loses_no_pair_to_a_crowd(spark):
    """200 frames of one look make 100 pairs a frame: rarer duplicates at six bits, and those only pictures show, stay (before: the radius fell to one)."""
    rng = np.random.default_rng(10)
    rows = [(k, 7 ^ (1 << (k % 3))) for k in range(200)]  # a crowd that a test item, frame 0, reaches
    for k in range(200, 280, 2):
        x = int(rng.integers(1 << 40, 1 << 62))
        rows += [(k, x), (k + 1, x ^ (0b111111 << 3 if k < 240 else 0b11111111 << 3))]
    asked = []

    def verify(pairs):
        asked.extend((r["a"], r["b"]) for r in pairs.collect())
        return pairs.withColumn("cells", F.when((F.col("a") >= 240) & (F.col("a") % 4 == 0), 12).otherwise(0))

    frames = spark.createDataFrame([(k, k, [1.0 if i == k % 3 else 0.0 for i in range(3)], x, x) for k, x in rows], "k long, grp long, embedding array<float>, ph long, dh long")
    frames = frames.selectExpr(
        "k", "grp", "embedding", "ph", "dh", "true AS textured", "if(k = 0, 'test', 'train') AS role", "'still' AS kind", "true AS ok", "512 AS width", "512 AS height",
        "40.0D AS std", "0.0D AS letterbox", "50.0D AS sharpness",
    )
    limits = {"h_exact": 6, "h_least": 1, "h_cand": 8, "t_cells": 10, "t_ret": 2.0, "t_strong": 2.0}
    got = {r["idx"]: (r["component"], r["split"]) for r in duplicates.curate(frames, limits, verify, 0.2, 7, k=3, within=64).collect()}
    assert {got[k] for k in range(1, 200)} == {(0, "drop")} and got[0] == (0, "test")
    assert all((got[k][0] == got[k + 1][0]) == (k < 240 or k % 4 == 0) for k in range(200, 280, 2))
    assert sorted(asked) == [(k, k + 1) for k in range(240, 280, 2)]


def test_octaves_are_blurred_by_one_matrix_a_size(monkeypatch):
    """A picture's octaves do without the kernel's sliding windows (before: 21 blurs by them), and come out the same."""
    rng = np.random.default_rng(11)
    for shape in ((96, 96), (40, 61), (12, 13)):
        grey = features._blurred(rng.random(shape) * 255, 2.0)
        for sigma in (0.7, 1.5, 3.1):
            assert np.allclose(features._soft(grey, sigma), features._blurred(grey, sigma), rtol=0, atol=1e-10)
    picture = np.kron(rng.random((8, 8)) * 255, np.ones((12, 12)))
    with monkeypatch.context() as m:
        m.setattr(features, "_soft", features._blurred, raising=False)
        want = features.local_features(picture)
    monkeypatch.setattr(features, "_blurred", None)
    points, descriptors = features.local_features(picture)
    assert len(points) > 5 and np.allclose(points, want[0], atol=1e-3) and np.abs(descriptors.astype(int) - want[1]).max() <= 1
