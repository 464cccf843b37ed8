"""Rules against hand-made fixtures with known results."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltworks.functions import hashing, numbers, text
from siltworks.operators import aggregate, arrays, joins, rules, sampling, sequence, split, window
from siltworks.sources import catalogue, sinks, tables

LIMITS = {"h_exact": 6, "t_cells": 10, "t_strong": 0.9648}


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("n, at", [(1, [0]), (3, [1]), (7, [3]), (23, [11]), (24, [2, 12, 21]), (100, [10, 50, 89])])
def test_key_positions(spark, n, at):
    assert value(spark, window.key_positions(F.lit(n).cast("long"))) == at


def test_split_fixture(spark):
    rows = [
        (0, "a0", "gA", "train"), (1, "a1", "gA", "train"), (2, "b0", "gB", "test"), (3, "b1", "gB", "train"), (4, "c0", "gC", "train"),
        (5, "c1", "gC", "train"), (6, "d0", "gD", "train"), (7, "e0", "gE", "train"), (8, "f0", "gF", "train"),
    ]
    items = spark.createDataFrame([(*r, True) for r in rows], "idx long, item_id string, group string, role string, active boolean")
    edges = spark.createDataFrame([(2, 4), (4, 6), (7, 8)], "a long, b long")
    done = {r["idx"]: r for r in split.assign_splits(items, edges, 0.5, 7).collect()}
    assert [done[i]["split"] for i in range(9)] == ["val", "val", "test", "drop", "drop", "train", "drop", "train", "train"]
    assert [done[i]["reason"] for i in range(9)] == [None, None, None, "test_group", "test_duplicate", None, "test_duplicate", None, None]
    assert [done[i]["component"] for i in range(9)] == [0, 0, 2, 2, 2, 2, 2, 7, 7]
    assert done[5]["split_root"] == 5
    report = split.split_report(split.assign_splits(items, edges, 0.5, 7)).first()
    assert (report["largest_duplicate_cluster"], report["trainval_components"], report["n_drop"]) == (3, 3, 3)


def test_inactive_items_are_filtered(spark):
    items = spark.createDataFrame([(0, "a", "g", "test", False), (1, "b", "g", "train", True)], "idx long, item_id string, group string, role string, active boolean")
    edges = spark.createDataFrame([(0, 1)], "a long, b long")
    done = {r["idx"]: (r["split"], r["component"]) for r in split.assign_splits(items, edges, 0.0, 7).collect()}
    assert done == {0: ("filtered", -1), 1: ("train", 1)}


def test_audit_ends_without_crossings(spark):
    items = spark.createDataFrame([(i, f"i{i}", f"g{i}", "test" if i % 7 == 0 else "train", True) for i in range(40)], "idx long, item_id string, group string, role string, active boolean")
    copies = spark.createDataFrame([(i, i + 1) for i in range(0, 39, 2)], "a long, b long")
    none = copies.where("false")
    done, left, _, rounds = split.split_and_audit(items, none, lambda now: split.crossing(now, copies), 0.3, 7)
    assert left.count() == 0 and rounds >= 2
    assert split.crossing(done, copies).count() == 0


def test_bucket(spark):
    assert value(spark, hashing.seeded_bucket(F.lit("item1"), 7)) == 41


@pytest.mark.parametrize(
    "cos, ham, dham, cells, textured, rule",
    [(0.5, 6, 16, 0, True, "exact_hash"), (0.5, 6, 17, 0, True, ""), (0.5, 0, 0, 0, False, ""), (0.97, 0, 0, 0, True, "strong_embedding"),
     (0.97, 0, 0, 10, True, "verified"), (math.nan, 20, 40, 9, True, ""), (None, 20, 40, 9, True, "")],
)
def test_edge_rule(spark, cos, ham, dham, cells, textured, rule):
    assert value(spark, rules.edge_rule(F.lit(cos).cast("double"), F.lit(ham), F.lit(dham), F.lit(cells), F.lit(textured), LIMITS)) == rule


def test_edge_rule_without_embeddings(spark):
    limits = {k: LIMITS[k] for k in ("h_exact", "t_cells")}
    assert value(spark, rules.edge_rule(F.lit(0.99), F.lit(9), F.lit(0), F.lit(0), F.lit(True), limits)) == ""


def test_quality_reasons(spark):
    rows = [
        (0, "still", True, 256, 255, 7.9, 0.36, 19.0), (1, "seq", True, 300, 300, 8.0, 0.35, 4.0), (1, "seq", True, 300, 300, 9.0, 0.1, 6.0),
        (1, "seq", True, 300, 300, 9.0, 0.1, 30.0), (2, "seq", False, 1, 1, 0.0, 1.0, 0.0), (2, "seq", True, 300, 300, 9.0, 0.1, 30.0),
    ]
    frames = spark.createDataFrame(rows, "item int, kind string, ok boolean, width int, height int, std double, letterbox double, sharpness double")
    got = {r["item"]: (r["reasons"], r["keep"]) for r in rules.quality_reasons(frames).collect()}
    assert got == {0: (["too_small", "flat", "letterbox", "blurry"], False), 1: ([], True), 2: (["decode_error"], False)}
    items = rules.items_kept(spark.createDataFrame([(0,), (9,)], "item int"), rules.quality_reasons(frames))
    assert {r["item"]: (r["keep"], r["reasons"]) for r in items.collect()}[9] == (False, None)


@pytest.mark.parametrize("n, at", [(2, 0), (100, 98), (101, 99), (192, 189)])
def test_index_quantile(spark, n, at):
    df = spark.range(n).select("id", F.col("id").cast("double").alias("x"))
    assert aggregate.index_quantile(df, "x", "id", 0.99).first()["value"] == at


def test_index_quantile_of_nothing(spark):
    assert aggregate.index_quantile(spark.range(0).select("id", F.col("id").cast("double").alias("x")), "x", "id", 0.99).count() == 0


def test_linear_quantiles(spark):
    df = spark.range(101).select((F.col("id") * F.col("id")).alias("x"))
    got = {round(r["point"], 3): r["value"] for r in aggregate.linear_quantiles(df, "x", [0.999, 0.02, 0.5]).collect()}
    assert got[0.999] == pytest.approx(9980.1) and got[0.02] == pytest.approx(4.0) and got[0.5] == 2500


@pytest.mark.parametrize(
    "raw, slug",
    [("rife_4.26", "rife_4_26"), ("student+ui_layer", "student_ui_layer"), ("max cosine", "max_cosine"),
     ("est_ms assumed iGPU (4 TFLOPS FP16 sustained)", "est_ms_assumed_igpu_4_tflops_fp16_sustained"), ("", "")],
)
def test_slug(spark, raw, slug):
    assert value(spark, text.slug(F.lit(raw))) == slug


def test_number_texts(spark):
    v = lambda c: value(spark, c)
    assert v(numbers.significant(F.lit(12345.678))) == "12,346"
    assert v(numbers.significant(F.lit(0.000123456))) == "0.0001235"
    assert v(numbers.significant(F.lit(0.63))) == "0.63"
    assert v(numbers.significant(F.lit(0.0))) == "0"
    assert v(numbers.fixed(F.lit(1234.5), 1)) == "1,234.5"
    assert v(numbers.fixed(F.lit(-1.005), 2, "minus ")).startswith("minus 1.0")
    assert v(numbers.count_text(F.lit(138_400.0))) == "138K" and v(numbers.count_text(F.lit(1_410_000.0))) == "1.41M"
    assert [v(numbers.decimals_of(F.lit(c), F.lit(x))) for c, x in (("psnr_y", 1.0), ("ssim", 0.5), ("ssim", 0.99), ("t4_mean_ms", 1.0), ("warp_err", 1.0), ("mv_px", 1.0))] == [2, 3, 4, 1, 4, None]


def test_text_parts(spark):
    v = lambda c: value(spark, c)
    assert v(text.natural_key(F.lit("im2.png"))) < v(text.natural_key(F.lit("im10.png")))
    assert v(text.path_tokens(F.lit("Set-A/LR_x4/im 1.hr.png"))) == ["set", "a", "lr", "x4", "im", "1", "hr"]
    assert v(text.path_tokens(F.lit(".hidden"))) == ["hidden"]
    assert not v(text.is_clean(text.path_tokens(F.lit("a/lr4/b.png")))) and v(text.is_clean(text.path_tokens(F.lit("a/hr/b.png"))))
    assert v(text.escape_chars(F.lit("a_b&c\\"))) == "a\\_b\\&c\\textbackslash{}"
    assert v(text.uri_path(F.lit("kaggle:own/set|p/q.png"))) == "p/q.png" and v(text.uri_frame(F.lit("mp4:a.mp4#12"))) == 12


def test_unknown_values_do_not_count(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, math.nan), ("a", 2, 3.0), (None, 3, 9.0)], "g string, i int, x double")
    assert [tuple(r) for r in aggregate.group_means(df, ["g"], ["x"]).collect()] == [("a", 2.0)]
    rows = spark.createDataFrame([("a", 0, math.nan), ("a", 1, 5.0), ("a", 2, 7.0), ("a", 3, 7.0)], "g string, i int, x double")
    assert window.best_row(rows, ["g"], "x", "i").first()["i"] == 2


def test_windows(spark):
    df = spark.createDataFrame([(10,), (3,)], "n int")
    assert [r["start"] for r in window.sliding_windows(df, "n", 6).collect()] == [0, 3]
    df = spark.createDataFrame([(7,)], "n int")
    assert [r["start"] for r in window.sliding_windows(df, "n", 4).collect()] == [0, 2]


def test_json_leaves(spark):
    docs = spark.createDataFrame([(1, '{"a/b": [1, true, {"c": 2.5}], "d": null, "e": "x"}'), (2, "no json"), (3, None)], "k int, t string")
    got = {(r["k"], r["path"]): r["number"] for r in tables.flatten_json(docs, "k", "t", "p.s").collect()}
    assert got == {(1, "p.s.a.b.0"): 1.0, (1, "p.s.a.b.2.c"): 2.5}


def test_psnr(spark):
    same = spark.range(51).select(F.lit("i").alias("k"), F.lit(0.5).alias("a"), F.lit(0.5).alias("b"), F.lit(1).alias("m"))
    assert arrays.group_psnr(same, ["k"], "a", "b").first()["psnr"] == pytest.approx(100)
    assert arrays.group_psnr(same, ["k"], "a", "b", "m").first()["psnr"] == pytest.approx(100)
    assert arrays.group_psnr(same.limit(50), ["k"], "a", "b", "m").first()["psnr"] is None


def test_results_are_defined_once(spark, tmp_path):
    twice = spark.createDataFrame([("a", "1"), ("a", "2")], "key string, text string")
    with pytest.raises(ValueError, match="defined twice: a"):
        sinks.write_results(twice, str(tmp_path / "r"))
    with pytest.raises(ValueError, match="no rule for z"):
        tables.dispatch(["a", "z"], {"a": "table"})
    with pytest.raises(KeyError):
        tables.source_of(spark.createDataFrame([("a",)], "name string"), "b")


def test_published_means_reproduce(spark):
    """Dataset totals add up: items by split, from constants of a published table."""
    counts = spark.createDataFrame([("train", 8874), ("val", 1087), ("test", 1432), ("drop", 756), ("filtered", 151)], "split string, n long")
    assert counts.agg(F.sum("n")).first()[0] == 12_300


def test_calibration_limits(spark):
    rows = [(1, "light", 0.95, 2, 30), (1, "heavy", 0.7, 9, 20), (0, "hard", 0.99, 5, 50), (0, "random", 0.1, 30, 0)]
    t = rules.calibrate(spark.createDataFrame(rows, "label int, kind string, cosine double, hamming int, cells int")).first()
    assert t["t_ret"] == pytest.approx(0.705) and t["t_strong"] == 0.995 and t["t_cells"] == 40 and t["h_exact"] == 1 and t["h_cand"] == 2


def test_adaptive_radius(spark):
    pairs = spark.createDataFrame([(h,) for h in range(13) for _ in range(10)], "hamming int")
    assert rules.adaptive_radius(pairs, 4, 2, 12, per_item=20) == 7
    assert rules.adaptive_radius(pairs, 0, 2, 12) == 2


def test_hashes_of_images(spark):
    rng = np.random.default_rng(0)
    image = rng.random((32, 32))
    assert arrays.low_frequency_bits(image) == arrays.low_frequency_bits(image * 0.5 + 0.2)
    assert bin(arrays.low_frequency_bits(image) & (2**64 - 1)).count("1") in range(24, 41)
    ramp = np.tile(np.arange(9.0), (8, 1))
    assert arrays.gradient_bits(ramp) == -1 and arrays.gradient_bits(ramp[:, ::-1]) == 0
    df = spark.createDataFrame([(image.ravel().tolist(), ramp.ravel().tolist()), (None, None)], "s array<double>, w array<double>")
    got = arrays.with_hashes(df, "s", "w").select("phash", "dhash").collect()
    assert (got[0]["phash"], got[0]["dhash"]) == (arrays.low_frequency_bits(image), -1) and got[1]["phash"] is None
    assert arrays.ssim(image, image) == pytest.approx(1.0)
    flow = np.zeros((32, 32, 2))
    assert np.allclose(arrays.backward_warp(image, flow), image)


def test_binary_formats(spark):
    good = np.float32(202021.25).tobytes() + np.array([2, 1], "<i4").tobytes() + np.array([1, 2, 3, 4], "<f4").tobytes()
    df = spark.createDataFrame([("a.flo", bytearray(good)), ("b.flo", bytearray(b"no"))], "path string, content binary")
    got = {r["path"]: (r["width"], r["height"], r["mean_x"], r["error"]) for r in arrays.decode_flows(df).collect()}
    assert got == {"a.flo": (2, 1, 2.0, None), "b.flo": (None, None, None, "not a flow file")}
    assert arrays.packed_depth(np.array([[[255, 255, 255]]])) == pytest.approx(1000.0)
    assert arrays.thumb_statistics(np.zeros((4, 4)))["letterbox"] == 1.0


def test_frame_pacing_of_constant_costs(spark):
    costs = spark.range(100).select(F.lit("r").alias("run"), F.col("id").alias("frame"), F.lit(33.3).alias("render_ms"))
    got = {r["mode"]: r for r in sequence.frame_pacing(costs, 0.0, 48.1, 4.0).collect()}
    assert got["native"]["displayed_fps"] == pytest.approx(1000 / 33.3)
    assert got["interp"]["displayed_fps"] == pytest.approx(2000 / 81.4)
    assert got["interp"]["game_latency_ms"] == pytest.approx(4 + 33.3 + 48.1 + 1 + 40.7)


def test_low_discrepancy(spark):
    got = [r["x"] for r in spark.range(1, 6).select(sampling.radical_inverse(F.col("id"), 2).alias("x")).orderBy("id").collect()]
    assert got == [0.5, 0.25, 0.75, 0.125, 0.625]


def test_catalogue(spark):
    paths = ["s/a/im1.png", "s/a/im10.png", "s/a/im2.png", "s/b/im1.png", "s/lr4/im1.png", "s/t/im1.png", "s/t/im2.png", "s/t/im3.png"]
    files = spark.createDataFrame([(p, "src") for p in paths], "path string, source string")
    items = catalogue.catalogue(files, "source", "seq", ["t"]).collect()
    assert {(tuple(r["frames"]), r["role"]) for r in items} == {(("s/a/im1.png", "s/a/im2.png", "s/a/im10.png"), "train"), (("s/t/im1.png", "s/t/im2.png", "s/t/im3.png"), "test")}
    assert catalogue.catalogue(files, "source", "still").count() == 7


def test_neighbours_by_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    g = rng.integers(0, 5, 60)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(60), "v": list(v.tolist()), "g": g}))
    got = {(r["query"], r["rank"]): r["ref"] for r in joins.neighbours(df, df, "k", "v", 4, "g").collect()}
    sims = v.astype(float) @ v.T.astype(float)
    sims[g[:, None] == g[None, :]] = -np.inf
    for q in range(60):
        assert [got[q, i + 1] for i in range(4)] == np.argsort(-sims[q], kind="stable")[:4].tolist()
    pairs = {(r["a"], r["b"]) for r in joins.pairs_above(df, "k", "v", 4.0).collect()}
    full = v.astype(float) @ v.T.astype(float)
    assert pairs == {(i, j) for i in range(60) for j in range(i + 1, 60) if full[i, j] >= 4.0}
    empty = df.where("false")
    assert joins.neighbours(empty, df, "k", "v", 4, "g").count() == 0 and joins.pairs_above(empty, "k", "v", 0.0).count() == 0
