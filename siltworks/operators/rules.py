"""Rules: quality reasons, the duplicate rule, calibration, adaptive radius, gates and clip defects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.numbers import clamp, known
from siltworks.operators.prefix import group_quantiles, grouped_running
from siltworks.scratch import scratch_table

#: Limits of the quality filter.
FILTER = {"min_side": 256, "min_std": 8.0, "max_letterbox": 0.35, "min_sharpness_still": 20.0, "min_sharpness_seq": 5.0}


def quality_reasons(frames: DataFrame, limits: Mapping[str, float] = FILTER) -> DataFrame:
    """``item, reasons, keep`` from key frames ``item, kind, ok, width, height, std, letterbox, sharpness``.

    A frame that failed to decode is the only reason given. Otherwise the least side of any frame and the medians
    of the others are compared; limits are strict.
    """
    per = frames.groupBy("item").agg(
        F.bool_and("ok").alias("ok"),
        F.min(F.least("width", "height")).alias("side"),
        *[F.median(known(F.col(c).cast("double"))).alias(c) for c in ("std", "letterbox", "sharpness")],
        F.first("kind").alias("kind"),
    )
    sharp = F.when(F.col("kind") == "still", limits["min_sharpness_still"]).otherwise(limits["min_sharpness_seq"])
    found = F.array_compact(
        F.array(
            F.when(F.col("side") < limits["min_side"], "too_small"),
            F.when(F.col("std") < limits["min_std"], "flat"),
            F.when(F.col("letterbox") > limits["max_letterbox"], "letterbox"),
            F.when(F.col("sharpness") < sharp, "blurry"),
        )
    )
    reasons = F.when(F.col("ok"), found).otherwise(F.array(F.lit("decode_error")))
    return per.select("item", reasons.alias("reasons"), (F.size(reasons) == 0).alias("keep"))


def items_kept(items: DataFrame, reasons: DataFrame) -> DataFrame:
    """Items with ``keep`` and ``reasons``; an item without key frames is not kept and has no reasons."""
    out = items.join(reasons, "item", "left")
    return out.withColumn("keep", F.coalesce("keep", F.lit(False)))


def edge_rule(cos: Column, ham: Column, dham: Column, cells: Column, textured: Column, limits: Mapping[str, float]) -> Column:
    """Which rule makes a pair a duplicate: verified, strong_embedding, exact_hash or none (empty).

    Without ``t_strong`` embeddings do not count; an unknown cosine counts as -1.
    """
    exact = textured & (ham <= limits["h_exact"]) & (dham <= 2 * limits["h_exact"] + 4)
    rule = F.when(cells >= limits["t_cells"], "verified")
    if "t_strong" in limits:
        rule = rule.when(F.coalesce(known(cos.cast("double")), F.lit(-1.0)) >= limits["t_strong"], "strong_embedding")
    return rule.when(exact, "exact_hash").otherwise("")


def calibrate(scores: DataFrame, retrieval_recall: float = 0.98) -> DataFrame:
    """One row of thresholds from ``label, kind, cosine, hamming, cells`` scores of copies and negatives.

    Kinds of copies are ``light`` and ``heavy``, of negatives ``random`` and ``hard``.
    """
    random, hard = "label = 0 AND kind <> 'hard'", "label = 0 AND kind = 'hard'"
    wanted = {
        "low_cosine": ("cosine", "label = 1", 1 - retrieval_recall), "light_hamming": ("hamming", "label = 1 AND kind = 'light'", 0.95),
        "worst_cosine": ("cosine", random, 0.999), "worst_cells": ("cells", random, 0.999), "worst_hamming": ("hamming", random, 0.001),
    }
    # All quantiles from one order of (name, value); they are five rows.
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.when(F.expr(when), F.col(c).cast("double")).alias("x")) for n, (c, when, _) in wanted.items()]))
    values = scores.select(values.alias("v")).select("v.*").where("x IS NOT NULL")
    point = F.coalesce(*[F.when(F.col("name") == n, F.lit(float(p))) for n, (_, _, p) in wanted.items()])
    row = group_quantiles(values, ["name"], "x", point, "q").groupBy().agg(*[F.max(F.when(F.col("name") == n, F.col("q"))).alias(n) for n in wanted])
    extreme = lambda take, c: take(F.when(F.expr(hard), F.col(c).cast("double")))
    ends = scores.agg(extreme(F.max, "cosine").alias("__cosine"), extreme(F.max, "cells").alias("__cells"), extreme(F.min, "hamming").alias("__hamming"))
    row = row.join(F.broadcast(ends))  # single rows
    row = row.withColumns({f"worst_{c}": pick(f"worst_{c}", f"__{c}") for c, pick in (("cosine", F.greatest), ("cells", F.greatest), ("hamming", F.least))})
    row = row.select(
        clamp(F.col("low_cosine"), 0.5, 0.9).alias("t_ret"),
        clamp(F.col("worst_cosine") + 0.03, 0.92, 0.995).alias("t_strong"),
        F.floor(clamp(F.col("worst_cells") + 2, 10.0, 40.0)).cast("int").alias("t_cells"),
        F.floor(clamp(F.col("worst_hamming") - 4, 0.0, 6.0)).cast("int").alias("h_exact"),
        "light_hamming",
    )
    cand = F.least(F.greatest(F.col("light_hamming"), F.col("h_exact").cast("double")), F.lit(12.0))
    return row.withColumn("h_cand", F.floor(cand).cast("int")).drop("light_hamming")


def adaptive_radius(pairs: DataFrame, n_items: int, h_exact: int, h_cand: int, per_item: int = 20) -> int:
    """The largest radius up to ``h_cand`` with at most ``per_item * n_items`` pairs, but ``h_exact`` at least.

    Pairs are counted by distance once; that gives what searches with falling radii would find. A row of ``pairs`` is a pair,
    or as many as its column ``n`` says.
    """
    many = F.sum("n") if "n" in pairs.columns else F.count(F.lit(1))
    counts = {r["hamming"]: r["n"] or 0 for r in pairs.groupBy("hamming").agg(many.alias("n")).collect()}  # 65 rows at most
    radius = h_cand
    while radius > h_exact and sum(n for h, n in counts.items() if h <= radius) > per_item * n_items:
        radius -= 1
    return radius


def gate_threshold(df: DataFrame, score: str, label: str, key: str, point: float = 0.99) -> DataFrame:
    """``threshold`` at an index quantile of the negatives and the share of positives above it; 1.0 without negatives."""
    from siltworks.operators.aggregate import index_quantile

    low = index_quantile(df.where(F.col(label) < 0.5), score, key, point).agg(F.max("value").alias("value"))
    low = low.select(F.coalesce("value", F.lit(1.0)).alias("threshold"))
    hits = df.where(F.col(label) > 0.5).join(F.broadcast(low)).agg(F.avg((F.col(score) > F.col("threshold")).cast("double")).alias("rate"))
    return low.join(F.broadcast(hits))


def gate(available: Column, score: Column, plain: Column, threshold: float, plain_threshold: float) -> Column:
    """A row's gate by the score that it has: with motion where available, else the plain one."""
    return F.when(available > 0.5, score > threshold).otherwise(plain > plain_threshold)


def post_hoc_gate(facts: DataFrame, keys: Sequence[str], method: str, tested: str, baseline: str, metric: str, order: str) -> DataFrame:
    """Samples of ``tested`` that equal the baseline exactly are gated: ``keys, sid, gated`` for each.

    Samples are numbered by ``order`` inside keys and method, however many there are; equality of floats is intended.
    """
    counted = grouped_running(facts, [*keys, method], [F.col(order)], {"sid": F.lit(1).cast("long")})
    rows = scratch_table(counted.withColumn("sid", F.col("sid") - 1), "numbered-samples")
    left = rows.where(F.col(method) == tested).select(*keys, "sid", F.col(metric).alias("x"))
    right = rows.where(F.col(method) == baseline).select(*keys, "sid", F.col(metric).alias("y"))
    return left.join(right, [*keys, "sid"]).select(*keys, "sid", (F.col("x") == F.col("y")).alias("gated"))


def clip_defects(frames: DataFrame, min_std: float = 2.0, min_change: float = 0.1, max_hist: float = 0.5) -> DataFrame:
    """``clip, defects`` from ``clip, t, std, change, hist_change`` rows: blank, frozen and cut, as a sorted set.

    ``change`` and ``hist_change`` compare a frame with the one before and are null for the first.
    """
    per = frames.groupBy("clip").agg(
        F.bool_or(F.col("std") < min_std).alias("blank"),
        F.coalesce(F.bool_or(F.col("change") < min_change), F.lit(False)).alias("frozen"),
        F.coalesce(F.bool_or(F.col("hist_change") > max_hist), F.lit(False)).alias("cut"),
    )
    names = F.array_compact(F.array(*[F.when(F.col(c), c) for c in ("blank", "cut", "frozen")]))
    return per.select("clip", names.alias("defects"))


def select_clips(clips: DataFrame, n: int, position: str, reject: Sequence[str]) -> DataFrame:
    """The first ``n`` clips in order without a rejected defect, of the first ``4 * n``."""
    tried = clips.orderBy(position).limit(4 * n)
    good = tried.where(~F.arrays_overlap("defects", F.array(*[F.lit(x) for x in reject])))
    return good.orderBy(position).limit(n)
