"""Running aggregates of groups of any size against a loop."""

import numpy as np
from pyspark.sql import functions as F

from siltworks.operators import prefix, rules, sequence, window


def test_grouped_running_by_a_loop(spark):
    rng = np.random.default_rng(2)
    groups = ["hot"] * 900 + ["b", None, "c"] * 60 + ["one"]
    rows = [(g, i, None if rng.random() < 0.2 else float(rng.integers(-50, 50))) for i, g in enumerate(groups)]
    df = spark.createDataFrame(rows, "g string, i long, x double").repartition(7)
    out = prefix.grouped_running(df, ["g"], [F.col("i")], {"n": F.lit(1), "s": F.col("x")}, {"m": F.col("x")}, {"b": F.col("x")}).collect()
    assert len(out) == len(rows)
    state = {}
    got = {r["i"]: (r["n"], r["s"], r["m"], r["b"]) for r in out}
    for g, i, x in rows:
        n, s, m = state.get(g, (0, 0.0, None))
        after = (n + 1, s + (x or 0.0), m if x is None else x if m is None else max(m, x))
        assert got[i] == (*after, m)
        state[g] = after
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = prefix.grouped_running(df, ["g"], [F.col("i")], {"n": F.lit(1)}).where("g = 'hot'").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 1  # the group that owns most rows is not one task's
    assert prefix.grouped_running(df.where("false"), ["g"], [F.col("i")], {"n": F.lit(1)}).count() == 0


def test_a_hot_user_keeps_its_results(spark):
    rng = np.random.default_rng(3)
    rows = [(1 if i % 3 else int(rng.integers(2, 9)), i, float(rng.integers(0, 100)), rng.random() < 0.1) for i in range(2000)]
    df = spark.createDataFrame(rows, "u long, i long, x double, r boolean")
    segments, best, run, stops = {}, {}, {}, {}
    want = {}
    for u, i, x, r in rows:
        segments[u] = segments.get(u, 0) + int(r)
        improved = u not in best or x > best[u]
        best[u] = max(best.get(u, x), x)
        run[u] = run.get(u, 0) + 1 if x > 60 else 0
        if run[u] >= 3:
            stops.setdefault(u, i)
        want[i] = (segments[u], best[u], improved)
    got = {r["i"]: r["segment"] for r in sequence.reset_segments(df, ["u"], "i", F.col("r")).collect()}
    assert got == {i: s for i, (s, _, _) in want.items()}
    got = {r["i"]: (r["best"], r["improved"]) for r in window.running_best(df, ["u"], "x", "i").collect()}
    assert got == {i: w[1:] for i, w in want.items()}
    loss = F.when(F.col("x") > 60, float("nan")).otherwise(F.col("x"))
    assert {r["u"]: r["stopped_at"] for r in sequence.diverged(df, "u", "i", loss, 3).collect()} == stops
    facts = df.select("u", "i", F.when(F.col("i") % 2 == 0, "t").otherwise("b").alias("m"), F.floor(F.col("x") / 25).alias("x"))
    gates = {(r["u"], r["sid"]): r["gated"] for r in rules.post_hoc_gate(facts, ["u"], "m", "t", "b", "x", "i").collect()}
    lines = {}
    for u, i, x, _ in rows:
        lines.setdefault((u, "t" if i % 2 == 0 else "b"), []).append(x // 25)
    assert gates == {(u, k): t == b for u in {u for u, _ in lines} for k, (t, b) in enumerate(zip(lines.get((u, "t"), []), lines.get((u, "b"), [])))}


def test_quantiles_at_points_of_groups(spark):
    rows = [(g, float(x)) for g in ("a", "b") for x in range(11)]
    df = spark.createDataFrame(rows, "g string, x double")
    point = F.when(F.col("g") == "a", 0.25).otherwise(0.9)
    assert {r["g"]: r["q"] for r in prefix.group_quantiles(df, ["g"], "x", point, "q").collect()} == {"a": 2.5, "b": 9.0}
