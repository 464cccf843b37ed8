"""Operators that must not lean on one task: skewed keys, graphs, global order, streams."""

import random

from pyspark.sql import functions as F

from siltworks.operators.graph import component_stars
from siltworks.operators.joins import expand_copies, hamming_join
from siltworks.operators.prefix import with_running
from siltworks.operators.skew import attach_by_key
from siltworks.scratch import scratch_table
from siltworks.streaming.protocol import parse_lines, rounds, stream_lines
from siltworks.streaming.replay import drain, event_stream, windowed_counts


def roots_by_union(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up if find(x) != x}


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(700)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    df = spark.createDataFrame([(max(e), min(e)) if i % 2 else e for i, e in enumerate(edges)] + [(None, 5), (7, 7)], "a long, b long")
    got = {r["vertex"]: r["root"] for r in component_stars(df).collect()}
    assert got == roots_by_union([e for e in edges if e[0] != e[1]])


def test_components_of_nothing(spark):
    assert component_stars(spark.createDataFrame([], "a long, b long")).count() == 0


def test_attach_by_key_keeps_every_row(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(2000)] + [(f"k{i}", i) for i in range(50)] + [(None, -1)], "k string, i long")
    facts = spark.createDataFrame([("hot", 2000, 1.0)] + [(f"k{i}", 1, 2.0) for i in range(0, 50, 2)], "k string, n long, x double")
    out = attach_by_key(rows, facts, "k", "n", 2051)
    assert out.count() == 2051
    assert out.groupBy("x").count().orderBy("x").collect() == [(None, 26), (1.0, 2000), (2.0, 25)]


def test_running_order_across_partitions(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("k"), F.col("id").alias("v"))
    out = with_running(df.repartition(7), [F.col("k")], {"total": F.lit(2)})
    assert {r["k"]: (r["rank"], r["total"]) for r in out.collect()} == {k: (k + 1, 2 * (k + 1)) for k in range(1000)}
    assert with_running(df.where("false"), [F.col("k")]).count() == 0


def test_hamming_join_by_brute_force(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(30)]
    hashes = base + [h ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for h in base] + base[:5] * 3
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hashes)] + [(999, None)], "k long, x long")
    want = {(i, j) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if bin(hashes[i] ^ hashes[j]).count("1") <= 4}
    edges = hamming_join(df, "k", "x", 4)
    got = {(r["a"], r["b"]) for r in expand_copies(edges, df, "k", "x").collect()}
    assert got == want


def test_scratch_rows_are_fixed(spark):
    once = scratch_table(spark.range(100).select(F.rand().alias("x")), "fixed")
    assert once.agg(F.sum("x")).first() == once.agg(F.sum("x")).first()


def test_protocol_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text('ROUND {"round": 1, "score": 0.5}\nROUND {bad\nPROGRESS {"x": 1}\nhello world\n\n')
    (tmp_path / "in" / "b.log").write_text('ROUND {"round": 2, "score": 0.7, "step": 10}\nDONE {}\n')
    parsed = parse_lines(stream_lines(spark, str(tmp_path / "in")))
    got = drain(rounds(parsed), "protocol_rounds", str(tmp_path / "cp"), "append")
    assert sorted((r["round"], r["score"], r["step"]) for r in got.collect()) == [(1, 0.5, None), (2, 0.7, 10)]


def test_event_stream_equals_batch(spark, sf_dir, tmp_path):
    import shutil

    (tmp_path / "ev").mkdir()
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "ev" / "e.parquet")
    live = drain(windowed_counts(event_stream(spark, str(tmp_path / "ev"))), "event_counts", str(tmp_path / "cp2"))
    batch = windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect()))
