"""States over frames against a serial loop."""

import numpy as np
import pytest

from siltworks.operators import recurrence, sequence

SCHEMA = "k string, o long, x array<double>, lo array<double>, hi array<double>, m array<double>"


def _serial(rows, alpha, low, high, width):
    out, last, state = [], object(), None
    for k, o, x, lo, hi, m in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        state = None if k != last else state
        last = k
        if x is not None:
            if state is None:
                state = np.array(x)
            else:
                n, moved = len(x), np.empty(len(x))
                for i in range(n):
                    dx, dy = (0, 0) if m is None else (int(np.rint(m[2 * i])), int(np.rint(m[2 * i + 1])))
                    y = min(max(i // width + dy, 0), n // width - 1)
                    moved[i] = state[y * width + min(max(i % width + dx, 0), width - 1)]
                moved = np.clip(moved, low if lo is None else lo, high if hi is None else hi)
                state = (1 - alpha) * moved + alpha * np.array(x)
        out.append((k, o, None if state is None else np.round(state, 9).tolist()))
    return out


@pytest.mark.parametrize("stretch", [3, 7, 4096])
def test_frames_by_a_serial_loop(spark, stretch):
    rng = np.random.default_rng(stretch)
    rows = []
    for k, n in (("a", 40), ("b", 1), (None, 17), ("c", 0), ("d", 5)):
        for o in range(n):
            x = None if rng.random() < 0.2 or (k == "d") or (k == "a" and o < 8) else rng.normal(size=12).tolist()
            bound = rng.random() < 0.5
            lo, hi = (rng.uniform(-1, 0, 12).tolist(), rng.uniform(0, 1, 12).tolist()) if bound else (None, None)
            rows.append((k, o, x, lo, hi, rng.normal(0, 1.5, 24).tolist() if rng.random() < 0.7 else None))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = recurrence.blended_frames(df, "k", "o", "x", 0.3, -2.0, 2.0, "lo", "hi", "m", 4, stretch).collect()
    got = [(r["k"], r["o"], None if r["state"] is None else np.round(r["state"], 9).tolist()) for r in out]
    key = lambda r: (r[0] is not None, r[0] or "", r[1])
    want = _serial(rows, 0.3, -2.0, 2.0, 4)
    for (k, o, s), (kk, oo, t) in zip(sorted(got, key=key), want, strict=True):
        assert (k, o) == (kk, oo) and (s == t if s is None or t is None else s == pytest.approx(t, abs=1e-8))
    assert recurrence.blended_frames(df.where("false"), "k", "o", "x", 0.3).count() == 0


def test_steps_compose():
    rng = np.random.default_rng(1)
    step = lambda: recurrence.Steps.one(rng.normal(size=6), rng.uniform(-1, 0, 6), rng.uniform(0, 1, 6), 0.4, rng.integers(0, 6, 6))
    many, state = [step() for _ in range(30)], rng.normal(size=6) * 3
    whole = many[0]
    for s in many[1:]:
        whole = whole.then(s)
    serial = state
    for s in many:
        serial = s.of(serial)
    assert whole.of(state) == pytest.approx(serial, abs=1e-12)
    assert recurrence.Steps.unpacked(whole.packed()).of(state) == pytest.approx(serial, abs=1e-12)


def test_a_long_history_is_no_single_task(spark):
    """Of one history of 20,000 values every task of the last stage has a share, and the result is the loop's."""
    df = spark.range(20_000).selectExpr("1L AS k", "id AS o", "pmod(id * 7919, 1009) / 10.0 AS x")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a small table would be one task again
    try:
        out = recurrence.blended_frames(df.selectExpr("k", "o", "array(x) AS x"), "k", "o", "x", 0.3, 20.0, 80.0, stretch=500)
        parts = out.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 4 and max(r["count"] for r in parts) < 10_000
    out = sequence.blended(df, "k", "o", "x", 20.0, 80.0, 0.3)
    h = None
    for i in range(20_000):
        x = (i * 7919 % 1009) / 10.0
        h = x if h is None else min(max(h, 20.0), 80.0) * 0.7 + x * 0.3
    assert out.where("o = 19999").first()["blended"] == pytest.approx(h)
