"""Sequential and stateful operators over ordered rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.operators.prefix import group_quantiles, grouped_running, with_running
from siltworks.operators.recurrence import blended_frames
from siltworks.operators.skew import attach_by_key
from siltworks.scratch import scratch_table
from siltworks.ship import ship_code

MODES = ("native", "interp", "extrap", "extrap_late")


def last_ema(df: DataFrame, key: str, order: str, value: str, decay: float) -> DataFrame:
    """``key, last``: the last running average of each key's values in order; step n decays by the lesser of ``decay``
    and (1 + n) / (10 + n).

    The average is linear in the values. What a value weighs at the end follows from its place and the length of its
    history alone, as the growing decays telescope; so a history of any length is ranked over range partitions and
    summed in parts. Null values are no steps; null keys are a key.
    """
    warm = max(1, math.floor((10 * decay - 1) / (1 - decay) + 1e-9)) if decay < 1 else 1 << 60
    rows = df.where(F.col(value).isNotNull()).select(F.col(key), F.col(order), F.col(value).cast("double").alias("x"))
    rows = rows.withColumn("none", F.col(key).isNull()).withColumn("key", F.struct("none", F.col(key).alias("k")))
    ranked = scratch_table(with_running(rows, [F.asc("key"), F.asc(order)], {}, "at"), "history-ranks")
    starts = scratch_table(ranked.groupBy("key").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("length")), "history-starts")
    placed = attach_by_key(ranked, starts, "key", "length", max(1, ranked.count()))
    at = (F.col("at") - F.col("start") + 1).cast("double")

    def passed(n: Column) -> Column:
        """Logarithm of all decays of steps 2 to n."""
        upto = F.least(n, F.lit(float(warm)))
        grown = sum((math.log(1 + i) - F.log(upto + i) for i in range(2, 11)), F.lit(0.0))
        return grown + F.greatest(n - float(warm), F.lit(0.0)) * math.log(decay)

    share = F.when(at == 1, 1.0).otherwise(1 - F.least(F.lit(decay), (1.0 + at) / (10.0 + at)))
    weight = share * F.exp(passed(F.col("length").cast("double")) - passed(at))
    return placed.groupBy("key").agg(F.sum(F.col("x") * weight).alias("last")).select(F.col("key.k").alias(key), "last")


def recurrent(df: DataFrame, key: str, order: str, value: str, step: Callable[[float | None, float], float], out: str) -> DataFrame:
    """``key, order, out``: a state that each row of a key, in order, makes of the last one (None at first) and its value.

    For recurrences that are no sums. Rows are sorted in their partitions and streamed through Python batch by batch: a
    task holds one batch and one state, whatever the length of a history, but a history is one task's work.
    """
    ship_code(df.sparkSession)
    rows = df.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(value).cast("double").alias("x"))
    rows = rows.repartition("k").sortWithinPartitions("k", "o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            found = []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != last:
                    last, state = k, None
                state = state if x is None else step(state, x)
                found.append(state)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["k", "o", "s"])

    schema = T.StructType([rows.schema["k"], rows.schema["o"], T.StructField("s", T.DoubleType())])
    return rows.mapInArrow(run, schema).select(F.col("k").alias(key), F.col("o").alias(order), F.col("s").alias(out))


def blended(df: DataFrame, key: str, order: str, value: str, low: float, high: float, alpha: float) -> DataFrame:
    """``key, order, blended``: exponential blend of each value with the history, which is clamped before each step.

    Frames of one pixel: see ``blended_frames``. A history of any length is the work of all tasks.
    """
    one = F.when(F.col(value).isNotNull(), F.array(F.col(value).cast("double")))
    out = blended_frames(df.select(key, order, one.alias("__x")), key, order, "__x", alpha, low, high)
    return out.select(key, order, F.get("state", F.lit(0)).alias("blended"))


def reset_segments(df: DataFrame, keys: Sequence[str], order: str, reset: Column) -> DataFrame:
    """Rows with ``segment``: how many resets have come, this row included. A sequence may be of any length."""
    return grouped_running(df, list(keys), [F.col(order)], {"segment": F.when(reset, 1).otherwise(0).cast("long")})


def diverged(df: DataFrame, run: str, step: str, value: Column, patience: int) -> DataFrame:
    """The first step of each run at which the value had not been finite for ``patience`` checks in a row.

    How many checks have gone by is counted, and the count at the last finite one carried on; a run may be of any length.
    """
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    marked = df.select(run, step, bad.alias("bad"))
    counted = grouped_running(marked, [run], [F.col(step)], {"at": F.lit(1).cast("long")})
    counted = grouped_running(counted, [run], [F.col(step)], maxima={"good_at": F.when(~F.col("bad"), F.col("at"))})
    late = counted.where(F.col("bad") & (F.col("at") - F.coalesce("good_at", F.lit(0)) >= patience))
    return late.groupBy(run).agg(F.min(step).alias("stopped_at"))


def rate_at(progress: Column, base: float, warmup: float, floor: float) -> Column:
    """Learning rate: linear warm-up, then half a cosine down to ``floor`` times the base."""
    along = (progress - warmup) / (1 - warmup)
    cosine = floor + (1 - floor) * 0.5 * (1 + F.cos(F.pi() * F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))))
    return F.when(progress < warmup, F.lit(base) * progress / warmup).otherwise(F.lit(base) * cosine)


def frame_pacing(costs: DataFrame, sr_ms: float, fg_ms: float, cpu_ms: float, present_ms: float = 1.0) -> DataFrame:
    """Latency statistics of a just-in-time game loop for each ``run`` and mode, given frame costs ``run, frame, render_ms``.

    A frame's period is the slower of CPU and GPU; its input is sampled when the last period ends. Generated frames
    come before the real one (``interp``, which holds it for half a period) or after it (``extrap``, whose camera
    may be sampled late). Statistics are means and 95th percentiles; the first tenth of the shown frames does
    not count for the frame rate. Frames of one number are in order of their cost.

    What follows a frame's input depends on its cost alone, so latencies are those of the distinct costs, counted. Frames are
    put in order once, over range partitions, so a run of any length is not one task's.
    """
    keys = ["run", "mode"]
    costs = costs.where("run IS NOT NULL").select("run", "frame", "render_ms")
    values = scratch_table(costs.groupBy("run", "render_ms").agg(F.count(F.lit(1)).alias("n")), "cost-counts")
    values = values.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in MODES])))
    real, made = _shown_after(F.col("mode"), sr_ms, fg_ms, cpu_ms, present_ms)
    # Nine decimals keep equal latencies of different sums equal.
    values = values.withColumns({"real": F.round(real, 9), "made": F.round(made, 9)})
    late = F.when(F.col("mode") == "extrap_late", F.lit(fg_ms + present_ms)).otherwise(F.col("made"))
    camera = F.when(F.col("mode") == "native", F.array("real")).when(F.col("mode") == "interp", F.array("made")).otherwise(F.array(F.col("real"), late))
    game = values.select(*keys, "n", F.col("real").alias("x"))
    seen = values.select(*keys, "n", F.explode(camera).alias("x"))
    shown = values.select(*keys, "n", F.explode(F.array("real", "made")).alias("x"))
    mean = lambda rows, name: rows.groupBy(*keys).agg((F.sum(F.col("x") * F.col("n")) / F.sum(F.when(F.col("x").isNotNull(), F.col("n")))).alias(name))
    out = [
        mean(game, "game_latency_ms"), group_quantiles(game, keys, "x", 0.95, "game_latency_p95_ms", times="n"), mean(seen, "camera_latency_ms"),
        group_quantiles(seen, keys, "x", 0.95, "camera_latency_p95_ms", times="n"), mean(shown, "content_age_ms"),
        _shown_gaps(costs, sr_ms, fg_ms, cpu_ms, present_ms),
    ]
    return reduce(lambda a, b: a.join(b, keys), out)


def _shown_after(mode: Column, sr_ms: float, fg_ms: float, cpu_ms: float, present_ms: float) -> tuple[Column, Column]:
    """How long after its input the real and the generated frame (null for ``native``) of a cost are shown."""
    ready = F.lit(cpu_ms) + F.col("render_ms") + sr_ms
    half = F.greatest(F.lit(cpu_ms), F.col("render_ms") + sr_ms + fg_ms) / 2
    real = F.when(mode == "interp", ready + fg_ms + present_ms + half).otherwise(ready + present_ms)
    made = F.when(mode == "interp", ready + fg_ms + present_ms).when(mode != "native", ready + present_ms + half)
    return real, made


def _shown_gaps(costs: DataFrame, sr_ms: float, fg_ms: float, cpu_ms: float, present_ms: float) -> DataFrame:
    """``run, mode, displayed_fps, frame_gap_cv`` of the times between shown frames.

    A gap is a matter of two neighbouring costs as long as frames are shown in their order: the modes that generate frames have the
    same gaps then. A frame much cheaper than the one before can be shown before that one's generated frame; where
    there is one, or a cost that is no number, all shown frames are ordered by their times.
    """
    r, last = F.col("render_ms"), F.col("last.render_ms")
    period = lambda cost, extra: F.greatest(F.lit(cpu_ms), cost + sr_ms + extra)
    native, first, second = period(last, 0.0) + r - last, period(last, fg_ms) / 2 + r - last, period(r, fg_ms) / 2
    ranked = with_running(costs, [F.col("run"), F.col("frame"), r], lags={"last": F.struct("run", "render_ms")})
    follows = F.coalesce(F.col("last.run") == F.col("run"), F.lit(False))
    ordered = (F.abs(r) < float("inf")) & (second >= 0) & (~follows | ((native >= 0) & (first >= 0)))
    spans = ranked.groupBy("run").agg(
        F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"), F.min(F.coalesce(ordered, F.lit(False))).alias("ordered")
    )
    spans = scratch_table(spans, "runs")
    if spans.where("NOT ordered").limit(1).count():
        return _gaps_by_time(costs, sr_ms, fg_ms, cpu_ms, present_ms)
    placed = ranked.join(F.broadcast(spans), "run").withColumn("at", F.col("rank") - F.col("first"))  # a row a run
    drop = lambda shown: F.floor(F.col("n") * shown / 10)
    gap = lambda generated, value, at, shown: F.struct(F.lit(generated).alias("generated"), F.when(at > drop(shown), value).alias("gap"))
    gaps = placed.select("run", F.inline(F.array(
        gap(False, native, F.col("at"), 1), gap(True, first, 2 * F.col("at"), 2), gap(True, second, 2 * F.col("at") + 1, 2)
    ))).where("gap IS NOT NULL")
    paced = gaps.groupBy("run", "generated").agg(*_pace())
    modes = F.when(F.col("generated"), F.array(*[F.lit(m) for m in MODES[1:]])).otherwise(F.array(F.lit(MODES[0])))
    return paced.select("run", F.explode(modes).alias("mode"), "displayed_fps", "frame_gap_cv")


def _pace() -> list[Column]:
    return [(F.lit(1000.0) / F.avg("gap")).alias("displayed_fps"), (F.stddev_pop("gap") / F.avg("gap")).alias("frame_gap_cv")]


def _gaps_by_time(costs: DataFrame, sr_ms: float, fg_ms: float, cpu_ms: float, present_ms: float) -> DataFrame:
    """``_shown_gaps`` for frames shown in any order: all of all modes are ordered by their times."""
    keys = ["run", "mode"]
    rows = costs.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in MODES])))
    gpu = F.col("render_ms") + sr_ms + F.when(F.col("mode") == "native", 0.0).otherwise(fg_ms)
    rows = rows.withColumn("period", F.greatest(F.lit(cpu_ms), gpu))
    rows = scratch_table(with_running(rows, [F.col("run"), F.col("mode"), F.col("frame"), F.col("render_ms")], {"upto": F.col("period")}), "frame-periods")
    starts = rows.groupBy(*keys).agg(F.min(F.col("upto") - F.col("period")).alias("start"))
    rows = rows.join(F.broadcast(starts), keys).withColumn("t", F.col("upto") - F.col("period") - F.col("start"))  # a row a run and mode
    after = F.array_compact(F.array(*_shown_after(F.col("mode"), sr_ms, fg_ms, cpu_ms, present_ms)))
    frames = rows.select(*keys, "t", F.explode(after).alias("after")).select(*keys, (F.col("t") + F.col("after")).alias("at"))
    ranked = with_running(frames, [F.col("run"), F.col("mode"), F.col("at")], lags={"last": F.col("at")})
    spans = scratch_table(ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first")), "frame-ages")
    counted = ranked.join(F.broadcast(spans), keys).where(F.col("rank") - F.col("first") > F.floor(F.col("n") / 10))  # a row a run and mode
    return counted.withColumn("gap", F.col("at") - F.col("last")).groupBy(*keys).agg(*_pace())


def stage_times(log: DataFrame, line: str = "value") -> DataFrame:
    """``stage, start, done, minutes`` from ``HH:MM:SS | stage: started`` and ``... | stage: done`` lines.

    A stage that ends before it starts ended after midnight.
    """
    found = log.select(
        F.regexp_extract(line, r"^(\d{2}:\d{2}:\d{2}) \| (.*): (started|done)$", 1).alias("clock"),
        F.regexp_extract(line, r"^(\d{2}:\d{2}:\d{2}) \| (.*): (started|done)$", 2).alias("stage"),
        F.regexp_extract(line, r"^(\d{2}:\d{2}:\d{2}) \| (.*): (started|done)$", 3).alias("event"),
    ).where("clock <> ''")
    seconds = F.substring("clock", 1, 2).cast("int") * 3600 + F.substring("clock", 4, 2).cast("int") * 60 + F.substring("clock", 7, 2).cast("int")
    per = found.groupBy("stage").agg(
        F.min(F.when(F.col("event") == "started", seconds)).alias("start"), F.max(F.when(F.col("event") == "done", seconds)).alias("done")
    )
    took = F.col("done") - F.col("start")
    return per.withColumn("minutes", F.when(took < 0, took + 86_400).otherwise(took) / 60.0)
