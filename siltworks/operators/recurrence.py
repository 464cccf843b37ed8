"""States that follow each other frame by frame, over histories of any length and without a task a history.

A frame's state is made of the last one: each pixel takes the last state's value at some place (where motion says it came
from), clamps it to bounds of its own, and blends the new value in. Such a step, for one pixel, is
``clamp(slope * last[place] + shift, low, high)``, and two of them after each other are one of the same kind. So a stretch
of frames of any length is five arrays, stretches are summed up at the same time, and only their sums, one a stretch, follow each
other in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.operators.prefix import with_running
from siltworks.scratch import scratch_table
from siltworks.ship import ship_code

#: Frames in a stretch: what one task holds, and how many times fewer rows follow each other in order.
STRETCH = 4_096


@dataclass
class Steps:
    """Some steps as one, for all pixels: ``clamp(slope * last[place] + shift, low, high)``."""

    place: np.ndarray
    slope: np.ndarray
    shift: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def one(cls, value: np.ndarray, low: np.ndarray, high: np.ndarray, alpha: float, place: np.ndarray) -> Steps:
        new, keep = alpha * value, 1 - alpha
        return cls(place, np.full(len(value), keep), new, keep * low + new, keep * high + new)

    def then(self, after: Steps) -> Steps:
        at, k = after.place, after.slope
        bound = lambda b: np.clip(k * b[at] + after.shift, after.low, after.high)
        return Steps(self.place[at], k * self.slope[at], k * self.shift[at] + after.shift, bound(self.low), bound(self.high))

    def of(self, state: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * state[self.place] + self.shift, self.low, self.high)

    def packed(self) -> bytes:
        return np.concatenate([self.place.astype(float), self.slope, self.shift, self.low, self.high]).tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> Steps:
        place, *rest = np.frombuffer(data).reshape(5, -1)
        return cls(place.astype(int), *rest)


def places(motion: np.ndarray | None, n: int, width: int) -> np.ndarray:
    """Where each pixel was in the last frame: its place plus motion (x, y, ...) in whole pixels, kept inside the frame."""
    at = np.arange(n)
    if motion is None:
        return at
    step = np.rint(motion.reshape(-1, 2)).astype(int)
    y, x = np.divmod(at, width)
    return np.clip(y + step[:, 1], 0, n // width - 1) * width + np.clip(x + step[:, 0], 0, width - 1)


def _frames(rows: pa.Table, width: int, low: float, high: float, alpha: float) -> Iterator[tuple[object, bool, np.ndarray | None, Steps | None]]:
    """Key, whether it begins, value and step of each row of a sorted stretch; no value and step where the value is null."""
    columns = [rows.column(c).to_pylist() for c in ("k", "first", "x", "lo", "hi", "m")]
    for k, first, x, lo, hi, m in zip(*columns, strict=True):
        if x is None:
            yield k, first, None, None
            continue
        value = np.asarray(x, float)
        bounds = [np.full(len(value), b) if own is None else np.asarray(own, float) for b, own in ((low, lo), (high, hi))]
        yield k, first, value, Steps.one(value, *bounds, alpha, places(None if m is None else np.asarray(m, float), len(value), width))


SUMMED = "stretch bigint, begins boolean, state binary, one binary, rest binary"


def blended_frames(
    df: DataFrame, key: str, order: str, value: str, alpha: float, low: float = -np.inf, high: float = np.inf,
    low_col: str | None = None, high_col: str | None = None, motion: str | None = None, width: int = 1, stretch: int = STRETCH,
) -> DataFrame:
    """``key, order, state``: each frame blended into the clamped last state of its key, moved along its motion.

    ``value`` is a flat array with rows of ``width`` pixels, the same size in all frames of a key. The first frame is its own
    state; a null value leaves the state as it was, null while there is none. Bounds are numbers, or arrays a frame
    (``low_col``, ``high_col``, where not null). ``motion`` (x, y for each pixel, in whole pixels) says where a pixel was in the last frame;
    null is no motion. Null keys are a key; equal orders are in order of nothing and must not matter.

    Frames are ranked over range partitions and cut in stretches. What is summed up of a stretch, five arrays, is composed
    in order in one pass over one row a stretch, ``1 / stretch`` of the table; then all stretches run through again, each
    from the state it begins with. So all tasks work on one history, however long.
    """
    ship_code(df.sparkSession)
    numbers = lambda c: F.col(c).cast("array<double>") if c else F.lit(None).cast("array<double>")
    rows = df.select(F.col(key).alias("k"), F.col(order).alias("o"), numbers(value).alias("x"), numbers(low_col).alias("lo"), numbers(high_col).alias("hi"), numbers(motion).alias("m"))
    rows = rows.withColumn("kk", F.struct(F.col("k").isNull().alias("none"), "k"))
    ranked = with_running(rows, [F.asc("kk"), F.asc("o")], {}, "at", lags={"before": F.col("kk")})
    ranked = ranked.select("k", "o", "x", "lo", "hi", "m", "at", (~F.col("kk").eqNullSafe(F.col("before"))).alias("first"), F.floor((F.col("at") - 1) / stretch).alias("stretch"))
    ranked = scratch_table(ranked, "frames-in-order")

    def summed(key_: tuple, some: pa.Table) -> pa.Table:
        """Of the last history of a stretch: its state if it begins in here, else its first value's step and all others' as one.

        If there is no state yet when a history goes on, its first value here is the state.
        """
        begins, state, one, rest = False, None, None, None
        for _, first, x, step in _frames(some.sort_by("at"), width, low, high, alpha):
            if first:
                begins, state, one, rest = True, None, None, None
            if step is None:
                continue
            if begins:
                state = x if state is None else step.of(state)
            elif one is None:
                state, one = x, step
            else:
                rest = step if rest is None else rest.then(step)
        columns = [None if state is None else state.tobytes(), *[None if s is None else s.packed() for s in (one, rest)]]
        arrays = [pa.array([key_[0].as_py()], pa.int64()), pa.array([begins]), *[pa.array([c], pa.binary()) for c in columns]]
        return pa.table(arrays, names=["stretch", "begins", "state", "one", "rest"])

    sums = scratch_table(ranked.groupBy("stretch").applyInArrow(summed, SUMMED), "stretch-sums")

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: np.ndarray | None = None
        for batch in batches:
            found = []
            for _, begins, own, one, rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found.append(None if state is None else state.tobytes())
                if begins or (state is None and own is not None):
                    state = None if own is None else np.frombuffer(own)
                elif one is not None:
                    state = Steps.unpacked(one).of(state)
                if not begins and rest is not None:
                    state = Steps.unpacked(rest).of(state)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["stretch", "state"])

    line = sums.repartition(1).sortWithinPartitions("stretch")  # one row a stretch
    starts = scratch_table(line.mapInArrow(followed, "stretch bigint, state binary"), "stretch-starts")

    def run(key_: tuple, some: pa.Table, start: pa.Table) -> pa.Table:
        data = start.column("state")[0].as_py() if len(start) else None
        state, out = None if data is None else np.frombuffer(data), []
        some = some.sort_by("at")
        for _, first, x, step in _frames(some, width, low, high, alpha):
            state = None if first else state
            if step is not None:
                state = x if state is None else step.of(state)
            out.append(None if state is None else state.tolist())
        return pa.table([some.column("k"), some.column("o"), pa.array(out, pa.list_(pa.float64()))], names=["k", "o", "state"])

    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema}
    out = ranked.groupBy("stretch").cogroup(starts.groupBy("stretch")).applyInArrow(run, f"k {kinds['k']}, o {kinds['o']}, state array<double>")
    return out.select(F.col("k").alias(key), F.col("o").alias(order), "state")
