"""Whitening: vectors projected on the main axes of their covariance and scaled to unit variance.

Each partition keeps the singular values and vectors of its centred rows, all of them, with its row count and exact sums.
Two such summaries merge by a singular value decomposition of both, stacked, and one row for the distance of their means;
nothing is lost, so the last summary is that of the whole table. Merges go up a hierarchy of few at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.scale import scratch_table
from siltworks.llm.vectors import finite_rows
from siltworks.ship import ship_code

#: Summaries that one task merges, and numbers in a block of rows that is decomposed at once.
FAN, BLOCK_NUMBERS = 8, 1 << 19
#: Integers beyond this are limited to it: up to here doubles hold them.
LIMIT = 1 << 52

SUMMARY = "node bigint, n bigint, sums array<decimal(38,0)>, values array<double>, axes binary"


@dataclass
class Summary:
    """Rows of integers as their count, exact sums, and the singular values and right vectors of the centred rows."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Summary:
        """Of a block of int64 rows that no sum or multiple of which leaves 63 bits is true: see ``_blocks``."""
        n = len(rows)
        sums = [int(s) for s in rows.astype(object).sum(0)] if int(np.abs(rows).max(initial=0)) > (1 << 62) // max(1, n) else rows.sum(0).tolist()
        return cls._decomposed(n, sums, centred(rows, n, sums))

    @classmethod
    def _decomposed(cls, n: int, sums: list[int], stacked: np.ndarray) -> Summary:
        _, values, axes = np.linalg.svd(stacked, full_matrices=False)
        return cls(n, sums, values, axes)

    def merge(self, other: Summary) -> Summary:
        n = self.n + other.n
        apart = np.array([float(a * other.n - b * self.n) for a, b in zip(self.sums, other.sums, strict=True)]) / (float(self.n) * other.n)
        step = np.sqrt(float(self.n) * other.n / n) * apart
        stacked = np.vstack([self.values[:, None] * self.axes, other.values[:, None] * other.axes, step])
        return self._decomposed(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], stacked)

    def record(self, node: int) -> pa.RecordBatch:
        columns = [
            pa.array([node], pa.int64()), pa.array([self.n], pa.int64()), pa.array([[Decimal(s) for s in self.sums]], pa.list_(pa.decimal128(38, 0))),
            pa.array([self.values.tolist()], pa.list_(pa.float64())), pa.array([np.ascontiguousarray(self.axes).tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["node", "n", "sums", "values", "axes"])

    @classmethod
    def read(cls, n: int, sums: list, values: list[float], axes: bytes) -> Summary:
        return cls(n, [int(s) for s in sums], np.array(values), np.frombuffer(axes).reshape(-1, len(sums)))


def centred(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - sums / n`` of each entry, subtracted as integers: exact up to one rounding."""
    most = max([int(np.abs(rows).max(initial=0)) * n, *map(abs, sums)], default=0)
    if most < 1 << 62:
        return (rows * n - np.array(sums, np.int64)) / n
    return ((rows.astype(object) * n - np.array(sums, object)) / n).astype(np.float64)


def _blocks(batches: Iterator[pa.RecordBatch], at: int, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Arrow batches in blocks of bounded size, with their vectors as a matrix of integers."""
    step = max(1, min(1 << 14, BLOCK_NUMBERS // max(1, dims)))
    for batch in batches:
        for lo in range(0, len(batch), step):
            part = batch.slice(lo, step)
            yield part, part.column(at).flatten().to_numpy().reshape(len(part), dims)


def summarise(rows: DataFrame, dims: int, fan: int = FAN) -> Summary | None:
    """The summary of all ``v`` (arrays of ``dims`` longs); none for an empty table.

    One row a partition, merged ``fan`` at a time until one is left, each level a table: a lost task repeats its own few
    merges. A row has ``dims`` squared doubles at most, so does what the driver gets.
    """
    ship_code(rows.sparkSession)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for _, block in _blocks(batches, 0, dims):
            part = Summary.of(block)
            whole = part if whole is None else whole.merge(part)
        if whole is not None:
            yield whole.record(TaskContext.get().partitionId())

    def merged(key: tuple, some: pa.Table) -> pa.Table:
        parts = [Summary.read(r["n"], r["sums"], r["values"], r["axes"]) for r in sorted(some.to_pylist(), key=lambda r: r["node"])]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.merge(part)
        return pa.Table.from_batches([whole.record(key[0].as_py())])

    level = scratch_table(rows.select("v").mapInArrow(first, SUMMARY), "whitening-parts")
    last = level.agg(F.max("node")).first()[0]
    while last:
        parent = F.floor(F.col("node") / fan).cast("long")
        level = scratch_table(level.groupBy(parent.alias("parent")).applyInArrow(merged, SUMMARY), "whitening-level")
        last //= fan
    one = level.first()
    return None if one is None else Summary.read(one["n"], one["sums"], one["values"], bytes(one["axes"]))


@dataclass
class Whitening:
    """The main axes by falling variance, with what they explain. ``axes`` has a row a component."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    explained: np.ndarray

    @classmethod
    def of(cls, whole: Summary, components: int | None = None) -> Whitening:
        """Axes without variance, beyond rounding, are no components; the largest entry of an axis is positive."""
        s = whole.values
        floor = (s[0] if len(s) else 0.0) * max(len(whole.sums), 1) * np.finfo(float).eps * 8
        keep = np.flatnonzero(s > floor)[:components]
        axes = whole.axes[keep]
        if len(keep):
            axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
        variances = s[keep] ** 2 / whole.n
        return cls(whole.n, whole.sums, axes, variances, variances / max((s**2).sum() / whole.n, np.finfo(float).tiny))

    def project(self, rows: np.ndarray) -> np.ndarray:
        return centred(rows, self.n, self.sums) @ (self.axes / np.sqrt(self.variances)[:, None]).T

    def deviations(self, rows: np.ndarray) -> list[int]:
        """For each row the sum of ``(n * x - S) ** 2``, exactly."""
        far = int(np.abs(rows).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        kind = np.int64 if far * far * max(1, len(self.sums)) < 1 << 63 else object
        if kind is np.int64:
            apart = rows * self.n - np.array(self.sums, np.int64)
        else:
            apart = rows.astype(object) * self.n - np.array(self.sums, object)
            most = int(max(abs(apart.min(initial=0)), apart.max(initial=0)))
            if most * most * max(1, len(self.sums)) < 1 << 63:
                apart = apart.astype(np.int64)
        return [int(d) for d in (apart * apart).sum(1)]


def fit_whitening(rows: DataFrame, dims: int, components: int | None = None) -> Whitening | None:
    whole = summarise(rows, dims)
    return None if whole is None else Whitening.of(whole, components)


def identity_error(rows: DataFrame, model: Whitening, dims: int) -> float:
    """The largest entry of the covariance of the whitened rows, less the identity: products are summed in each task first."""
    k = len(model.axes)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k + 1, k))
        for _, block in _blocks(batches, 0, dims):
            out = model.project(block)
            sums += np.vstack([out.T @ out, out.sum(0)])
        at = np.indices(sums.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(sums.ravel())], names=["i", "j", "s"])

    total = np.zeros((k + 1, k))
    for r in rows.select("v").mapInArrow(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[r["i"], r["j"]] = r["s"]
    mean = total[k] / model.n  # zero but for rounding: rows are centred before they multiply
    return float(np.abs(total[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


WHITENED = "k bigint, component int, deviation bigint, whitened double"


def whiten(rows: DataFrame, model: Whitening, dims: int) -> DataFrame:
    """``k, component, deviation, whitened``: a row for each row and component. Nothing shuffles.

    ``deviation`` is null where it leaves 63 bits.
    """
    k = len(model.axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in _blocks(batches, 1, dims):
            apart = [d if d < 1 << 63 else None for d in model.deviations(block)]
            which = pa.array(np.repeat(np.arange(len(block)), k))
            columns = [
                part.column(0).take(which), pa.array(np.tile(np.arange(1, k + 1), len(block)), pa.int32()),
                pa.array(apart, pa.int64()).take(which), pa.array(model.project(block).ravel()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "component", "deviation", "whitened"])

    return rows.select("k", "v").mapInArrow(run, WHITENED)


def integer_rows(df: DataFrame, key: str, vector: str, scale: int = 1024, shift: int = 100_000) -> tuple[DataFrame, int]:
    """``k, v`` with ``floor(scale * c) + shift`` of each entry, and the length of the vectors.

    Null vectors and those with null or non-finite entries are left out, so are those whose length is not the most frequent
    one (of equally frequent ones the smaller). Integers are limited to 52 bits before the shift.
    """
    whole = lambda c: F.greatest(F.least(F.floor(F.lit(float(scale)) * c), F.lit(LIMIT)), F.lit(-LIMIT)) + F.lit(shift).cast("long")
    rows = scratch_table(finite_rows(df, key, vector).select("k", F.transform("v", whole).alias("v")), "whitening-rows")
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    dims = most["d"] if most else 0
    return rows.where(F.size("v") == dims), dims


def whitening_report(df: DataFrame, components: int = 8) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every vector that takes part.

    See ``integer_rows`` for those that do not. Components without variance are not there: one row alone, or equal rows, give
    none. Null ids and rows that repeat are rows like any other. An empty table gives no rows; other columns are left out.
    """
    rows, dims = integer_rows(df, "vec_id", "embedding")
    model = fit_whitening(rows, dims, components) if dims else None
    if model is None or not len(model.axes):
        schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, model, dims)
    shares = F.split(F.lit(",".join(map(repr, model.explained.tolist()))), ",").cast("array<double>")
    return whiten(rows, model, dims).select(
        F.col("k").alias("vec_id"), "component", F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("component") - 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
