"""Joins: canonical pairs, Hamming and cosine neighbours, deltas, fills, key checks."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks.functions.hashing import hamming
from siltworks.operators.skew import attach_by_key
from siltworks.scratch import scratch_table
from siltworks.ship import ship_code

#: Vectors in one block of a blocked search.
BLOCK = 2_048
#: Random hashes that may share a bucket of a Hamming search, and the most masks that it tries.
BUCKET, MAX_MASKS = 64, 256


def canonical_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct unordered pairs, the lesser end first; self-pairs are left out."""
    ends = pairs.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b))
    return ends.where(F.col(a) < F.col(b)).distinct()


def band_masks(radius: int, within: int, n: int) -> list[int]:
    """Masks of ``within`` bits such that two numbers that differ in at most ``radius`` of them agree under one at least.

    The bits are cut into ``radius + m`` bands, of which ``m`` agree; a mask is ``m`` bands. ``m`` grows with the number
    of hashes, so that a mask has enough bits to leave few of ``n`` random numbers alike, up to ``MAX_MASKS`` masks.
    """
    m = 1
    while m * within // (radius + m) < np.log2(max(2, n)) - np.log2(BUCKET) and math.comb(radius + m + 1, m + 1) <= MAX_MASKS and radius + m < within:
        m += 1
    edges = np.linspace(0, within, radius + m + 1).astype(int).tolist()
    bands = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(some) for some in itertools.combinations(bands, m)]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in masks]


def hamming_join(df: DataFrame, key: str, bits: str, radius: int, within: int = 64) -> DataFrame:
    """All pairs ``a < b`` whose ``bits`` differ in at most ``radius`` of the lowest ``within`` places, exactly.

    Hashes meet under the masks of ``band_masks``: the more hashes there are, the more bits a meeting takes, so that a
    bucket of random hashes stays small; both sides are shuffled, whatever their files' size. Equal hashes are one row of the search and are paired out only at the end,
    each once with its group's least key; so a hash that fills the table is compared once.
    """
    low = F.lit((1 << within) - 1 if within < 63 else -1)
    whole = scratch_table(df.where(F.col(bits).isNotNull()).select(F.col(key).alias("k"), F.col(bits).alias("x")), "hashes")
    reps = scratch_table(whole.groupBy("x").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("n")), "hash-reps")
    masks = band_masks(radius, within, reps.count())
    parts = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("x").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks)])
    side = reps.select("x", "rep", F.explode(parts).alias("at")).select("x", "rep", "at.mask", "at.part")
    one, two = side.alias("p"), side.alias("q")
    # Spark takes the exploded side for as small as its file and would broadcast a row a hash and mask through the driver.
    near = one.hint("merge").join(two, F.expr("p.mask = q.mask AND p.part = q.part AND p.rep < q.rep"))
    differ = hamming(F.col("p.x").bitwiseAND(low), F.col("q.x").bitwiseAND(low))
    near = near.withColumn("hamming", differ).where(F.col("hamming") <= radius)
    near = near.select(F.col("p.rep").alias("a"), F.col("q.rep").alias("b"), "hamming").distinct()
    counts = scratch_table(reps.where("n > 1").select("x", "rep", "n"), "hash-copies")
    copies = attach_by_key(whole, counts, "x", "n", max(1, whole.count())).where("rep IS NOT NULL AND k <> rep")
    same = copies.select(F.col("rep").alias("a"), F.col("k").alias("b"), F.lit(0).alias("hamming"))
    return near.unionByName(same)


def expand_copies(edges: DataFrame, df: DataFrame, key: str, bits: str) -> DataFrame:
    """Pairs between representatives of equal hashes as pairs between all their rows. For reports on small groups."""
    copies = df.where(F.col(bits).isNotNull()).select(F.col(key).alias("k"), F.col(bits).alias("x"))
    reps = copies.groupBy("x").agg(F.min("k").alias("rep"))
    members = copies.join(reps, "x").select("rep", "k")
    left, right = members.select(F.col("rep").alias("a"), F.col("k").alias("ka")), members.select(F.col("rep").alias("b"), F.col("k").alias("kb"))
    reps_only = edges.join(reps.select(F.col("rep").alias("a")), "a", "left_semi").join(reps.select(F.col("rep").alias("b")), "b", "left_semi")
    across = reps_only.join(left, "a").join(right, "b").select(F.col("ka").alias("a"), F.col("kb").alias("b"), "hamming")
    inside = left.join(members.select(F.col("rep").alias("a"), F.col("k").alias("kb")), "a").where("ka < kb")
    inside = inside.select(F.col("ka").alias("a"), F.col("kb").alias("b"), F.lit(0).alias("hamming"))
    ends = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "hamming")
    return ends.unionByName(inside)


def _transformed(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform along the last axis, whose length is a power of two; writes to ``x``."""
    n, step = x.shape[-1], 1
    while step < n:
        pair = x.reshape(*x.shape[:-1], n // (2 * step), 2, step)
        low = pair[..., 0, :].copy()
        pair[..., 0, :] += pair[..., 1, :]
        np.subtract(low, pair[..., 1, :], out=pair[..., 1, :])
        step *= 2
    return x


def distance_counts(hashes: DataFrame, bits: str, within: int) -> DataFrame:
    """``hamming, n``: how many pairs of distinct numbers of ``within`` bits (2 to 26) differ in so many places, for all distances.

    No pair is made. The squares of the Walsh-Hadamard transform of the set, summed by the number of bits of their places, give
    the counts by Krawtchouk polynomials, in whole numbers. The cube of 2**within places is transformed in slices: first along the lower half
    of the bits, then, dealt anew, along the upper one. However many hashes there are, no more than the cube moves. Nulls do not count.
    """
    if not 2 <= within <= 26:
        raise ValueError(f"a cube of {within} bits")
    ship_code(hashes.sparkSession)
    low = within // 2
    high, width = within - low, 1 << min(6, low)
    ones = hashes.where(F.col(bits).isNotNull()).select(F.col(bits).bitwiseAND(F.lit((1 << within) - 1)).alias("x")).distinct()
    ones = ones.groupBy(F.shiftright("x", low).cast("int").alias("hi")).agg(F.collect_list(F.col("x").bitwiseAND(F.lit((1 << low) - 1)).cast("int")).alias("lo"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                where = part.column(1).flatten().to_numpy()
                sizes = np.diff(part.column(1).offsets.to_numpy())
                held = np.zeros((len(part), 1 << low), np.int32)
                held[np.repeat(np.arange(len(part)), sizes), where] = 1
                slices = _transformed(held).reshape(len(part), -1, width)
                chunk = np.tile(np.arange(slices.shape[1], dtype=np.int32), len(part))
                hi = np.repeat(part.column(0).to_numpy(), slices.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(hi), pa.array([s.tobytes() for row in slices for s in row], pa.binary())], names=["chunk", "hi", "line"])

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(within + 1, np.int64)
        for batch in batches:
            for chunk, lines in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lines = lines.values
                held = np.zeros((1 << high, width), np.int32)
                held[lines.field("hi").to_numpy()] = np.array([np.frombuffer(line.as_py(), np.int32) for line in lines.field("line")])
                found = _transformed(np.ascontiguousarray(held.T)).astype(np.int64) ** 2
                weight = np.bitwise_count(np.arange(width) + chunk * width)[:, None] + np.bitwise_count(np.arange(1 << high))[None, :]
                for w in range(within + 1):
                    sums[w] += found[weight == w].sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(within + 1, dtype=np.int32)), pa.array(sums)], names=["weight", "s"])

    lines = ones.mapInArrow(rows, "chunk int, hi int, line binary").repartition(16, "chunk")
    lines = lines.groupBy("chunk").agg(F.collect_list(F.struct("hi", "line")).alias("lines"))
    totals = {r["weight"]: r["s"] or 0 for r in lines.mapInArrow(squares, "weight int, s long").groupBy("weight").agg(F.sum("s").alias("s")).collect()}  # 27 rows at most

    def krawtchouk(d: int, w: int) -> int:
        return sum((-1) ** j * math.comb(w, j) * math.comb(within - w, d - j) for j in range(min(d, w) + 1))

    counts = [(d, (sum(krawtchouk(d, w) * s for w, s in totals.items()) >> within) // 2) for d in range(1, within + 1)]
    return hashes.sparkSession.createDataFrame(counts, "hamming int, n long")


BLOCK_SCHEMA = "cell int, block bigint, n int, keys binary, groups array<string>, vectors binary, reach double, turn double, least double, most double"


def _packed(df: DataFrame, key: str, vector: str, group: str | None, name: str, cells: Cells, probes: int = 1) -> DataFrame:
    """Vectors packed in blocks of bytes, where they lie: nothing shuffles. A block has one cell's vectors.

    With ``probes`` a vector is in the blocks of so many cells, the nearest ones. ``reach`` and ``turn`` are the largest
    distance and angle of a block's vectors from its cell's centre, ``least`` and ``most`` their lengths.
    """
    ship_code(df.sparkSession)
    slim = df.where(F.col(vector).isNotNull()).select(
        F.col(key).cast("long").alias("k"), (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("g"),
        F.col(vector).cast("array<float>").alias("v"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        number = TaskContext.get().partitionId() << 32

        def block(cell: int) -> pa.RecordBatch:
            nonlocal number
            number += 1
            ks, gs, vs = zip(*held.pop(cell), strict=True)
            keys, groups, vectors = np.concatenate(ks), [x for one in gs for x in one], np.concatenate(vs)
            columns = [
                pa.array([cell], pa.int32()), pa.array([number], pa.int64()), pa.array([len(keys)], pa.int32()), pa.array([keys.tobytes()], pa.binary()),
                pa.array([groups], pa.list_(pa.string())), pa.array([vectors.tobytes()], pa.binary()),
                *[pa.array([x], pa.float64()) for x in cells.around(cell, vectors)],
            ]
            return pa.RecordBatch.from_arrays(columns, names=[part.split()[0] for part in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            if not len(batch):
                continue
            keys, groups = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object)
            lists = batch.column(2)
            vectors = lists.flatten().to_numpy().reshape(len(batch), -1).astype(np.float32)
            where = cells.nearest(vectors, probes)
            for cell in np.unique(where):
                rows = (where == cell).any(1)
                held.setdefault(int(cell), []).append((keys[rows], groups[rows].tolist(), vectors[rows]))
                if sum(len(k) for k, _, _ in held[int(cell)]) >= BLOCK:
                    yield block(int(cell))
        for cell in list(held):
            yield block(cell)

    return scratch_table(slim.mapInArrow(run, BLOCK_SCHEMA), name)


class Cells:
    """Centres that vectors are dealt to, each to its nearest, fitted on a bounded sample."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres

    def nearest(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        if vectors.shape[1] != self.centres.shape[1]:  # fitted on nothing
            return np.zeros((len(vectors), 1), int)
        return np.argsort(-(vectors @ self.centres.T), axis=1, kind="stable")[:, :probes]

    def around(self, cell: int, vectors: np.ndarray) -> tuple[float, float, float, float]:
        """Largest distance and angle of vectors from a centre, their least and largest length."""
        x, lengths = vectors.astype(float), np.linalg.norm(vectors.astype(float), axis=1)
        if vectors.shape[1] != self.centres.shape[1]:
            return float(lengths.max()), math.pi, float(lengths.min()), float(lengths.max())
        c = self.centres[cell].astype(float)
        size = float(np.linalg.norm(c))
        cosines = np.where(lengths > 0, x @ c / np.maximum(lengths * size, 1e-300), -1.0)
        return float(np.linalg.norm(x - c, axis=1).max()), float(np.arccos(np.clip(cosines, -1, 1)).max()), float(lengths.min()), float(lengths.max())

    def pairs(self, spark: SparkSession) -> DataFrame:
        """``a_cell, b_cell, dot, angle, a_size, b_size`` of all pairs of centres: as many rows as the square of the cells' bounded number."""
        c = self.centres.astype(float)
        sizes, dots = np.linalg.norm(c, axis=1), c @ c.T
        angles = np.arccos(np.clip(dots / np.maximum(np.outer(sizes, sizes), 1e-300), -1, 1))
        rows = [(i, j, float(dots[i, j]), float(angles[i, j]), float(sizes[i]), float(sizes[j])) for i in range(len(c)) for j in range(len(c))]
        return spark.createDataFrame(rows, "a_cell int, b_cell int, dot double, angle double, a_size double, b_size double")


def fit_cells(df: DataFrame, key: str, vector: str, cells: int, sample: int = 20_000, rounds: int = 10, seed: int = 3) -> Cells:
    """Centres by spherical k-means on at most ``sample`` vectors, those with the least hash of key and seed.

    The bound is a parameter: it limits what reaches the driver. Every vector is assigned to a cell, in the sample or not.
    """
    some = df.where(F.col(vector).isNotNull()).select(F.xxhash64(F.lit(seed), F.col(key)).alias("h"), key, F.col(vector).cast("array<float>").alias("v"))
    rows = some.orderBy("h", key).limit(sample).collect()
    points = np.array([r["v"] for r in rows], np.float32) if rows else np.zeros((1, 1), np.float32)
    centres = points[np.linspace(0, len(points) - 1, min(cells, len(points))).astype(int)].copy()
    for _ in range(rounds):
        own = (points @ centres.T).argmax(1)
        for c in range(len(centres)):
            if (own == c).any():
                centre = points[own == c].sum(0)
                centres[c] = centre / max(1e-12, float(np.linalg.norm(centre)))
    return Cells(centres)


def _scored(keep):
    """Score all vectors of two packed blocks and let ``keep`` choose cells of the matrix; it is told the first block, if both are of one cell, and further columns."""

    def unpack(batch: pa.RecordBatch, at: int, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = np.frombuffer(batch.column(at)[row].as_py(), np.int64)
        groups = np.array(batch.column(at + 1)[row].as_py(), object)
        return keys, groups, np.frombuffer(batch.column(at + 2)[row].as_py(), np.float32).reshape(len(keys), -1).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                ka, ga, a = unpack(batch, 0, row)
                kb, gb, b = unpack(batch, 3, row)
                yield keep(a @ b.T, ka, kb, ga, gb, *[column[row].as_py() for column in batch.columns[6:]])

    return run


#: Centres of an exact search, and blocks of one cell that one key of its join holds.
PIVOTS, CELL_BLOCKS = 64, 64
_MARKS = ("reach", "turn", "least", "most")


def _largest(a: str, b: str) -> Column:
    """The largest dot product that vectors of two blocks can have, from distances and angles to their centres.

    By the triangle inequality of lengths, and of angles; the smaller of both, and a little for rounding.
    """
    of = lambda side, name: F.col(f"{side}_{name}")
    flat = F.col("dot") + F.col("a_size") * of(b, "reach") + F.col("b_size") * of(a, "reach") + of(a, "reach") * of(b, "reach")
    turned = F.cos(F.greatest(F.lit(0.0), F.col("angle") - of(a, "turn") - of(b, "turn")))
    round_ = turned * F.when(turned >= 0, of(a, "most") * of(b, "most")).otherwise(of(a, "least") * of(b, "least"))
    return F.least(flat, round_) + 1e-5 * (1 + of(a, "most") * of(b, "most"))


def meeting_blocks(left: DataFrame, right: DataFrame, cells: Cells, floor: Column, where: Column | None = None) -> DataFrame:
    """Pairs of blocks that can hold a dot product of ``floor``, an expression over the left block's columns (``a_...``).

    First cells meet cells, by the extremes of their blocks: a table as large as the square of the cells' number, which is
    broadcast. A left block then goes to the cells that can matter to it, and there meets blocks of its own chance only.
    A cell with many blocks is split among keys.
    """
    every = ("block", "n", "keys", "groups", "vectors", *_MARKS)
    extremes = lambda side: [(F.min if m == "least" else F.max)(m).alias(f"{side}_{m}") for m in _MARKS]
    far = right.groupBy(F.col("cell").alias("b_cell")).agg(*extremes("c"), F.ceil(F.count(F.lit(1)) / CELL_BLOCKS).cast("int").alias("parts"))
    met = scratch_table(cells.pairs(left.sparkSession).join(far, "b_cell"), "cell-pairs")
    one = left.select(F.col("cell").alias("a_cell"), *[F.col(c).alias(f"a_{c}") for c in every], *[c for c in left.columns if c not in ("cell", *every)])
    one = one.join(F.broadcast(met), "a_cell").where(_largest("a", "c") >= floor)  # at most PIVOTS squared rows
    one = one.where(where) if where is not None else one
    one = one.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    two = right.join(F.broadcast(far.select(F.col("b_cell").alias("cell"), "parts")), "cell")  # a row a cell
    two = two.select(F.col("cell").alias("b_cell"), F.pmod(F.xxhash64("block"), F.col("parts")).cast("int").alias("part"), *[F.col(c).alias(f"b_{c}") for c in every])
    return one.join(two, ["b_cell", "part"]).where(_largest("a", "b") >= floor)


def _columns(met: DataFrame, *more: str) -> DataFrame:
    names = [f"{side}_{c}" for side in ("a", "b") for c in ("keys", "groups", "vectors")]
    return met.select(*names, "a_block", (F.col("a_cell") == F.col("b_cell")).alias("own"), *more)


def _same_cell(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of blocks of the same cell."""
    names = ("keys", "groups", "vectors")
    one = left.select("cell", F.col("block").alias("a_block"), *[F.col(c).alias(f"a_{c}") for c in names])
    both = one.join(right.select("cell", *[F.col(c).alias(f"b_{c}") for c in names]), "cell")
    return both.select(*[f"{side}_{c}" for side in ("a", "b") for c in names], "a_block", F.lit(True).alias("own"))


def _best(sims: np.ndarray, kb: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` largest finite numbers of each row, in order, ties to the lesser key; none below the row's ``floor``.

    Only numbers that reach a row's k-th largest, or its floor, are sorted. Writes to ``sims``.
    """
    sims[np.isnan(sims)] = -np.inf
    floor = np.full(len(sims), -np.inf) if floor is None else floor
    if k < sims.shape[1] and (open_ := np.flatnonzero(floor == -np.inf)).size:
        floor[open_] = np.partition(sims[open_], -k, axis=1)[:, -k]
    rows, cols = np.nonzero((sims >= floor[:, None]) & (sims > -np.inf))
    order = np.lexsort((kb[cols], -sims[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, rows)
    kept = (np.arange(len(rows)) - first < k) & np.isfinite(sims[rows, cols])
    return rows[kept], cols[kept]


def _codes(ga: np.ndarray, gb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of two blocks as numbers: equal ones are equal, no group is a different one on either side."""
    known: dict[str, int] = {}
    a, b = (np.array([missing if g is None else known.setdefault(g, len(known)) for g in side], int) for side, missing in ((ga, -1), (gb, -2)))
    return a, b


def neighbours(
    queries: DataFrame, reference: DataFrame, key: str, vector: str, k: int, group: str | None = None, cells: int = 0, probes: int = 8, pivots: int = PIVOTS
) -> DataFrame:
    """The ``k`` reference vectors with the largest dot product for each query, never of its own group.

    ``query, ref, similarity, rank`` rows; fewer where fewer are eligible; ties go to the lesser key. Vectors are dealt to the
    nearest of some centres. Without ``cells`` the search is exact: queries ask their own cell first; the k-th
    result that all queries of a block have found is the least that another block must be able to hold to be asked
    (``meeting_blocks``), and of its vectors only those that reach a query's own k-th result are told. Clustered vectors leave few pairs of blocks; vectors without structure all of them. With ``cells`` the
    reference is divided among so many and a query meets those of its ``probes`` nearest ones only; more probes
    find more, all of them everything. Null vectors neither ask nor answer; a null group is no group.
    """
    fitted = fit_cells(reference, key, vector, cells or pivots)
    q = _packed(queries, key, vector, group, "query-blocks", fitted, probes if cells else 1)
    r = _packed(reference, key, vector, group, "reference-blocks", fitted, 1)

    def keep(sims, ka, kb, ga, gb, block, own, at=None, reached=None):
        if group:
            one, two = _codes(ga, gb)
            sims[one[:, None] == two[None, :]] = -np.inf
        floor = None
        if at is not None:
            floor = np.full(len(ka), -np.inf)
            floor[at] = reached
        rows, cols = _best(sims, kb, k, floor)
        columns = [pa.array(np.full(len(rows), block)), pa.array(ka[rows]), pa.array(rows), pa.array(kb[cols]), pa.array(sims[rows, cols])]
        return pa.RecordBatch.from_arrays(columns, names=["block", "query", "at", "ref", "similarity"])

    scored = lambda met: met.mapInArrow(_scored(keep), "block bigint, query bigint, at bigint, ref bigint, similarity double")
    found = scored(_same_cell(q, r))
    if not cells:
        found = scratch_table(found, "own-cell")
        line = Window.partitionBy("block", "at").orderBy(F.desc("similarity"), "ref")
        kth = found.withColumn("rank", F.row_number().over(line)).where(F.col("rank") == k)
        floors = kth.groupBy("block").agg(F.count(F.lit(1)).alias("m"), F.min("similarity").alias("kth"), F.collect_list(F.struct("at", "similarity")).alias("each"))
        floors = floors.select("block", "m", "kth", F.col("each.at").alias("at"), F.col("each.similarity").alias("reached"))
        q = q.join(floors, "block", "left").withColumn("floor", F.when(F.col("m") == F.col("n"), F.col("kth")).otherwise(float("-inf"))).drop("m", "kth")
        found = found.unionByName(scored(_columns(meeting_blocks(q, r, fitted, F.col("floor"), F.col("a_cell") != F.col("b_cell")), "at", "reached")))
    line = Window.partitionBy("query").orderBy(F.desc("similarity"), "ref")
    return found.select("query", "ref", "similarity").withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)


def pairs_above(df: DataFrame, key: str, vector: str, threshold: float, cells: int = 0, probes: int = 8, pivots: int = PIVOTS) -> DataFrame:
    """All pairs ``a < b`` with a dot product of at least ``threshold``: exactly, by the blocks that can hold one; see ``neighbours`` for ``cells``."""
    fitted = fit_cells(df, key, vector, cells or pivots)
    left = _packed(df, key, vector, None, "vector-blocks", fitted, probes if cells else 1)
    right = _packed(df, key, vector, None, "vector-blocks", fitted, 1) if cells else left

    def keep(sims, ka, kb, ga, gb, block, own):
        once = (ka[:, None] < kb[None, :]) if own and not cells else (ka[:, None] != kb[None, :])
        i, j = np.nonzero((sims >= threshold) & once)
        a, b = np.minimum(ka[i], kb[j]), np.maximum(ka[i], kb[j])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sims[i, j])], names=["a", "b", "similarity"])

    if cells:
        met = _same_cell(left, right)
    else:
        met = _columns(meeting_blocks(left, right, fitted, F.lit(float(threshold)), F.col("a_cell") <= F.col("b_cell")))
    found = met.mapInArrow(_scored(keep), "a bigint, b bigint, similarity double")
    return found.groupBy("a", "b").agg(F.max("similarity").alias("similarity")) if cells else found


def pair_scores(pairs: DataFrame, features: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Both ends' features beside each pair ``a, b``, as ``<column>_a`` and ``<column>_b``."""
    out = pairs
    for end in ("a", "b"):
        side = features.select(F.col(key).alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
        out = out.join(side, end)
    return out


def null_safe(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equality of keys under which nulls match, as data frames merge."""
    return F.expr(" AND ".join(f"{left}.`{k}` <=> {right}.`{k}`" for k in keys))


def merge(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Inner join on keys that may be null; ``columns`` of the right side are added."""
    out = left.alias("l").join(right.alias("r"), null_safe("l", "r", keys))
    return out.select("l.*", *[F.col(f"r.`{c}`") for c in columns])


def fill_missing(queries: DataFrame, scores: DataFrame, key: str, value: str, default: float = 0.0) -> DataFrame:
    """The best score of every query, ``default`` where it has none."""
    best = scores.groupBy(key).agg(F.max(value).alias(value))
    return queries.join(best, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def delta_to_reference(df: DataFrame, keys: Sequence[str], method: str, reference: str, metrics: Sequence[str]) -> DataFrame:
    """Metrics less those of the reference row of the same group; null where the group has none."""
    base = df.where(F.col(method) == reference).select(*keys, *[F.col(m).alias(f"__{m}") for m in metrics])
    out = df.where(F.col(method) != reference).alias("l").join(base.alias("r"), null_safe("l", "r", keys), "left")
    return out.select(*[F.col(f"l.`{k}`") for k in keys], f"l.{method}", *[(F.col(f"l.{m}") - F.col(f"r.__{m}")).alias(m) for m in metrics])


def change_report(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """``key, status, old, new`` for keys that were added, removed or changed."""
    old, new = before.select(key, F.col(value).alias("old")), after.select(key, F.col(value).alias("new"))
    old, new = old.withColumn("__o", F.lit(True)), new.withColumn("__n", F.lit(True))
    both = old.join(new, key, "full")
    status = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.withColumn("status", status).where("status IS NOT NULL").select(key, "status", "old", "new")


def unknown_keys(uses: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Used keys that are not known."""
    return uses.select(key).distinct().join(known.select(key), key, "left_anti")


def repeated_keys(values: DataFrame, key: str) -> DataFrame:
    """Keys defined more than once, with their count."""
    return values.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def derived_values(uses: DataFrame, values: DataFrame) -> DataFrame:
    """``macro, a, b`` uses as difference, absolute difference or ratio of two keyed numbers; null ratio by zero."""
    one = values.select(F.col("key").alias("a"), F.col("number").alias("x"))
    two = values.select(F.col("key").alias("b"), F.col("number").alias("y"))
    both = uses.join(one, "a", "left").join(two, "b", "left")
    found = (
        F.when(F.col("macro") == "diff", F.col("x") - F.col("y"))
        .when(F.col("macro") == "absdiff", F.abs(F.col("x") - F.col("y")))
        .when(F.col("macro") == "ratio", F.try_divide("x", "y"))
    )
    return both.select("macro", "a", "b", found.alias("number"))
