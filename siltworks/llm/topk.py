"""Exact search for the largest inner products: a k-d tree over each shard, searched best first.

A shard is cut at the median of its widest dimension until a leaf is small; each leaf is a row with its vectors and its
tight box. A query's bound at a box is the largest inner product any point of the box could have. Each query first asks
one shard; the k-th result it finds there goes with it to all other shards, where whole boxes fall below it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltworks.llm.scale import scratch_table
from siltworks.llm.vectors import finite_rows
from siltworks.ship import ship_code

#: Vectors in a leaf, bytes of a shard's vectors (four a component), of a block of queries, and of the queries that meet a shard at once.
LEAF, SHARD_BYTES, BLOCK_BYTES, WAVE_BYTES = 256, 1 << 25, 1 << 20, 1 << 25
#: Integers beyond this are limited to it.
LIMIT = (1 << 31) - 1

LEAVES = "dims int, shard int, place int, ids binary, vectors binary, low binary, high binary"
FOUND = "query_id bigint, q bigint, vec_id bigint, score bigint, theirs bigint"


def _cuts(n: int, leaf: int) -> list[tuple[int, int]]:
    """The nodes of a tree over ``n`` rows, as ranges of rows, parents first: halves until a leaf is small enough."""
    nodes, at = [(0, n)], 0
    while at < len(nodes):
        lo, hi = nodes[at]
        if hi - lo > leaf:
            mid = lo + (hi - lo) // 2
            nodes += [(lo, mid), (mid, hi)]
        at += 1
    return nodes


def _ordered(ids: np.ndarray, vectors: np.ndarray, leaf: int) -> np.ndarray:
    """Rows in the order of the tree: each node's rows are cut at the median of the dimension in which they spread most.

    Equal values go by id, so that equal vectors fill leaves in order of id and all but the first can be ruled out.
    """
    rows = np.arange(len(ids))
    for lo, hi in _cuts(len(ids), leaf):
        if hi - lo > leaf:
            own = rows[lo:hi]
            some = vectors[own]
            widest = int(np.argmax(some.max(0).astype(np.int64) - some.min(0))) if some.shape[1] else 0
            value = some[:, widest] if some.shape[1] else np.zeros(len(own))
            rows[lo:hi] = own[np.lexsort((ids[own], value))]
    return rows


def _tree_of(leaf: int):
    """A shard's rows to its leaves."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        dims, shard = key[0].as_py(), key[1].as_py()
        rows = rows.combine_chunks()
        ids = rows.column("k").to_numpy()
        vectors = rows.column("v").combine_chunks().flatten().to_numpy().astype(np.int32).reshape(len(ids), dims)
        order = _ordered(ids, vectors, leaf)
        ids, vectors = ids[order], vectors[order]
        parts = sorted(p for p in _cuts(len(ids), leaf) if p[1] - p[0] <= leaf)
        cut = [(ids[lo:hi], vectors[lo:hi]) for lo, hi in parts]
        names = [
            pa.array([dims] * len(cut), pa.int32()), pa.array([shard] * len(cut), pa.int32()), pa.array([lo for lo, _ in parts], pa.int32()),
            pa.array([i.tobytes() for i, _ in cut], pa.binary()), pa.array([v.tobytes() for _, v in cut], pa.binary()),
            pa.array([v.min(0).tobytes() for _, v in cut], pa.binary()), pa.array([v.max(0).tobytes() for _, v in cut], pa.binary()),
        ]
        return pa.table(names, names=["dims", "shard", "place", "ids", "vectors", "low", "high"])

    return build


class Tree:
    """One shard's tree, put together from its leaves. Integers as doubles where every sum of products stays exact."""

    def __init__(self, leaves: pa.Table, dims: int, leaf: int):
        leaves = leaves.sort_by("place")
        read = lambda name, kind: np.frombuffer(b"".join(leaves.column(name).to_pylist()), kind)
        self.ids = read("ids", np.int64)
        self.vectors = read("vectors", np.int32).reshape(len(self.ids), dims)
        low, high = (read(name, np.int32).reshape(len(leaves), dims) for name in ("low", "high"))
        self.nodes = _cuts(len(self.ids), leaf)
        at = {lo: k for k, lo in enumerate(leaves.column("place").to_pylist())}
        n = len(self.nodes)
        self.low, self.high, self.least = np.empty((n, dims), np.int32), np.empty((n, dims), np.int32), np.empty(n, np.int64)
        self.child = [-1] * n
        free = 1
        for k, (lo, hi) in enumerate(self.nodes):
            if hi - lo > leaf:
                self.child[k] = free
                free += 2
        for k in range(n - 1, -1, -1):  # boxes from the leaves up
            lo, hi = self.nodes[k]
            if self.child[k] < 0:
                self.low[k], self.high[k], self.least[k] = low[at[lo]], high[at[lo]], self.ids[lo:hi].min()
            else:
                pair = slice(self.child[k], self.child[k] + 2)
                self.low[k], self.high[k], self.least[k] = self.low[pair].min(0), self.high[pair].max(0), self.least[pair].min()
        self.most = int(np.abs(self.vectors.astype(np.int64)).max(initial=0))

    def exact_type(self, queries: np.ndarray) -> type:
        """The fastest type in which an inner product with these queries is exact."""
        bound = self.most * int(np.abs(queries).max(initial=0)) * max(1, queries.shape[1])
        return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, told: list[tuple[int, int] | None]) -> Iterator[list[tuple[int, int]]]:
        """For each query the ``k`` best of this shard as ``(-score, id)``, those that its told k-th result leaves a chance.

        Nodes wait in a heap by bound, then least id. The search ends at the first node that cannot hold anything better
        than the k-th result, as none behind it can.
        """
        kind = self.exact_type(queries)
        vectors, queries = self.vectors.astype(kind), queries.astype(kind)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        bounds = up @ self.high.astype(kind).T + down @ self.low.astype(kind).T
        for i, q in enumerate(queries):
            kth, best = told[i], []
            heap = [(-int(bounds[i, 0]), int(self.least[0]), 0)]
            while heap:
                bound, least, node = heapq.heappop(heap)
                if kth is not None and (bound, least) > kth:
                    break
                child = self.child[node]
                if child >= 0:
                    for c in (child, child + 1):
                        heapq.heappush(heap, (-int(bounds[i, c]), int(self.least[c]), c))
                    continue
                lo, hi = self.nodes[node]
                scores, ids = vectors[lo:hi] @ q, self.ids[lo:hi]
                fit = ids != own[i]
                if kth is not None:
                    fit &= scores >= -kth[0]
                near = np.flatnonzero(fit)
                if not len(near):
                    continue
                if len(near) > k:
                    near = near[np.lexsort((ids[near], -scores[near]))[:k]]
                best = sorted(best + [(-int(s), int(x)) for s, x in zip(scores[near], ids[near], strict=True)])[:k]
                if len(best) == k and (kth is None or best[-1] < kth):
                    kth = best[-1]
            yield [b for b in best if told[i] is None or b <= told[i]]


def _search(k: int, leaf: int):
    """A shard's leaves and the query blocks that meet it, to results. ``theirs`` is the shard that a result comes from."""

    def run(key: tuple, leaves: pa.Table, blocks: pa.Table) -> pa.Table:
        dims, shard = key[0].as_py(), key[1].as_py()
        out: list[tuple] = []
        if len(leaves) and len(blocks):
            tree = Tree(leaves, dims, leaf)
            for block in blocks.column("asked"):
                rows = block.values
                own, q = rows.field("query_id").to_numpy(), rows.field("q").to_numpy()
                vectors = rows.field("v").flatten().to_numpy().astype(np.int64).reshape(len(own), dims)
                told = [None if s is None else (-s, i) for s, i in zip(rows.field("kth").to_pylist(), rows.field("kth_id").to_pylist(), strict=True)]
                for at, found in enumerate(tree.search(own, vectors, k, told)):
                    out += [(own[at], q[at], i, max(-(1 << 63), min((1 << 63) - 1, -s)), shard) for s, i in found]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.table([pa.array(np.array(c, np.int64)) for c in columns], names=["query_id", "q", "vec_id", "score", "theirs"])

    return run


def _asked(queries: DataFrame, blocks: int, waves: int, shards: int, home: bool) -> DataFrame:
    """Query rows in blocks, one for each shard that they ask: their home, or all others."""
    block = F.pmod(F.xxhash64("query_id", "q"), F.lit(blocks)).cast("int")
    rows = F.collect_list(F.struct("query_id", "q", "v", "kth", "kth_id")).alias("asked")
    packed = queries.withColumn("block", block).groupBy("dims", "block", "home").agg(rows)
    every = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s.cast("int"))
    to = F.array("home") if home else F.filter(every, lambda s: s != F.col("home"))
    return packed.select("dims", F.explode(to).alias("shard"), F.pmod("block", F.lit(waves)).alias("wave"), "asked")


def top_inner_products(queries: DataFrame, reference: DataFrame, k: int = 5, leaf: int = LEAF, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the ``k`` rows of the largest integer inner product, exactly.

    Both tables have ``k`` (long) and ``v`` (array of int), as ``integer_vectors`` makes them. A query meets vectors of its
    own length only, never rows of its own id; ties go to the smaller id, and rows that repeat are rows each. A query that
    repeats with the same vector is asked once; one id with two vectors asks twice. Null ids take no part. Fewer than
    ``k`` rows come where fewer are eligible, none for a query without any.

    Rows are dealt to shards by a hash of their number, never by value, so that equal vectors or ids do not meet in one.
    A shard has ``shard_bytes`` of vectors; a task holds one shard and at most ``WAVE_BYTES`` of queries.
    """
    spark = reference.sparkSession
    ship_code(spark)
    rows = reference.where("k IS NOT NULL").select("k", "v", F.size("v").alias("dims"), F.monotonically_increasing_id().alias("row"))
    rows = scratch_table(rows, "search-rows")
    asked = queries.where("k IS NOT NULL").select(F.col("k").alias("query_id"), "v").distinct()
    asked = scratch_table(asked.select("query_id", F.xxhash64("v").alias("q"), F.size("v").alias("dims"), "v"), "search-queries")
    size = lambda df: 4 * (df.agg(F.sum(F.col("dims") + 4).alias("n")).first()["n"] or 0)
    n_bytes, q_bytes = size(rows), size(asked)
    shards = max(spark.sparkContext.defaultParallelism, -(-n_bytes // shard_bytes))
    blocks, waves = -(-q_bytes // BLOCK_BYTES) or 1, -(-q_bytes // WAVE_BYTES) or 1

    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")
    leaves = scratch_table(rows.select("k", "v", "dims", shard).groupBy("dims", "shard").applyInArrow(_tree_of(leaf), LEAVES), "search-trees")
    asked = asked.withColumn("home", F.pmod(F.xxhash64("q", "query_id", F.lit(1)), F.lit(shards)).cast("int"))
    every = leaves.withColumn("wave", F.explode(F.sequence(F.lit(0), F.lit(waves - 1)))).groupBy("dims", "shard", "wave")

    def meet(ask: DataFrame, home: bool) -> DataFrame:
        blocks_of = _asked(ask, blocks, waves, shards, home).groupBy("dims", "shard", "wave")
        return every.cogroup(blocks_of).applyInArrow(_search(k, leaf), FOUND)

    none = asked.withColumns({"kth": F.lit(None).cast("bigint"), "kth_id": F.lit(None).cast("bigint")})
    first = scratch_table(meet(none, True), "search-home")
    line = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("at", F.row_number().over(line)).where(F.col("at") == k)
    kth = kth.select("query_id", "q", F.col("score").alias("kth"), F.col("vec_id").alias("kth_id"))
    found = first
    if shards > 1:
        found = found.unionByName(meet(asked.join(kth, ["query_id", "q"], "left"), False))
    best = found.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """``k, v``: ``floor(scale * x)`` of each component as integers, limited to 31 bits.

    Null vectors, and those with a null or non-finite component, are left out.
    """
    whole = F.transform("v", lambda x: F.greatest(F.least(F.floor(F.lit(float(scale)) * x), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    return finite_rows(df, key, vector).select("k", whole.alias("v"))


def search_report(df: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """``top_inner_products`` of the rows whose ``vec_id`` is divisible by ``every`` against all rows of ``df``.

    Vectors null or with null or non-finite components neither ask nor answer; see there for ties, repeats, null ids and
    lengths. Components beyond 31 bits after scaling are limited to them, scores beyond 63 bits to those. An empty table
    gives no rows. Other columns are left out.
    """
    rows = scratch_table(integer_vectors(df, "vec_id", "embedding"), "integer-vectors")
    return top_inner_products(rows.where(F.col("k") % every == 0), rows, k)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
