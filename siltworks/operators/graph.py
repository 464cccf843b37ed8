"""Graph operators over vertex and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.operators.skew import attach_by_key
from siltworks.scratch import drop_scratch, scratch_mark, scratch_table

MAX_ROUNDS = 60


def _settled(edges: DataFrame) -> bool:
    """Whether distinct (hi, lo) edges are stars already: every vertex has one edge down, or some up, never both."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("hi").alias("v"), F.lit(1).alias("down")), F.struct(F.col("lo").alias("v"), F.lit(0).alias("down")))).alias("e"))
    per = ends.groupBy("e.v").agg(F.sum("e.down").alias("down"), F.max(1 - F.col("e.down")).alias("up"))
    return not per.where("down > 1 OR (down = 1 AND up = 1)").limit(1).count()


def _least_neighbour(pairs: DataFrame, n: int) -> DataFrame:
    """``hi, lo`` pairs with ``m``, the least ``lo`` of their ``hi``; a vertex may have any number of pairs."""
    least = scratch_table(pairs.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("deg")), "least")
    return attach_by_key(pairs, least, "hi", "deg", n)


def component_stars(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``(vertex, root)`` for every vertex of an edge but the roots; a root is the least vertex of its component.

    Alternating large-star and small-star steps over (hi, lo) edges, each a pre-aggregated minimum and a
    join that a vertex with many edges does not skew. Every step is a table in the shared folder. Rounds grow
    with the logarithm of the vertices; the loop ends when the edges are stars, which those of groups are from the
    start, and raises if ``max_rounds`` pass first. Null ends and self-edges are ignored; repeated edges count once.
    """
    mark = scratch_mark()
    ends = edges.select(F.col(a).alias("__a"), F.col(b).alias("__b")).where("__a <> __b")
    now = ends.select(F.greatest("__a", "__b").alias("hi"), F.least("__a", "__b").alias("lo")).distinct()
    now = scratch_table(now, "edges")
    for _ in range(max_rounds):
        if _settled(now):
            break
        n = now.count()
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        large = _least_neighbour(both, 2 * n).where("lo > hi")
        large = large.select(F.col("lo").alias("hi"), F.least("m", "hi").alias("lo")).where("hi <> lo").distinct()
        large = scratch_table(large, "large-star")
        small = _least_neighbour(large, n)
        small = small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").unionByName(
            small.select("hi", F.col("m").alias("lo"))
        )
        now = scratch_table(small.distinct(), "small-star")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    drop_scratch(edges.sparkSession, mark)
    return now.select(F.col("hi").alias("vertex"), F.col("lo").alias("root"))
