"""The leakage-safe split: provenance, duplicates of test items, components, audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.hashing import seeded_bucket
from siltworks.operators.graph import component_stars
from siltworks.operators.skew import attach_by_key
from siltworks.scratch import scratch_table

SPLITS = ("train", "val", "test", "drop", "filtered")


def group_edges(items: DataFrame) -> DataFrame:
    """Star edges that join the items of each group to its least member; a group may be of any size."""
    first = items.groupBy("group").agg(F.min("idx").alias("root"), F.count(F.lit(1)).alias("n"))
    first = scratch_table(first.where("n > 1 AND group IS NOT NULL"), "group-roots")
    out = attach_by_key(items.select("idx", "group"), first, "group", "n", max(1, items.count()))
    return out.where("root IS NOT NULL AND idx <> root").select(F.col("root").alias("a"), F.col("idx").alias("b"))


def reached_from(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Items connected to a seed over edges, seeds included: the components that hold a seed."""
    stars = component_stars(edges).select(F.col("vertex").alias("idx"), "root")
    ends = stars.unionByName(stars.select(F.col("root").alias("idx"), "root")).distinct()
    hit = ends.join(seeds.select("idx"), "idx", "left_semi").select("root").distinct()
    return ends.join(hit, "root", "left_semi").select("idx").unionByName(seeds.select("idx")).distinct()


def _joined_roots(items: DataFrame, roots: DataFrame) -> DataFrame:
    """``idx, root`` for all items when groups join what ``roots(idx, root)`` holds together already.

    Components are contracted to their least member first, so that groups are joined on a smaller graph.
    """
    held = scratch_table(items.select("idx", "group").join(roots, "idx", "left").withColumn("root", F.coalesce("root", "idx")), "contracted")
    ends = held.where("group IS NOT NULL").select("group", F.col("root").alias("idx")).distinct()
    stars = component_stars(group_edges(ends)).select(F.col("vertex").alias("root"), F.col("root").alias("top"))
    stars = scratch_table(stars, "joined-roots")
    sizes = held.groupBy("root").agg(F.count(F.lit(1)).alias("n")).join(stars, "root")
    out = attach_by_key(held, scratch_table(sizes, "joined-sizes"), "root", "n", max(1, held.count()))
    return out.select("idx", F.coalesce("top", "root").alias("root"))


def assign_splits(items: DataFrame, edges: DataFrame, val_fraction: float, seed: int) -> DataFrame:
    """``items(idx, item_id, group, role, active)`` with ``split, reason, component``; ``edges(a, b)`` of indices.

    In order: inactive items are filtered; active test items are test; other items of a group that holds one are
    dropped; items that duplicate one, over any number of edges but never through groups, are dropped; the
    rest goes by component (shared groups and edges among the rest) to validation or training, by a hash of
    the component's least item. ``component`` is over all active items, groups and edges; -1 when inactive.

    Duplicate components (``duplicate_root``, null when inactive) are found once; they say what a test item reaches,
    and groups join them on the contracted graph. Only those that lose a member to a test group are found anew.
    """
    items = scratch_table(items, "split-items")
    n_items = max(1, items.count())
    on = items.where("active")
    ends = edges.select("a", "b").where("a <> b")
    live = ends.join(on.select(F.col("idx").alias("a")), "a", "left_semi").join(on.select(F.col("idx").alias("b")), "b", "left_semi")
    live = scratch_table(live.distinct(), "split-edges")
    stars = component_stars(live).select(F.col("vertex").alias("idx"), "root")
    copies = scratch_table(stars.unionByName(stars.select(F.col("root").alias("idx"), "root").distinct()), "duplicate-roots")

    groups = on.groupBy("group").agg(F.bool_or(F.col("role") == "test").alias("test_group"), F.count(F.lit(1)).alias("n"))
    groups = scratch_table(groups.where("test_group AND group IS NOT NULL"), "test-groups")
    marked = attach_by_key(items, groups, "group", "n", n_items).drop("n")
    marked = scratch_table(marked.join(copies.withColumnRenamed("root", "duplicate_root"), "idx", "left"), "split-groups")
    per = marked.where("active AND duplicate_root IS NOT NULL").groupBy("duplicate_root").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("role") == "test").alias("reached"), F.bool_or(F.coalesce("test_group", F.lit(False))).alias("thinned")
    )
    per = scratch_table(per.where("reached OR thinned"), "touched-duplicates")
    marked = attach_by_key(marked, per, "duplicate_root", "n", n_items).drop("n")
    first = (
        F.when(~F.col("active"), "filtered")
        .when(F.col("role") == "test", "test")
        .when(F.col("test_group"), "drop")
        .when(F.col("reached"), "drop")
    )
    reason = F.when(first == "drop", F.when(F.col("test_group"), "test_group").otherwise("test_duplicate"))
    marked = scratch_table(marked.withColumn("split", first).withColumn("reason", reason), "split-marked")

    rest = marked.where("split IS NULL")
    thinned = rest.where("thinned").select("idx")
    inner = live.join(thinned.withColumnRenamed("idx", "a"), "a", "left_semi").join(thinned.withColumnRenamed("idx", "b"), "b", "left_semi")
    anew = component_stars(inner).select(F.col("vertex").alias("idx"), "root")
    whole = rest.where("duplicate_root IS NOT NULL AND NOT coalesce(thinned, false)").select("idx", F.col("duplicate_root").alias("root"))
    roots = _joined_roots(rest, whole.unionByName(anew))
    names = rest.select(F.col("idx").alias("root"), F.col("item_id").alias("root_id"))
    sizes = scratch_table(roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")).join(names, "root"), "split-roots")
    roots = attach_by_key(scratch_table(roots, "split-members"), sizes, "root", "n", n_items)
    side = F.when(seeded_bucket(F.col("root_id"), seed) / 10_000 < val_fraction, "val").otherwise("train")
    roots = roots.select("idx", F.col("root").alias("split_root"), side.alias("side"))
    components = _joined_roots(on, copies).withColumnRenamed("root", "component")
    out = marked.join(roots, "idx", "left").join(components, "idx", "left")
    out = out.select(
        *items.columns,
        F.coalesce("split", "side").alias("split"),
        "reason",
        F.coalesce("component", F.lit(-1)).cast("long").alias("component"),
        "split_root",
        F.when(F.col("active"), F.coalesce("duplicate_root", "idx")).alias("duplicate_root"),
    )
    return scratch_table(out, "split")


def split_report(done: DataFrame) -> DataFrame:
    """One row of counts: items, splits, drops by reason, largest duplicate cluster and component."""
    clusters = done.where("active").groupBy("duplicate_root").agg(F.count(F.lit(1)).alias("n"))
    largest = clusters.agg(F.max("n").alias("largest_duplicate_cluster"))
    rest = done.where("split_root IS NOT NULL").groupBy("split_root").agg(F.count(F.lit(1)).alias("n"))
    rest = rest.agg(F.count(F.lit(1)).alias("trainval_components"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_trainval_component"))
    counts = done.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if("active").alias("active"),
        *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in SPLITS],
        F.count_if(F.col("reason") == "test_group").alias("dropped_test_group"),
        F.count_if(F.col("reason") == "test_duplicate").alias("dropped_test_duplicate"),
    )
    return counts.join(F.broadcast(largest)).join(F.broadcast(rest))  # single rows


def split_and_audit(
    items: DataFrame,
    edges: DataFrame,
    audit: Callable[[DataFrame], DataFrame],
    val_fraction: float,
    seed: int,
    rounds: int = 3,
) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Split, audit, and while the audit finds duplicates across splits add them as edges and split again.

    ``audit`` turns a split table into ``a, b`` violations. Returns the split, the last violations, the edges and
    the rounds taken. After the last round violations are added but not split again: callers look at them.
    """
    edges = scratch_table(edges.select("a", "b"), "audit-edges")
    taken = 0
    for taken in range(1, rounds + 1):
        done = scratch_table(assign_splits(items, edges, val_fraction, seed), "audited-split")
        found = scratch_table(audit(done).select("a", "b"), "violations")
        if not found.limit(1).count():
            break
        edges = scratch_table(edges.unionByName(found).distinct(), "audit-edges")
    return done, found, edges, taken


def crossing(done: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs between validation and training, or between test and either."""
    side = done.select("idx", "split")
    both = pairs.join(side.select(F.col("idx").alias("a"), F.col("split").alias("sa")), "a")
    both = both.join(side.select(F.col("idx").alias("b"), F.col("split").alias("sb")), "b")
    return both.where("sa <> sb AND sa IN ('train', 'val', 'test') AND sb IN ('train', 'val', 'test')")


def dataset_card(registry: DataFrame, done: DataFrame, key: str = "source") -> DataFrame:
    """Items and splits of every registered source, empty ones included."""
    counts = done.groupBy(key).agg(
        F.count(F.lit(1)).alias("items"), *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in SPLITS]
    )
    return registry.join(counts, key, "left").na.fill(0)
