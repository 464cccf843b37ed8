"""Near-duplicate classes by bottom-k sketches of word shingles.

One hash function orders all shingles; a document's sketch is its ``SKETCH`` smallest hash values. Inverted
lists of the ``LISTED`` smallest generate pairs that share values, the sketch of the pair's union estimates
their similarity, and full shingle sets confirm each link that is used. Equal sets are one vertex throughout.
Members of a list meet one of them first; only those that this leaves in different components are paired.

A value that very many sets retain (a common passage, a large group of near copies) has a *hot* list, which is
never paired out. Its members meet instead under pairs of hot values, which leaves lists of a common passage
short. Lists that are still hot are near copies of one text: their members are compared with the
list's hub, the member whose sketch holds the group's commonest values. Links that join components are all that
matters there. What then is outside its list's largest component is settled exactly: a prefix filter over the
shingles that it shares with other components finds those that could still be linked to it, and each large one is
asked through one pivot, whose distances leave out all members that cannot be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.llm.scale import (
    attach_by_key, bound_batches, drop_scratch, filter_bits, may_repeat, repeat_filter, scratch_mark, scratch_table,
)
from siltworks.operators.graph import component_stars

#: Values of a sketch, and those of them that enter inverted lists.
SKETCH, LISTED = 128, 16
#: Lists up to this length are paired out between components.
SHORT = 32
#: Lowest hot values that form keys of two, and keys under which a set of a hot list meets hubs.
HOT_VALUES, HOT_KEYS = 12, 4
#: Hot values that each one forms keys with.
NEXT = 3
#: Listed values that a pair must share: of 16, a pair at 0.8 shares fewer with a chance below 1e-6.
SHARED = 4
#: Components that share a shingle beyond which it is split among keys.
CROWD = 1_000
#: Standard errors below the threshold at which an estimate still goes to the exact check. See the README for what that loses.
MARGIN = 6
#: Bits of the parity of a set, which bounds from below by how many shingles two sets differ.
PARITY = 1_024

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class _WordHash(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingle_hashes(text: str | None, size: int, known: _WordHash) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; A-Z lower-cased, words split at ASCII white space.

    With fewer words than ``size`` the whole sequence is the one shingle; without words there is none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.int64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    with np.errstate(over="ignore"):
        mixed = np.full(len(words) - width + 1, np.uint64(width))
        for i in range(width):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[i % 4] + hashes[i : len(words) - width + 1 + i]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX[0]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[1]
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed.view(np.int64))


SKETCHES = T.StructType(
    [
        T.StructField("n", T.LongType(), False),
        T.StructField("digest", T.BinaryType(), True),
        T.StructField("sketch", T.ArrayType(T.LongType(), False), False),
    ]
)


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHash()
        for batch in batches:
            counts, digests, kept = [], [], []
            for text in batch.column(1):
                found = shingle_hashes(text.as_py(), size, known)
                counts.append(len(found))
                digests.append(xxhash.xxh128_digest(found.tobytes()) if len(found) else None)
                kept.append(found[:SKETCH])
            ends = np.cumsum([0, *map(len, kept)]).astype(np.int32)
            values = np.concatenate(kept) if kept else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(counts, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64())),
                ],
                names=["doc_id", "text_hash", *SKETCHES.names],
            )

    return run


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHash()
        for batch in batches:
            for text in batch.column(0):
                found = shingle_hashes(text.as_py(), size, known)
                if len(found):
                    digest = pa.array([xxhash.xxh128_digest(found.tobytes())], pa.binary())
                    yield pa.RecordBatch.from_arrays([digest, _one_list(found), _one_list(_parity(found))], names=["digest", "hashes", "parity"])

    return run


def _parity(found: np.ndarray) -> np.ndarray:
    """For each of ``PARITY`` buckets of hashes whether it holds an odd number of them, packed in 64-bit numbers.

    Common values cancel out between two sets: buckets whose parities differ hold a value of only one of them at least.
    """
    odd = np.bincount(found & (PARITY - 1), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _one_list(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.int64()))


def _similar(num: int, den: int):
    """Pairs whose full sets overlap by ``num / den`` of their union or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = a.values.to_numpy(), b.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _likely(least: float):
    """Pairs whose union sketch, the ``SKETCH`` smallest values of both, holds a share ``least`` of common ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = a.values.to_numpy(), b.values.to_numpy()
                both = np.sort(np.concatenate([x, y]))
                twice = both[1:] == both[:-1]
                room = min(SKETCH, len(both) - int(twice.sum()))
                # A common value is among the smallest of the union if no more than room values come first.
                firsts = np.cumsum(np.concatenate([[True], ~twice]))[1:]
                keep.append(int((twice & (firsts <= room)).sum()) >= least * room)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


PAIRS = "a bigint, b bigint"


class _Search:
    """The state of one search: the distinct sets, numbered, and how to confirm pairs of them."""

    def __init__(self, docs: DataFrame, size: int, num: int, den: int):
        bound_batches(docs.sparkSession)
        self.docs, self.size, self.num, self.den = docs, size, num, den
        self.rows = scratch_table(
            docs.mapInArrow(_sketches(size), T.StructType([docs.schema["doc_id"], docs.schema["text_hash"], *SKETCHES.fields])), "sketches"
        )
        sets = self.rows.where("digest IS NOT NULL").groupBy("digest").agg(
            F.min("doc_id").alias("rep_id"),
            F.min(F.struct("doc_id", "text_hash")).alias("place"),
            F.count(F.lit(1)).alias("n_rows"),
            F.first("n").alias("n"),
            F.first("sketch").alias("sketch"),
        )
        # The numbers are fixed once the table is written.
        sets = sets.withColumns({"v": F.monotonically_increasing_id(), "low": F.slice("sketch", 1, LISTED)})
        self.sets = scratch_table(sets, "sets")
        self.n_sets = self.sets.select("n").count()

    def ends(self, pairs: DataFrame, column: str) -> DataFrame:
        """``column`` of both ends of the pairs ``a, b``, as ``x`` and ``y``."""
        side = self.sets.select("v", column)
        out = pairs.join(side.select(F.col("v").alias("a"), F.col(column).alias("x")), "a")
        return out.join(side.select(F.col("v").alias("b"), F.col(column).alias("y")), "b").select("a", "b", "x", "y")

    def sizes_fit(self, x: str, y: str) -> Column:
        return self.den * F.least(x, y) >= self.num * F.greatest(x, y)

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs that share enough of their lowest values."""
        both = self.ends(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "low")
        least = F.least(F.lit(SHARED), F.size("x"), F.size("y"))
        return both.where(F.size(F.array_intersect("x", "y")) >= least).select("a", "b")

    def with_hub(self, members: DataFrame) -> DataFrame:
        """Members of short lists with their list's ``hub``, the member of the least number."""
        return members.withColumn("hub", F.min(F.struct("v", "n")).over(Window.partitionBy("key")))

    def hub_pairs(self, members: DataFrame) -> DataFrame:
        """Each member of a short list with its hub, if their sizes fit."""
        met = members.where((F.col("v") != F.col("hub.v")) & self.sizes_fit("n", "hub.n"))
        return met.select(F.col("v").alias("a"), F.col("hub.v").alias("b"))

    def paired(self, members: DataFrame, stars: DataFrame) -> DataFrame:
        """Pairs of members of one short list that ``stars`` leave in different components, if their sizes fit.

        A list that lies in one component has none, however long; pairs with the hub were looked at before.
        """
        rooted = members.join(stars.select(F.col("vertex").alias("v"), "root"), "v", "left").withColumn("root", F.coalesce("root", "v"))
        parts = Window.partitionBy("key")
        rooted = rooted.withColumns({"first": F.min("root").over(parts), "last": F.max("root").over(parts)}).where("first <> last")
        rooted = scratch_table(rooted.select("key", "v", "n", "root", (F.col("v") == F.col("hub.v")).alias("is_hub")).where("NOT is_hub"), "open-short")
        a = rooted.select("key", F.col("v").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
        b = rooted.select("key", F.col("v").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
        return a.join(b, "key").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & self.sizes_fit("na", "nb")).select("a", "b")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are linked: first by union sketch, then by full sets."""
        mark = scratch_mark()
        deviation = (self.num / self.den * (1 - self.num / self.den) / SKETCH) ** 0.5
        least = self.num / self.den - MARGIN * deviation
        likely = scratch_table(self.ends(pairs, "sketch").mapInArrow(_likely(least), PAIRS), "likely")
        involved = likely.select(F.col("a").alias("v")).unionByName(likely.select(F.col("b").alias("v"))).distinct()
        full = scratch_table(self.full_sets(scratch_table(involved, "involved")), "full-sets")
        both = likely.join(full.select(F.col("v").alias("a"), F.col("hashes").alias("x")), "a")
        both = both.join(full.select(F.col("v").alias("b"), F.col("hashes").alias("y")), "b")
        out = both.select("a", "b", "x", "y").mapInArrow(_similar(self.num, self.den), PAIRS)
        out = scratch_table(out, "confirmed")
        drop_scratch(self.docs.sparkSession, mark)
        return out

    def full_sets(self, involved: DataFrame) -> DataFrame:
        """Whole shingle sets of some vertices, from the text of one document each, with their parities.

        Documents are told by id and text, so that rows without an id, or with one that repeats, are found like others.
        A Bloom filter of the wanted ones (bounded) is broadcast, so that only texts it lets through shuffle.
        """
        wanted = self.sets.join(involved, "v", "left_semi").select("v", "digest", "place.doc_id", "place.text_hash")
        wanted = scratch_table(wanted, "wanted")
        bits = filter_bits(max(1, wanted.count()))
        blocks = scratch_table(repeat_filter(wanted.select(F.xxhash64("doc_id", "text_hash").alias("h")), "h", bits, 1), "wanted-bits")
        some = may_repeat(self.docs.withColumn("__h", F.xxhash64("doc_id", "text_hash")), "__h", blocks, bits, "__in").where("__in")
        same = F.expr("s.text_hash = w.text_hash AND s.doc_id <=> w.doc_id")
        texts = some.select("doc_id", "text", "text_hash").alias("s").join(wanted.alias("w"), same, "left_semi").select("text")
        sets = texts.mapInArrow(_full_sets(self.size), "digest binary, hashes array<bigint>, parity array<bigint>").dropDuplicates(["digest"])
        return sets.join(wanted.select("v", "digest"), "digest").select("v", "hashes", "parity")


def _by_length(members: DataFrame, key: str, n_rows: int) -> DataFrame:
    """Members of lists of two or more, with the length ``f`` of their list."""
    lengths = scratch_table(members.groupBy(key).agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "lengths")
    return scratch_table(attach_by_key(members, lengths, key, "f", n_rows).where("f IS NOT NULL"), "listed")


def _hot_members(search: _Search, listed: DataFrame) -> DataFrame:
    """Sets of hot lists, with their hot values in order and how common their sketch values are.

    Other listed values do not excuse a set from this search, however many: in a crowd that shares one text they
    are the set's own, and no similar set has them. A key takes two hot values: of 16 listed values fewer than
    two are common to a pair at 0.8 with a chance below 1e-9 (if none but hot ones are common; any other pairs them out).
    """
    hot = listed.where(F.col("f") > SHORT).groupBy("v").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("value")).alias("hot"))
    hot = scratch_table(hot.where(F.size("hot") > 1), "hot-sets")
    sketches = scratch_table(hot.select("v").join(search.sets.select("v", "sketch"), "v"), "hot-sketches")
    weight = _weights(sketches, max(1, hot.count()))
    return scratch_table(hot.join(weight, "v"), "hot-weights")


def _weights(sketches: DataFrame, n_sets: int) -> DataFrame:
    """``v, weight``: the sum of the logarithms of how many of the sets ``v, sketch`` retain each value of a sketch.

    Values that more than a 4096th of all retained ones equal number at most 4,096: they are summed inside each row, and only
    others become rows. A value of ``SHORT`` sets or fewer is the set's own and weighs nothing.
    """
    every = sketches.select(F.explode("sketch").alias("value"))
    common = scratch_table(every.groupBy("value").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") > SHORT), "common")
    cut = max(512, n_sets * SKETCH // 4096)
    top = common.where(F.col("f") > cut).orderBy("value").collect()
    values, logs = np.array([r["value"] for r in top], np.int64), np.log(np.array([r["f"] for r in top], float))
    summed = scratch_table(sketches.mapInArrow(_top_weight(values, logs), "v bigint, weight double, others array<bigint>"), "top-weights")
    rest = summed.select("v", F.explode("others").alias("value")).join(common.where(F.col("f") <= cut), "value")
    rest = rest.groupBy("v").agg(F.sum(F.log(F.col("f").cast("double"))).alias("more"))
    return summed.join(rest, "v", "left").select("v", (F.col("weight") + F.coalesce("more", F.lit(0.0))).alias("weight"))


def _top_weight(values: np.ndarray, logs: np.ndarray):
    """The sum of ``logs`` over the values of a sketch that are among the sorted ``values``, and the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights, others = [], []
            for sketch in batch.column(1):
                x = sketch.values.to_numpy()
                at = np.searchsorted(values, x)
                top = np.append(values, 0)[at] == x
                top &= at < len(values)
                weights.append(float(logs[at[top]].sum()))
                others.append(x[~top])
            ends = np.cumsum([0, *map(len, others)]).astype(np.int32)
            flat = np.concatenate(others) if others else np.empty(0, np.int64)
            columns = [batch.column(0), pa.array(weights, pa.float64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["v", "weight", "others"])

    return run


def _twos(hot: Column) -> Column:
    """Keys of each hot value with the next ``NEXT`` ones.

    Two similar sets hold two common hot values with fewer than ``NEXT`` of its own between them in either. At the
    threshold that fails most often where one set is part of the other and all values of its own are hot as well:
    README states the measured chance.
    """
    first = F.slice(hot, 1, HOT_VALUES)
    next_ones = F.transform(first, lambda x, i: F.transform(F.slice(first, i + 2, F.lit(NEXT)), lambda y: F.xxhash64(x, y)))
    return F.flatten(next_ones)


def near_duplicate_links(search: _Search) -> DataFrame:
    """Confirmed links ``a, b`` between distinct sets, enough to join every class.

    First every member of a list meets the list's hub. Near copies of one text are one component then, and only members of
    different components are still paired: a list has its square of pairs (of ``SHORT``) where nothing in it is alike.
    """
    values = search.sets.select("v", "n", F.explode("low").alias("value"))
    listed = _by_length(values, "value", LISTED * max(1, search.n_sets))
    hot = _hot_members(search, listed)
    keyed = hot.select("v", "n", F.explode(_twos(F.col("hot"))).alias("key"))
    keyed = _by_length(keyed, "key", max(1, hot.count()) * NEXT * HOT_VALUES)
    crowd = keyed.where(F.col("f") > SHORT).select("v", "n", "key")
    short = listed.where(F.col("f") <= SHORT).select(F.col("value").alias("key"), "v", "n")
    short = short.unionByName(keyed.where(F.col("f") <= SHORT).select("key", "v", "n"))
    short = scratch_table(search.with_hub(short), "short-lists")

    met = search.hub_pairs(short).unionByName(_hub_pairs(search, crowd, hot))
    links = search.confirmed(scratch_table(search.possible(met), "hub-pairs"))
    stars = scratch_table(component_stars(links), "hub-stars")
    links = links.unionByName(search.confirmed(scratch_table(search.possible(search.paired(short, stars)), "pairs")))
    members = _unsettled(crowd, links)
    if members.limit(1).count():
        links = links.unionByName(search.confirmed(_rest_pairs(search, members)))
    return links


def _hub_pairs(search: _Search, crowd: DataFrame, hot: DataFrame) -> DataFrame:
    """Each member of a hot list with the heaviest member of a few of its lists, if their sizes fit.

    A member takes the keys with the smallest hash, so that like members take the same ones.
    """
    few = crowd.groupBy("v").agg(F.first("n").alias("n"), F.slice(F.sort_array(F.collect_list("key")), 1, HOT_KEYS).alias("keys"))
    few = few.join(hot.select("v", "weight"), "v").select("v", "n", "weight", F.explode("keys").alias("key"))
    few = scratch_table(few, "crowd-keys")
    hubs = few.groupBy("key").agg(F.count(F.lit(1)).alias("f"), F.max(F.struct("weight", "v", "n")).alias("hub"))
    met = attach_by_key(few, scratch_table(hubs, "hubs"), "key", "f", max(1, few.count()))
    met = met.where((F.col("v") != F.col("hub.v")) & search.sizes_fit("n", "hub.n"))
    return met.select(F.col("v").alias("a"), F.col("hub.v").alias("b"))


def _unsettled(crowd: DataFrame, links: DataFrame) -> DataFrame:
    """``v, n, root, open`` for members of hot lists that span components; open ones are outside a list's largest."""
    stars = scratch_table(component_stars(links).withColumnRenamed("vertex", "v"), "crowd-stars")
    rooted = crowd.join(stars, "v", "left").withColumn("root", F.coalesce("root", "v"))
    rooted = scratch_table(rooted, "crowd")
    parts = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    lists = parts.groupBy("key").agg(F.sum("size").alias("f"), F.count(F.lit(1)).alias("n_parts"), F.max(F.struct("size", "root")).alias("top"))
    lists = scratch_table(lists.where("n_parts > 1").select("key", "f", F.col("top.root").alias("top")), "open-lists")
    rows = attach_by_key(rooted, lists, "key", "f", max(1, rooted.count())).where("f IS NOT NULL")
    members = rows.groupBy("v").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.max(F.col("root") != F.col("top")).alias("open"))
    return scratch_table(members, "members")


def _viable(search: _Search, sides: DataFrame) -> DataFrame:
    """``sides(v, n, root, open, hashes)`` that another component could be linked to, with ``hs``, ``c`` and ``least``.

    ``hs`` are a member's shingles that a member of another component has, those of few components first, ``c`` their
    number. A link takes ``num / den`` of the larger set: a member with fewer of them has none. So members that share a
    passage but not enough of it drop out before anything is joined.
    """
    every = sides.select("v", "root", F.explode("hashes").alias("h"))
    common = every.groupBy("h", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("h").agg(F.count(F.lit(1)).alias("f"), F.sum("m").alias("m"))
    common = scratch_table(common.where("f > 1"), "crowd-common")
    n = sides.agg(F.sum(F.size("hashes"))).first()[0] or 1
    shared = attach_by_key(every, common, "h", "m", n).where("f IS NOT NULL")
    found = shared.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("hs"))
    out = sides.join(found, "v").withColumns({"c": F.size("hs"), "least": F.ceil(F.lit(search.num) * F.col("n") / F.lit(search.den)).cast("int")})
    return scratch_table(out.where("c >= least"), "viable")


def _rest_pairs(search: _Search, members: DataFrame) -> DataFrame:
    """All pairs that could link an open member to a member of another component.

    Members first meet components, not each other. From its first shingle in common with a partner on, rarest first, an
    open member must hold ``num / (num + den)`` of both sizes, and the partner as many shared ones: a prefix of few
    shingles finds the components, in classes of like size, that have such partners. A component of one member is a
    pair. One of many is asked through its pivot: Jaccard distance is a metric, so only members whose distance from
    the pivot is within ``1 - num / den`` of the asking one's can be linked to it. Two families that overlap by less
    than a link are told apart by one comparison a member. Of members in reach those whose parities differ in more places
    than the sets of a link can are left out before pairs are made.
    """
    num, den = search.num, search.den
    bound = 1 - num / den
    full = scratch_table(search.full_sets(members.select("v")).join(members, "v"), "crowd-sets")
    sides = _viable(search, _viable(search, full).select(*full.columns))
    sides = sides.withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.05))).cast("int"))
    bands = sides.groupBy("root", "band").agg(
        F.count(F.lit(1)).alias("m"), F.min("v").alias("only"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("c").alias("most")
    )
    bands = scratch_table(bands, "bands")
    # A shingle of very many components is split: askers are dealt to parts, what they meet is in each part.
    parts = F.floor(F.col("s.f") / CROWD).cast("int")
    told = sides.select("root", "band", F.explode("hs").alias("s")).select("root", "band", F.col("s.h").alias("h"), parts.alias("parts")).distinct()
    told = told.withColumnRenamed("root", "of").join(bands.withColumnRenamed("root", "of"), ["of", "band"])
    told = told.withColumn("part", F.explode(F.sequence(F.lit(0), "parts"))).drop("parts")
    asked = sides.where("open").select(
        F.col("v").alias("x"), F.col("n").alias("nx"), F.col("root").alias("rx"), "c", F.expr("posexplode(slice(hs, 1, c - least + 1)) AS (i, s)")
    )
    part = F.pmod(F.xxhash64("x"), parts + 1).cast("int").alias("part")
    asked = asked.select("x", "nx", "rx", (F.col("c") - F.col("i")).alias("left"), F.col("s.h").alias("h"), part)
    fits = (
        (F.col("of") != F.col("rx"))
        & (F.lit(den) * F.col("high") >= F.lit(num) * F.col("nx"))
        & (F.lit(den) * F.col("nx") >= F.lit(num) * F.col("low"))
        & (F.lit(num + den) * F.least("left", "most") >= F.lit(num) * (F.col("low") + F.col("nx")))
    )
    met = asked.join(told, ["h", "part"]).where(fits).select("x", "nx", "of", "band", "m", "only").distinct()
    met = scratch_table(met, "met")
    single = met.where("m = 1").select(F.col("x").alias("a"), F.col("only").alias("b"))
    many = met.where("m > 1")

    involved = scratch_table(many.select(F.col("of").alias("root")).distinct(), "asked-components")
    inside = sides.join(involved, "root", "left_semi").select("v", "n", "c", "root", "band", "parity")
    pivots = scratch_table(inside.groupBy("root").agg(F.max_by("v", F.struct("c", "v")).alias("pivot")), "pivots")
    to_pivot = inside.select("root", "v").unionByName(many.select(F.col("of").alias("root"), F.col("x").alias("v"))).distinct()
    to_pivot = to_pivot.join(pivots, "root").select("root", F.col("v").alias("a"), F.col("pivot").alias("b"))
    far = scratch_table(_distances(to_pivot, full), "pivot-distances")
    near = far.where(F.col("d") <= bound + 1e-9).where("a <> b").select("a", "b")
    step = F.lit(16.0)
    stand = inside.join(far.select("root", F.col("a").alias("v"), "d"), ["root", "v"])
    stand = stand.select("root", "band", F.floor(F.col("d") * step).alias("ring"), F.col("v").alias("y"), F.col("n").alias("ny"), F.col("c").alias("cy"), F.col("d").alias("dy"), F.col("parity").alias("py"))
    ask = many.select("x", "nx", F.col("of").alias("root"), "band").join(far.select("root", F.col("a").alias("x"), F.col("d").alias("dx")), ["root", "x"])
    ask = ask.where(F.col("dx") > bound + 1e-9).join(sides.select(F.col("v").alias("x"), F.col("c").alias("cx"), F.col("parity").alias("px")), "x")
    rings = F.sequence(F.floor((F.col("dx") - bound - 1e-9) * step), F.floor(F.least(F.col("dx") + bound + 1e-9, F.lit(1.0)) * step))
    ask = ask.withColumn("ring", F.explode(rings))
    close = (
        (F.abs(F.col("dx") - F.col("dy")) <= bound + 1e-9)
        & search.sizes_fit("nx", "ny")
        & (F.lit(num + den) * F.least("cx", "cy") >= F.lit(num) * (F.col("nx") + F.col("ny")))
        & _parities_fit(num, den)
    )
    ringed = ask.join(stand, ["root", "band", "ring"]).where(close).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return scratch_table(search.possible(single.unionByName(near).unionByName(ringed)), "pairs")


def _parities_fit(num: int, den: int) -> Column:
    """Whether sets of ``nx`` and ``ny`` with parities ``px`` and ``py`` can be linked.

    Linked ones differ in at most ``(den - num) / (num + den)`` of the sum of their sizes.
    """
    differ = F.aggregate(F.zip_with("px", "py", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, m: n + m)
    return F.lit(num + den) * differ <= F.lit(den - num) * (F.col("nx") + F.col("ny"))


def _distances(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """``root, a, b, d``: the Jaccard distance of the full sets of each pair."""
    both = pairs.join(full.select(F.col("v").alias("a"), F.col("hashes").alias("x")), "a")
    both = both.join(full.select(F.col("v").alias("b"), F.col("hashes").alias("y")), "b").select("root", "a", "b", "x", "y")
    return both.mapInArrow(_apart, "root bigint, a bigint, b bigint, d double")


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for a, b in zip(batch.column(3), batch.column(4), strict=True):
            x, y = a.values.to_numpy(), b.values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            found.append(1 - both / (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.float64())], names=["root", "a", "b", "d"])


def _by_row(df: DataFrame, id_col: str, text_col: str, shingle_words: int, num: int, den: int) -> DataFrame:
    """``near_dedup`` with ``text_hash``, which tells rows that share an id or have none apart."""
    mark = scratch_mark()
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    search = _Search(docs, shingle_words, num, den)
    stars = scratch_table(component_stars(near_duplicate_links(search)), "stars")
    in_class = stars.select(F.col("vertex").alias("v"), "root").unionByName(stars.select(F.col("root").alias("v"), "root").distinct())
    sets = search.sets.select("v", "digest", "rep_id", "n_rows").join(in_class, "v", "left")
    sets = scratch_table(sets.where("root IS NOT NULL OR n_rows > 1").withColumn("root", F.coalesce("root", "v")), "class-sets")
    least = scratch_table(sets.groupBy("root").agg(F.min("rep_id").alias("least_id"), F.count(F.lit(1)).alias("n_sets")), "least")
    classes = attach_by_key(sets, least, "root", "n_sets", search.n_sets).select("digest", "least_id", "n_rows")
    classes = scratch_table(classes, "classes")
    rows = search.rows.select("doc_id", "text_hash", "n", "digest")
    placed = attach_by_key(rows.where("digest IS NOT NULL"), classes, "digest", "n_rows", max(1, rows.count()))
    alone = rows.where("digest IS NULL").withColumn("least_id", F.col("doc_id"))
    columns = ["doc_id", "text_hash", "n", "least_id"]
    out = placed.select(*columns).unionByName(alone.select(*columns))
    component = F.coalesce("least_id", "doc_id")
    out = out.select(
        F.col("doc_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        "text_hash",
    )
    out = scratch_table(out, "near-dedup")
    drop_scratch(df.sparkSession, mark)
    return out


def near_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` for each row: classes of documents linked by similarity.

    Two documents are linked if their sets of word shingles overlap by ``num / den`` of their union or more;
    equal sets always are. ``component_id`` is the least id reachable over links; ``kept`` marks that row.

    Defined results: null and empty texts, and texts without words, have no shingles and stand alone; rows
    that repeat an id and text share its class and are all kept or not; null ids belong to their text's
    class, which has a null ``component_id`` if no member has an id; texts of any length are sketched and compared
    whole; an empty table gives an empty table; other columns of ``df`` are not read.
    """
    return _by_row(df, id_col, text_col, shingle_words, num, den).drop("text_hash")


def near_dedup_report(docs: DataFrame) -> DataFrame:
    return near_dedup(docs, shingle_words=4)


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """The rows of ``docs`` that ``near_dedup`` keeps, with all their columns.

    Rows are told by id and text: one with a repeated id or none does not take others along. Those that a Bloom
    filter of the dropped rows excludes go straight through; only the others shuffle.
    """
    dropped = _by_row(docs, id_col, text_col, shingle_words, num, den).where(~F.col("kept"))
    dropped = scratch_table(dropped.select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__dropped")).distinct(), "dropped")
    bits = filter_bits(max(1, dropped.count()))
    blocks = scratch_table(repeat_filter(dropped.select(F.xxhash64("__id", "__dropped").alias("h")), "h", bits, 1), "dropped-bits")
    marked = docs.withColumn("__text", F.xxhash64(text_col)).withColumn("__h", F.xxhash64(id_col, "__text"))
    marked = may_repeat(marked, "__h", blocks, bits, "__in").drop("__h")
    sure = marked.where(~F.col("__in")).drop("__in", "__text")
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__dropped"))
    rest = marked.where("__in").drop("__in").join(dropped, same, "left_anti").drop("__text")
    return sure.unionByName(rest)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT rid, doc_id, hash(g) AS g FROM (
    SELECT rid, doc_id, list_aggregate(w[i:i+3], 'string_agg', ' ') AS g
    FROM (SELECT rid, doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0))
), n AS (
  SELECT rid, doc_id, count(*) AS n FROM s GROUP BY rid, doc_id
), o AS (
  SELECT a.rid AS ra, b.rid AS rb, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY a.rid, b.rid
), e AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM o JOIN n x ON o.ra = x.rid JOIN n y ON o.rb = y.rid
  WHERE 100 * common >= 80 * (x.n + y.n - common)
), d AS (
  SELECT a, b FROM e UNION SELECT b, a FROM e
), r(a, b) AS (
  SELECT a, b FROM d UNION SELECT r.a, d.b FROM r JOIN d ON r.b = d.a
), c AS (
  SELECT a, min(b) AS b FROM r GROUP BY a
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c.b, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(c.b, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (rid) LEFT JOIN c ON c.a = w.doc_id
"""
