"""Mixing sources to target weights by Pareto order sampling. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.llm.scale import filter_bits, may_repeat, repeat_filter, scratch_table
from siltworks.llm.text import words

SHARE = 1.5
WEIGHTS = (3, 1, 2)
MAX_COPIES = 2
SEED = 7
#: Ranks are first counted in this many bins a source, so that no task orders a whole source.
BINS = 16_384
#: Parts of a document's merit, and how far it moves a document's expected copies from its source's, as a share.
MERITS, SPREAD = 1_024, 0.5
#: Words that may fill the gap at a source's cut, as a multiple of it.
POOL = 10


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES
) -> DataFrame:
    """``source, source_size, target`` for ``sizes(source, size)``.

    Sources in code point order, null last, take ``weights`` in turn. They divide ``share`` of all sizes by
    weight; a target stops at ``max_copies`` times its source's size and the excess is shared out again.
    That fixpoint has a closed form: in order of limit / weight, a source is capped while its limit is no
    more than its part of what the earlier ones leave. Only one row a source reaches the ordered windows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    per = per.withColumn("__w", F.get(F.array(*[F.lit(int(w)) for w in weights]), F.pmod(turn, F.lit(len(weights)))))
    per = per.withColumn("__limit", F.col("source_size") * max_copies)
    line = Window.orderBy(F.col("__limit") / F.col("__w"), F.asc_nulls_last("source"))
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    per = per.withColumns(
        {
            "__all": F.sum("source_size").over(every) * F.lit(share),
            "__spent": F.coalesce(F.sum("__limit").over(before), F.lit(0)),
            "__left": F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0)),
        }
    )
    capped = F.col("__limit") * F.col("__left") <= F.col("__w") * (F.col("__all") - F.col("__spent"))
    per = per.withColumn("__capped", capped)
    unspent = F.max("__all").over(every) - F.sum(F.when(F.col("__capped"), F.col("__limit")).otherwise(0)).over(every)
    level = F.try_divide(unspent, F.sum(F.when(F.col("__capped"), 0).otherwise(F.col("__w"))).over(every))
    target = F.when(F.col("__capped"), F.col("__limit").cast("double")).otherwise(F.col("__w") * level)
    return per.select("source", "source_size", target.alias("target"))


def uniform(id_col: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the id and the seed only: 52 bits of an MD5."""
    digest = F.md5(F.encode(F.concat(F.lit(f"{seed}/"), F.coalesce(id_col.cast("string"), F.lit(""))), "UTF-8"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def merit(size: Column, mean: Column) -> Column:
    """In ``MERITS`` parts: a document of its source's mean size has half of them, a shorter one more.

    Among documents that chance decides on, shorter ones come first, so that the words spread over more documents.
    """
    return F.coalesce(F.try_divide(mean * MERITS, mean + size).cast("long"), F.lit(0).cast("long"))


def expected_copies(target: Column, source_size: Column, merits: Column, merit_words: Column, max_copies: int) -> Column:
    """How often a document is to be in the mix, on average; the words so expected of a source are its target.

    Target over size would treat all documents alike. A document gets up to ``SPREAD`` of that more or less by how its
    merit compares with its source's mean over words (``merit_words`` is the sum of merit times size): those
    differences cancel out over the words of the source. Where the target leaves less room below ``max_copies`` the
    spread is as small as that room.
    """
    ratio = F.coalesce(F.try_divide(target, source_size), F.lit(0.0))
    room = F.coalesce(F.try_divide(F.lit(float(max_copies)), ratio), F.lit(1.0)) - 1.0
    spread = F.greatest(F.lit(0.0), F.least(F.lit(SPREAD), room))
    off = (merits - F.coalesce(F.try_divide(merit_words, source_size), F.lit(0.0))) / float(MERITS)
    return F.least(F.lit(float(max_copies)), F.greatest(F.lit(0.0), ratio * (1.0 + spread * off)))


def _rank(id_col: Column, p: Column, seed: int) -> Column:
    """Random odds over inclusion odds; null where nothing is left to chance."""
    u = uniform(id_col, seed)
    return F.when(p > 0, F.try_divide(u / (F.lit(1.0) - u), p / (F.lit(1.0) - p)))


def _bin(rank: Column) -> Column:
    return F.floor(F.lit(float(BINS)) * rank / (F.lit(1.0) + rank)).cast("long")


def _fill(pool: Column, gap: Column) -> Column:
    """The places in ``pool`` (sizes in rank order) that are taken one after the other while they fit into ``gap``."""
    zero = F.struct(gap.cast("long").alias("left"), F.array().cast("array<int>").alias("took"))

    def step(s: Column, x: Column) -> Column:
        fits = x["size"] <= s["left"]
        return F.struct(
            F.when(fits, s["left"] - x["size"]).otherwise(s["left"]).alias("left"),
            F.when(fits, F.concat(s["took"], F.array(x["place"]))).otherwise(s["took"]).alias("took"),
        )

    return F.aggregate(pool, zero, step)["took"]


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    size_col: str = "size",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    max_copies: int = MAX_COPIES,
    seed: int = SEED,
) -> DataFrame:
    """Add ``source_size``, ``target``, ``copies`` and ``taken`` (``copies`` times the size) to the rows of ``df``.

    Each document has expected copies of its own (``expected_copies``): their whole part is certain, what is left
    over is its inclusion probability p. Documents are ranked by odds(u) / odds(p), u uniform by a hash of the id
    (Pareto order sampling). The sample's size is fixed in words, as targets are: what the certain copies leave of
    the target. Documents are taken in rank order up to the first that does not fit. The gap that it leaves is
    filled by the documents behind it, in rank order, each taken if it fits still: those that were short enough
    for the gap, as far as ``POOL`` times its words reach. One more document, the one whose words come nearest, closes
    what is left if it narrows it. So a very long document at the cut is passed over and does not keep its source from
    the target.

    Ranks are summed in bins a source; only documents of the bin where the target falls, and the pool behind it, are
    ordered, so a source with a third of all rows is never sorted in one task. Results depend on ids, sizes and
    sources only: reruns agree. Defined results: null or negative sizes count as 0; a null source is a source;
    rows that repeat id, size and source are taken or left together; a source of size 0 has target 0; texts of any
    length count whole; an empty table gives an empty table; other columns pass through, clashing names are
    replaced.
    """
    rows = df.drop(*ADDED).withColumn("__size", _size(F.col(size_col)))
    slim = rows.select(F.col(id_col).alias("id"), F.col("__size").alias("size"), F.col(source_col).alias("source"))
    facts, picks = _decided(scratch_table(slim, "sizes"), weights, share, max_copies, seed)
    out = _picked(rows, picks, id_col, source_col)
    return _with_copies(out, facts, id_col, source_col, max_copies, seed, [c for c in df.columns if c not in ADDED])


ADDED = ["source_size", "target", "copies", "taken"]


def _size(words: Column) -> Column:
    return F.greatest(F.coalesce(words.cast("long"), F.lit(0)), F.lit(0))


def _decided(slim: DataFrame, weights: Sequence[int], share: float, max_copies: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The facts of each source, and the documents at its cut that are taken: ``__s, __i, __z`` (source, id, size).

    ``slim`` is ``id, size, source``. Who is taken else follows from the facts and a document's own rank.
    """
    targets = source_targets(slim, weights, share, max_copies)
    counts = slim.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    targets = _on_source(targets, counts).withColumn("mean", F.expr("source_size div n")).drop("n")
    targets = scratch_table(targets, "targets")
    merits = _on_source(slim, targets.select("source", "mean")).groupBy("source").agg(F.sum(merit(F.col("size"), F.col("mean")) * F.col("size")).alias("merit_words"))
    targets = scratch_table(_on_source(targets, merits), "merits")

    def judged(rows_: DataFrame, facts: DataFrame) -> DataFrame:
        """Rows with what they are certain of and, where chance decides, their rank and its bin."""
        out = _on_source(rows_, facts)
        copies = expected_copies(F.col("target"), F.col("source_size"), merit(F.col("size"), F.col("mean")), F.col("merit_words"), max_copies)
        out = out.withColumn("expected", copies).withColumn("certain", F.floor("expected").cast("long"))
        return out.withColumn("rank", _rank(F.col("id"), F.col("expected") - F.col("certain"), seed)).withColumn("bin", _bin(F.col("rank")))

    bins = judged(slim, targets).groupBy("source", "bin").agg(
        F.sum(F.when(F.col("rank").isNotNull(), F.col("size"))).alias("in_bin"), F.sum(F.col("certain") * F.col("size")).alias("sure")
    )
    bins = scratch_table(bins, "bins")
    sure = bins.groupBy("source").agg(F.sum("sure").alias("sure"))
    needs = scratch_table(_on_source(targets, sure).withColumn("need", F.col("target") - F.col("sure")).drop("sure"), "needs")
    so_far = Window.partitionBy("source").orderBy("bin")
    upto = _on_source(bins.where("bin IS NOT NULL"), needs.select("source", "need")).withColumn("upto", F.sum("in_bin").over(so_far))
    first = upto.where("upto > need").groupBy("source").agg(
        F.min(F.struct("bin", (F.col("upto") - F.col("in_bin")).alias("before"))).alias("cut")
    )
    cuts = needs.alias("t").join(first.alias("f"), F.expr("t.source <=> f.source"), "left").select(
        "t.*", F.coalesce(F.col("cut.bin"), F.lit(BINS + 1)).alias("cut_bin"), F.coalesce("cut.before", F.lit(0)).alias("before")
    )
    cuts = scratch_table(cuts, "cuts")

    same = ["source", "rank", "id", "size"]
    order = Window.partitionBy("source").orderBy("rank", F.asc_nulls_last("id"), "size")
    edge = judged(slim, cuts).where("bin = cut_bin").groupBy(*same, "need", "before").agg(F.count(F.lit(1)).alias("n"))
    edge = scratch_table(edge.withColumn("upto", F.col("before") + F.sum(F.col("size") * F.col("n")).over(order)), "edge")
    taken = edge.where("upto <= need").select("source", "id", "size", "upto")

    filled = taken.groupBy("source").agg(F.max("upto").alias("filled"))
    gaps = cuts.alias("c").join(filled.alias("f"), F.expr("c.source <=> f.source"), "left").where(f"cut_bin <= {BINS}")
    gaps = scratch_table(gaps.select("c.*", F.floor(F.col("need") - F.coalesce("filled", "before")).cast("long").alias("gap")), "gaps")
    behind = judged(slim, gaps).where("bin > cut_bin AND size > 0 AND size <= gap")
    reach = behind.groupBy("source", "bin", "gap").agg(F.sum("size").alias("in_bin")).withColumn("upto", F.sum("in_bin").over(so_far))
    last = gaps.alias("g").join(
        reach.where(F.col("upto") >= POOL * F.col("gap")).groupBy("source").agg(F.min("bin").alias("last_bin")).alias("l"), F.expr("g.source <=> l.source"), "left"
    ).select("g.*", F.coalesce("last_bin", F.lit(BINS + 1)).alias("last_bin"))
    last = scratch_table(last, "pool-ends")
    pool = judged(slim, last).where("bin > cut_bin AND bin <= last_bin AND size > 0 AND size <= gap").groupBy(*same, "gap").agg(F.count(F.lit(1)).alias("n"))
    rest = _on_source(edge.where("upto > need"), gaps.select("source", "gap")).where("size > 0 AND size <= gap").select(*same, "gap", "n")
    pool = rest.unionByName(pool.select(*same, "gap", "n")).withColumn("all", F.col("size") * F.col("n"))
    pool = pool.withColumns({"upto": F.sum("all").over(order), "place": F.row_number().over(order)})
    pool = scratch_table(pool.where(F.col("upto") - F.col("all") < POOL * F.col("gap")), "pool")
    lined = F.array_sort(F.collect_list(F.struct("place", F.col("all").alias("size"))))
    picked = pool.groupBy("source", "gap").agg(lined.alias("line"))
    picked = picked.select("source", F.explode(_fill(F.col("line"), F.col("gap"))).alias("place"))
    closing = pool.alias("p").join(picked.alias("k"), F.expr("p.source <=> k.source AND p.place = k.place")).select("p.source", "p.id", "p.size", "p.all")
    closing = scratch_table(closing, "closing")
    spent = closing.groupBy("source").agg(F.sum("all").alias("spent"))
    rooms = gaps.alias("g").join(spent.alias("s"), F.expr("g.source <=> s.source"), "left").select("g.*", (F.col("gap") - F.coalesce("spent", F.lit(0))).alias("room"))
    rooms = scratch_table(rooms.where("room > 0"), "rooms")
    picks = scratch_table(taken.select("source", "id", "size").unionByName(closing.select("source", "id", "size")), "picks")
    ends = judged(slim, rooms).where("bin >= cut_bin AND size > 0 AND size < 2 * room").groupBy(*same, "room").agg((F.col("size") * F.count(F.lit(1))).alias("all"))
    ends = ends.where("all < 2 * room").alias("e").join(picks.alias("t"), F.expr("e.source <=> t.source AND e.id <=> t.id AND e.size = t.size"), "left_anti")
    nearest = F.min(F.struct(F.abs(F.col("room") - F.col("all")).alias("off"), "rank", F.col("id"), F.col("size")))
    ends = ends.groupBy("source").agg(nearest.alias("x")).select("source", F.col("x.id").alias("id"), F.col("x.size").alias("size"))
    picks = scratch_table(picks.unionByName(ends), "all-picks")

    picks = picks.select(F.col("source").alias("__s"), F.col("id").alias("__i"), F.col("size").alias("__z"), F.lit(1).alias("__pick"))
    facts = cuts.select(F.col("source").alias("__source"), *[F.col(c).alias(c if c in ADDED else f"__{c}") for c in ("source_size", "target", "mean", "merit_words", "cut_bin")])
    return facts, picks


def _picked(rows: DataFrame, picks: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """Rows with ``__pick``, 1 for those that are picks, else null. Rows meet picks by source, id and size."""
    mine = F.col(source_col).eqNullSafe(F.col("__s")) & F.col(id_col).eqNullSafe(F.col("__i")) & (F.col("__size") == F.col("__z"))
    return rows.join(picks, mine, "left").drop("__s", "__i", "__z")


def _with_copies(rows: DataFrame, facts: DataFrame, id_col: str, source_col: str, max_copies: int, seed: int, keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``ADDED`` of rows that have ``__size`` and ``__pick``."""
    out = rows.join(facts, F.col(source_col).eqNullSafe(F.col("__source")), "left")
    copies = expected_copies(F.col("target"), F.col("source_size"), merit(F.col("__size"), F.col("__mean")), F.col("__merit_words"), max_copies)
    out = out.withColumn("__expected", copies).withColumn("__certain", F.floor("__expected").cast("long"))
    here = _bin(_rank(F.col(id_col), F.col("__expected") - F.col("__certain"), seed))
    more = F.when((here < F.col("__cut_bin")) | F.col("__pick").isNotNull(), 1).otherwise(0)
    out = out.withColumn("copies", F.col("__certain") + more).withColumn("taken", F.col("copies") * F.col("__size"))
    return out.select(*[F.col(f"`{c}`") for c in keep], *ADDED)


def _on_source(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Inner join on a source that may be null; facts have one row a source."""
    out = rows.alias("r").join(facts.alias("f"), F.expr("r.source <=> f.source"))
    return out.select("r.*", *[F.col(f"f.{c}") for c in facts.columns if c != "source"])


def mix_report(docs: DataFrame) -> DataFrame:
    sized = scratch_table(
        docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size")), "sized"
    )
    return mix_sources(sized).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as it was taken, with the columns of ``docs``, whatever their names.

    All is decided on ids, sizes and sources. Texts stay where they are: a Bloom filter of the documents picked at the cuts (bounded) is
    broadcast, and only what it lets through meets them by join.
    """
    own = docs.select(*[F.col(f"`{c}`").alias(f"__doc_{c}") for c in docs.columns])
    sized = lambda rows: rows.withColumn("__size", _size(F.size(words(F.col("__doc_text")))))
    slim = sized(own).select(F.col("__doc_doc_id").alias("id"), F.col("__size").alias("size"), F.col("__doc_source").alias("source"))
    facts, picks = _decided(scratch_table(slim, "sizes"), WEIGHTS, SHARE, MAX_COPIES, SEED)
    bits = filter_bits(max(1, picks.count()))
    blocks = scratch_table(repeat_filter(picks.select(F.xxhash64("__s", "__i").alias("h")), "h", bits, 1), "picked-bits")
    marked = may_repeat(own.withColumn("__h", F.xxhash64("__doc_source", "__doc_doc_id")), "__h", blocks, bits, "__maybe")
    straight = sized(marked.where(~F.col("__maybe"))).withColumn("__pick", F.lit(None).cast("int"))
    told = _picked(sized(marked.where("__maybe")), picks, "__doc_doc_id", "__doc_source")
    out = straight.unionByName(told)
    out = _with_copies(out, facts, "__doc_doc_id", "__doc_source", MAX_COPIES, SEED, own.columns)
    # No copies make no rows. A filter on copies would repeat their whole expression, in a method too large to compile.
    out = out.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(f"`__doc_{c}`").alias(c) for c in docs.columns])



ORACLE = f"""
WITH RECURSIVE s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size)::BIGINT // count(*) AS mean,
         [3, 1, 2][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS w
  FROM s GROUP BY source
), lim AS (
  SELECT *, 2 * source_size AS lim, sum(source_size) OVER () * 1.5::DOUBLE AS t,
         coalesce(sum(2 * source_size) OVER o, 0)::BIGINT AS spent,
         sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS left_w
  FROM per
  WINDOW o AS (ORDER BY (2 * source_size)::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), cap AS (
  SELECT *, lim * left_w <= w * (t - spent) AS capped FROM lim
), tgt AS (
  SELECT source, source_size, mean, CASE WHEN capped THEN lim::DOUBLE ELSE w * ((max(t) OVER () - coalesce(sum(lim) FILTER (capped) OVER (), 0)::BIGINT)
         / coalesce(sum(w) FILTER (NOT capped) OVER (), 0)) END AS target
  FROM cap
), m AS (
  SELECT s.*, source_size, target, CASE WHEN mean + size > 0 THEN floor((mean * {MERITS})::DOUBLE / (mean + size))::BIGINT ELSE 0 END AS merit
  FROM s JOIN tgt ON s.source IS NOT DISTINCT FROM tgt.source
), f AS (
  SELECT *, sum(merit * size) OVER (PARTITION BY source)::BIGINT AS merit_words,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS ratio
  FROM m
), x AS (
  SELECT *, least(2.0::DOUBLE, greatest(0.0::DOUBLE, ratio * (1.0::DOUBLE + greatest(0.0::DOUBLE, least({SPREAD}::DOUBLE,
           CASE WHEN ratio > 0 THEN 2.0::DOUBLE / ratio ELSE 1.0::DOUBLE END - 1.0::DOUBLE))
           * ((merit - CASE WHEN source_size > 0 THEN merit_words::DOUBLE / source_size ELSE 0.0::DOUBLE END) / {float(MERITS)}::DOUBLE)))) AS expected
  FROM f
), d AS (
  SELECT *, floor(expected)::BIGINT AS certain, expected - floor(expected) AS p,
         (('0x' || substr(md5('{SEED}/' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)!r}::DOUBLE AS u
  FROM x
), q AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)) END AS rank,
         target - sum(certain * size) OVER (PARTITION BY source)::BIGINT AS need
  FROM d
), o AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS LAST, size) AS upto,
         floor({BINS}.0::DOUBLE * rank / (1.0::DOUBLE + rank))::BIGINT AS bin
  FROM q WHERE p > 0
), g AS (
  SELECT source, floor(any_value(need) - coalesce(max(upto) FILTER (upto <= need), 0))::BIGINT AS gap, min(bin) FILTER (upto > need) AS cut_bin
  FROM o GROUP BY source
), b AS (
  SELECT o.*, gap, sum(o.size) OVER (PARTITION BY o.source ORDER BY o.rank, o.doc_id NULLS LAST, o.size) AS pooled,
         row_number() OVER (PARTITION BY o.source ORDER BY o.rank, o.doc_id NULLS LAST, o.size) AS place
  FROM o JOIN g ON o.source IS NOT DISTINCT FROM g.source
  WHERE upto > need AND size > 0 AND size <= gap
), pool AS (
  SELECT * FROM b WHERE pooled - size < {POOL} * gap
), z(source, place, room, took) AS (
  SELECT source, 1::BIGINT, gap - CASE WHEN size <= gap THEN size ELSE 0 END, size <= gap FROM pool WHERE place = 1
  UNION ALL
  SELECT z.source, pool.place, z.room - CASE WHEN pool.size <= z.room THEN pool.size ELSE 0 END, pool.size <= z.room
  FROM z JOIN pool ON pool.source IS NOT DISTINCT FROM z.source AND pool.place = z.place + 1
), c AS (
  SELECT pool.source, pool.doc_id, pool.size FROM pool JOIN z ON pool.source IS NOT DISTINCT FROM z.source AND pool.place = z.place WHERE z.took
), y AS (
  SELECT g.source, g.gap - coalesce(s.spent, 0) AS room
  FROM g LEFT JOIN (SELECT source, sum(size) AS spent FROM c GROUP BY source) s ON g.source IS NOT DISTINCT FROM s.source
), v AS (
  SELECT o.doc_id, row_number() OVER (PARTITION BY o.source ORDER BY abs(room - o.size), o.rank, o.doc_id) AS rn
  FROM o JOIN y ON o.source IS NOT DISTINCT FROM y.source
  WHERE o.upto > o.need AND o.size > 0 AND o.size < 2 * room AND o.doc_id NOT IN (SELECT doc_id FROM c)
)
SELECT q.doc_id, q.size, q.source_size, q.target,
       q.size * (q.certain + CASE WHEN o.upto <= o.need OR q.doc_id IN (SELECT doc_id FROM c) OR q.doc_id IN (SELECT doc_id FROM v WHERE rn = 1) THEN 1 ELSE 0 END) AS taken
FROM q LEFT JOIN o ON q.doc_id = o.doc_id
"""
