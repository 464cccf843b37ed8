"""Exact deduplication by two-pass Bloom filtering, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.scale import (
    MAX_FILTER_BITS, MIN_FILTER_BITS, attach_by_key, filter_bits, may_repeat, repeat_filter, scratch_path, scratch_table,
)
from siltworks.llm.text import ascii_lower

#: Files that a range of hashes is written in: 2^26 rows of some 60 bytes are 16 files of 250 MB.
RANGE_FILES = 16
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def text_digest(text):
    """Hex SHA-256 of the text with A-Z lower-cased, in UTF-8; null counts as empty."""
    return F.sha2(F.encode(ascii_lower(F.coalesce(text, F.lit(""))), "UTF-8"), 256)


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", digest_col: str = "text_sha256", max_bits: int = MAX_FILTER_BITS
) -> DataFrame:
    """Mark, of rows with equal digests, the one with the largest id as kept.

    Adds ``keep_id``, ``group_size`` (rows of the group) and ``kept`` to the columns of ``df``, which must
    carry the hex digest of its text (see ``text_digest``). Pass one sets two bits a row in a Bloom filter
    and keeps the bits set twice; pass two probes it. Rows with a bit set once are unique and go straight
    through. Only the others are grouped: by digest, pre-aggregated, so a group of any size is counted in
    parts, and its facts go back by ``attach_by_key``.

    A filter has sixteen bits a row and ``max_bits`` at most, as it is broadcast. More rows than that allows are
    divided by ranges of their hash, each with a filter of its own, one after the other: rows move to their range once, in
    ``RANGE_FILES`` files each whatever the number of tasks, and each range is read by itself. So ``df`` should be slim:
    ``drop_copies`` hands over ids and digests, never texts. The share of rows that are grouped does not grow with the table.

    Defined results: null texts equal empty ones; a null id loses to any other; rows that repeat the
    largest id of a group are the same document and all stay; texts of any length are digested whole; an empty
    table gives an empty table. Other columns pass through, but ``keep_id``, ``group_size`` and ``kept`` of the
    input are replaced.
    """
    rows = df.drop("keep_id", "group_size", "kept", "__h", "__maybe", "__range").withColumn(
        "__h", F.conv(F.substring(digest_col, 1, 16), 16, -10).cast("long")
    )
    n_rows = rows.select("__h").count()
    ranges = -(-16 * n_rows // max_bits)
    if ranges <= 1:
        return _dedup_range(rows, id_col, digest_col, n_rows, max_bits)
    whole = rows.withColumn("__range", F.pmod(F.shiftright("__h", 40), F.lit(ranges)).cast("int"))
    # Rows of one digest are dealt by id too: a group of any size is in all files of its range.
    spread = F.pmod(F.xxhash64(id_col, "__h"), F.lit(RANGE_FILES))
    parted = scratch_table(whole.repartition(ranges * RANGE_FILES, "__range", spread), "hash-ranges", by="__range")
    path = scratch_path(df.sparkSession, "deduplicated")
    for k in range(ranges):
        out = _dedup_range(parted.where(F.col("__range") == k).drop("__range"), id_col, digest_col, n_rows // ranges, max_bits)
        out.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path)


def _dedup_range(rows: DataFrame, id_col: str, digest_col: str, n_rows: int, max_bits: int) -> DataFrame:
    bits = min(filter_bits(n_rows), max(MIN_FILTER_BITS, max_bits))
    blocks = scratch_table(repeat_filter(rows.select("__h"), "__h", bits), "repeat-bits")
    marked = may_repeat(rows, "__h", blocks, bits, "__maybe").drop("__h")
    maybe = scratch_table(marked.where("__maybe").drop("__maybe"), "maybe-repeated")
    groups = maybe.groupBy(digest_col).agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = scratch_table(groups, "repeat-groups")
    again = attach_by_key(maybe, groups, digest_col, "group_size", n_rows)
    once = (
        marked.where(~F.col("__maybe"))
        .drop("__maybe")
        .withColumns({"keep_id": F.col(id_col), "group_size": F.lit(1).cast("long")})
    )
    return again.unionByName(once).withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))


def dedup_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``exact_dedup`` with the digest of ``text_col`` as column ``text_sha256``."""
    return exact_dedup(df.withColumn("text_sha256", text_digest(F.col(text_col))), id_col)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` that ``dedup_texts`` keeps, with all their columns, whatever their names.

    Copies are found on ids and digests. A Bloom filter of those that go (bounded) is broadcast: texts that it does not
    let through stay where they are; the others shuffle to be told from what goes, by digest and id, so that a group of
    any size is spread.
    """
    own = docs.select(*[F.col(f"`{c}`").alias(f"__doc_{c}") for c in docs.columns], text_digest(F.col(text_col)).alias("__digest"))
    mine = F.col(f"__doc_{id_col}")
    slim = scratch_table(own.select(mine.alias("id"), F.col("__digest").alias("digest")), "digests")
    gone = exact_dedup(slim, "id", "digest", max_bits).where(~F.col("kept")).select("id", "digest").distinct()
    gone = scratch_table(gone, "dropped-copies")
    bits = min(filter_bits(max(1, gone.count())), max(MIN_FILTER_BITS, max_bits))
    blocks = scratch_table(repeat_filter(gone.select(F.xxhash64("digest", "id").alias("h")), "h", bits, 1), "dropped-bits")
    marked = may_repeat(own.withColumn("__h", F.xxhash64("__digest", mine)), "__h", blocks, bits, "__maybe")
    told = marked.where("__maybe").join(gone, (F.col("__digest") == F.col("digest")) & mine.eqNullSafe(F.col("id")), "left_anti")
    out = marked.where(~F.col("__maybe")).unionByName(told)
    return out.select(*[F.col(f"`__doc_{c}`").alias(c) for c in docs.columns])


def dedup_report(docs: DataFrame) -> DataFrame:
    """One row a document. Texts are read once; their digests (some 60 bytes a row) go to the shared folder."""
    digests = scratch_table(docs.select("doc_id", text_digest(F.col("text")).alias("text_sha256")), "digests")
    out = exact_dedup(digests)
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
