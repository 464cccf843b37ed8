"""Shared plumbing for operators that must survive skew and lost executors.

* ``repeat_filter`` / ``may_repeat`` are the two passes of a Bloom filter over 64-bit hashes.
* ``scratch_table`` and ``attach_by_key`` come from the library: tables in the shared folder, and joins in
  which one key may own a third of the rows.
"""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators.skew import attach_by_key
from siltworks.scratch import clear_scratch, drop_path, drop_scratch, scratch_mark, scratch_path, scratch_table, shared_dir
from siltworks.ship import ship_code

__all__ = [
    "attach_by_key", "bound_batches", "clear_scratch", "drop_path", "drop_scratch", "filter_bits", "let", "may_repeat", "release_memory", "repeat_filter",
    "scratch_mark", "scratch_path", "scratch_table", "shared_dir",
]

#: Bits in one block of a filter: what ``bitmap_construct_agg`` packs into 4,096 bytes.
BLOCK_BITS = 32_768
#: A filter never has more bits than this (128 MB); beyond it more rows shuffle, none is lost.
MAX_FILTER_BITS = 1 << 30
MIN_FILTER_BITS = 1 << 20


def bound_batches(spark: SparkSession, rows: int = 100) -> None:
    """Make this package known to Python workers, and hand them ``rows`` rows at once where the session has Spark's
    default of 10,000: texts are long."""
    ship_code(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def release_memory() -> None:
    """Hand freed memory of this Python worker back to the system: workers stay alive between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a variable."""
    return F.transform(F.array(value), body).getItem(0)


def _slots(hash64: Column, bits: int) -> list[Column]:
    return [F.pmod(hash64, F.lit(bits)), F.pmod(F.xxhash64(hash64), F.lit(bits))]


def filter_bits(n_rows: int) -> int:
    """Sixteen bits a row, as a power of two between the two bounds."""
    return max(MIN_FILTER_BITS, min(MAX_FILTER_BITS, 1 << max(0, 16 * n_rows - 1).bit_length()))


def repeat_filter(hashes: DataFrame, hash_col: str, bits: int, least: int = 2) -> DataFrame:
    """First pass: the bits that were set at least ``least`` times, as ``(block, bits)`` rows.

    Each row sets two bits. Only 8-byte slots shuffle, pre-aggregated in each task. The result has at
    most ``bits / 32768`` rows of 4 KB: 128 MB for ``MAX_FILTER_BITS``. Null hashes set nothing.
    """
    twice = (
        hashes.where(F.col(hash_col).isNotNull())
        .select(F.explode(F.array(*_slots(F.col(hash_col), bits))).alias("slot"))
        .groupBy("slot")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least)
    )
    return twice.groupBy(F.floor(F.col("slot") / BLOCK_BITS).cast("long").alias("block")).agg(
        F.bitmap_construct_agg(F.pmod("slot", F.lit(BLOCK_BITS))).alias("bits")
    )


def _bit(bits: Column, slot: Column) -> Column:
    at = F.pmod(slot, F.lit(BLOCK_BITS))
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.pmod(at, F.lit(8)))), F.lit(2)) == 1, F.lit(False))


def may_repeat(rows: DataFrame, hash_col: str, blocks: DataFrame, bits: int, flag: str) -> DataFrame:
    """Second pass: ``flag`` is false only for hashes that surely occur once. Nothing shuffles."""
    out = rows
    for i, slot in enumerate(_slots(F.col(hash_col), bits)):
        side = blocks.select(F.col("block").alias(f"__block{i}"), F.col("bits").alias(f"__bits{i}"))
        here = F.floor(slot / BLOCK_BITS).cast("long")
        out = out.join(F.broadcast(side), here == F.col(f"__block{i}"), "left")
    slots = _slots(F.col(hash_col), bits)
    both = _bit(F.col("__bits0"), slots[0]) & _bit(F.col("__bits1"), slots[1])
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], both.alias(flag))
