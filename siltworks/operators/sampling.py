"""Deterministic samples by hash, mixtures and low-discrepancy sequences."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions.hashing import draw
from siltworks.ship import ship_code


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, in hash order."""
    return df.orderBy(draw(F.col(key), seed), key).limit(n)


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """All rows in a random order that any run repeats."""
    return df.orderBy(draw(F.col(key), seed), key)


def sample_pairs(spark: SparkSession, n_items: int, n_pairs: int, seed: int) -> DataFrame:
    """``n_pairs`` index pairs with replacement."""
    at = lambda side: F.floor(draw(F.concat_ws("/", F.lit(side), F.col("id")), seed) * n_items).cast("long")
    return spark.range(n_pairs).select("id", at("a").alias("a"), at("b").alias("b"))


def mixture(key: Column, seed: int, classes: Sequence[str], weights: Sequence[float]) -> Column:
    """A class for each key by cumulative weights."""
    u, total, at = draw(key, seed), float(sum(weights)), 0.0
    out = None
    for name, weight in zip(classes[:-1], weights[:-1], strict=True):
        at += weight / total
        out = F.when(u < at, name) if out is None else out.when(u < at, name)
    return out.otherwise(classes[-1]) if out is not None else F.lit(classes[-1])


def pick_frames(frames: Column, key: Column, n: int, seed: int) -> Column:
    """Up to ``n`` elements of an array, chosen by hash, in hash order."""
    marked = F.transform(frames, lambda f: F.struct(draw(F.concat_ws("/", key, f.cast("string")), seed).alias("u"), f.alias("f")))
    return F.transform(F.slice(F.array_sort(marked), 1, n), lambda x: x["f"])


def withhold(value: Column, key: Column, seed: int, share: float) -> Column:
    """Null for a ``share`` of the keys."""
    return F.when(draw(key, seed) >= share, value)


def radical_inverse(index: Column, base: int, digits: int = 40) -> Column:
    """The digits of a number mirrored at the point: element ``index`` of the van der Corput sequence."""
    places = F.sequence(F.lit(0), F.lit(digits - 1))
    power = lambda k: F.pow(F.lit(float(base)), k.cast("double"))
    digit = lambda k: F.pmod(F.floor(index / power(k)), F.lit(base))
    return F.aggregate(F.transform(places, lambda k: digit(k) / power(k + 1)), F.lit(0.0), lambda s, x: s + x)


def jitter(index: Column, phases: int = 16) -> Column:
    """Sub-pixel offsets in [-0.5, 0.5): bases 2 and 3 over a cycle of ``phases``."""
    at = F.pmod(index, F.lit(phases)) + 1
    return F.struct((radical_inverse(at, 2, 20) - 0.5).alias("x"), (radical_inverse(at, 3, 20) - 0.5).alias("y"))


def _edited(text: str, prefix: str, by: float, drop: float, upper: float) -> str:
    """A text's words, each dropped, in upper case or kept by its ``draw`` (52 bits, one hash a word)."""
    start, lost, raised = f"{prefix}/".encode(), drop * by * (1 << 52), (drop + upper) * by * (1 << 52)
    kept = []
    for i, word in enumerate(text.encode().split(b" ")):
        u = int.from_bytes(hashlib.md5(start + b"%d" % i).digest()[:7]) >> 4
        if word and u >= lost:
            kept.append(word.upper() if u < raised else word)  # of bytes: a-z only
    return b" ".join(kept).decode()


def text_copies(df: DataFrame, key: str, text: str, seed: int, drop: float = 0.05, upper: float = 0.1) -> DataFrame:
    """Light and heavy synthetic copies of texts for calibration: ``key, kind, copy``.

    Both lose words and have some with a-z in upper case, by a hash of key, position and seed; heavy copies three times as often.
    """
    ship_code(df.sparkSession)
    kinds = F.explode(F.array(F.struct(F.lit("light").alias("kind"), F.lit(1.0).alias("by")), F.struct(F.lit("heavy").alias("kind"), F.lit(3.0).alias("by"))))
    rows = df.select(F.col(key), F.col(text).alias("__t"), kinds.alias("__k")).select(key, "__t", "__k.kind", "__k.by")

    @F.pandas_udf("string")
    def copies(texts: pd.Series, prefixes: pd.Series, by: pd.Series) -> pd.Series:
        found = zip(texts, prefixes, by, strict=True)
        return pd.Series([None if t is None else _edited(t, p, b, drop, upper) for t, p, b in found], dtype=object)

    prefix = F.concat(F.lit(f"{seed}/"), F.concat_ws("/", F.col(key), F.col("kind")))
    return rows.select(key, "kind", copies("__t", prefix, "by").alias("copy"))
