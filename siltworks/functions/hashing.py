"""Stable hashes: ids, buckets and draws that any engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_of(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


def short_id(text: Column, digits: int = 10) -> Column:
    return F.substring(md5_of(text), 1, digits)


def md5_mod(text: Column, modulus: int) -> Column:
    """The 128-bit MD5 modulo a number below 2**31, by Horner's rule over four 32-bit chunks."""
    digest, step = md5_of(text), (1 << 32) % modulus
    out = F.lit(0).cast("long")
    for k in range(4):
        chunk = F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long")
        out = F.pmod(out * step + F.pmod(chunk, F.lit(modulus)), F.lit(modulus))
    return out


def seeded_bucket(key: Column, seed: int | str, modulus: int = 10_000) -> Column:
    """``md5(seed/key)`` modulo ``modulus``."""
    return md5_mod(F.concat(F.lit(f"{seed}/"), key.cast("string")), modulus)


def draw(key: Column, seed: int | str) -> Column:
    """A number in [0, 1) with 52 random bits, by a hash of seed and key."""
    digest = md5_of(F.concat(F.lit(f"{seed}/"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit numbers."""
    return F.bit_count(a.bitwiseXOR(b))


def bits_hex(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def hash64(text: Column) -> Column:
    """The first 64 bits of an MD5 as a signed number."""
    return F.conv(F.substring(md5_of(text), 1, 16), 16, -10).cast("long")
