"""Column expressions for words and ASCII case, shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space, as in ``[\x20\x09-\x0D]``.
SPACES = "[\\x20\\x09-\\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII takes the byte-wise path of ``lower``."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The runs of ``[^\\x20\\x09-\\x0D]`` of a text, in order; no words for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")
