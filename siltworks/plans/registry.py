"""Where queries register: a name, what it covers, and SQL that any engine can check it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``covers`` lists the inventory rows it shows."""

    def put(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        COVERS[name] = covers
        if sql:
            ORACLES[name] = sql
        return run

    return put


def duck_bucket(text: str, modulus: int = 10_000) -> str:
    """SQL for the 128-bit MD5 of ``text`` modulo ``modulus``."""
    step, out = (1 << 32) % modulus, "0"
    for k in range(4):
        out = f"(({out}) * {step} + ('0x' || substr(md5({text}), {1 + 8 * k}, 8))::BIGINT % {modulus}) % {modulus}"
    return out


def duck_draw(text: str) -> str:
    """SQL for a number in [0, 1) from the first 52 bits of an MD5."""
    return f"('0x' || substr(md5({text}), 1, 13))::BIGINT::DOUBLE / {float(1 << 52)!r}::DOUBLE"
