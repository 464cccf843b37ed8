"""The corpus pipeline: documents in, token ids out, one stage after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltworks.llm import bpe, exact_dedup, minhash, mixing, quality_rules
from siltworks.llm.scale import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines go from the texts; documents that then lose too much, or fail the base rules, go whole.

    Null, empty and blank texts have too few words and go; rows that repeat are judged alike; a text of any length is read
    whole; null ids and sources pass; other columns pass, ``n_chars`` is counted anew where it exists.
    """
    return quality_rules.keep_clean(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays.

    Null and empty texts are equal; a null id loses to any other, and stays only where its group has no other; rows that
    repeat the largest id of a group all stay; other columns pass.
    """
    return exact_dedup.drop_copies(docs)


def distinct_enough(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five words, similarity 0.8) the document with the least id stays.

    Texts without words stay; rows are told by id and text, so one without an id, or with one that repeats, does not take
    others along; rows that repeat the staying one all stay; a class without any id keeps its rows.
    """
    return minhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it.

    Null and empty texts have size 0 and come as often as chance says; a null source is a source; rows that repeat id, size
    and source are taken or left together; a single very long document is taken only where its source's target holds it.
    """
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of their decoding, a row for each copy of a document.

    Null and empty texts have no ids; null ids and rows that repeat come out as they came; texts are encoded whole.
    """
    return bpe.bpe_report(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", clean),
    ("exact_dedup", distinct_texts),
    ("minhash_dedup", distinct_enough),
    ("mix_sources", mix),
    ("byte_bpe", tokens),
]

#: The last stage's ids follow a tokenizer's merge ranks, which SQL does not express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = scratch_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
