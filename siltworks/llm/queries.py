"""One registered query for each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltworks.llm import bpe, chat, classifier, exact_dedup, html_extract, importance, licences, minhash, mixing, quality_rules, topk, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, table: str, report: Callable[[DataFrame], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: report(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    if oracle:
        ORACLES[name] = oracle


_register("op1_minhash_dedup", "documents", minhash.near_dedup_report, minhash.ORACLE)
_register("op2_quality_classifier", "documents", classifier.quality_report)
_register("op3_html_text", "pages", html_extract.extract_report)
_register("op4_chat_rotation", "conversations", chat.chat_report, chat.ORACLE)
_register("op5_exact_dedup", "documents", exact_dedup.dedup_report, exact_dedup.ORACLE)
_register("op6_licence_scan", "documents", licences.licence_report)
_register("op7_mix_sources", "documents", mixing.mix_report, mixing.ORACLE)
_register("op8_warc_revisits", "pages", warc.warc_report, warc.ORACLE)
_register("op9_quality_rules", "documents", quality_rules.quality_report, quality_rules.ORACLE)
_register("op10_byte_bpe", "documents", bpe.bpe_report)
_register("op12_top_inner_products", "embeddings", topk.search_report, topk.ORACLE)
_register("op13_whitening", "embeddings", whitening.whitening_report)


def _importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in ("documents", "benchmark"))
    return importance.importance_report(docs, target)


QUERIES["op11_importance_draw"] = _importance
ORACLES["op11_importance_draw"] = importance.ORACLE
