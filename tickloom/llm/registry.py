"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import byte_bpe, exact_dedup, fingerprint, near_dedup, packing, pii, quality_lm, suffix_dedup, toxicity, url_filter

OPERATORS = {
    "op1_quality_kneser_ney": quality_lm,
    "op2_minhash_lsh_forest": near_dedup,
    "op3_url_filter": url_filter,
    "op4_byte_bpe": byte_bpe,
    "op5_best_fit_packing": packing,
    "op6_fingerprint_cws": fingerprint,
    "op7_toxicity_ordinal": toxicity,
    "op8_pii_weak_supervision": pii,
    "op9_exact_dedup": exact_dedup,
    "op10_suffix_dedup": suffix_dedup,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {name: module.query for name, module in OPERATORS.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    sql = {name: getattr(module, "ORACLE_SQL", None) for name, module in OPERATORS.items()} | {"pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: text for name, text in sql.items() if text}
