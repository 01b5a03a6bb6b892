"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from gridpulse.llm import (
    conversation_repair,
    embedding_dedup,
    language_id,
    line_dedup,
    minhash_dedup,
    mixing,
    packing,
    quality_classifier,
    quality_rules,
    toxicity,
    url_filter,
    warc_archive,
    whitening,
)

from gridpulse.llm._stage import small_batches

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_language_id": language_id.op1_language_id,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_hnsw_dedup": embedding_dedup.op3_hnsw_dedup,
    "op4_minhash_dedup": minhash_dedup.op4_minhash_dedup,
    "op5_warc_archive": warc_archive.op5_warc_archive,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_toxicity_grammar": toxicity.op7_toxicity_grammar,
    "op8_retrieval_packing": packing.op8_retrieval_packing,
    "op9_source_mixing": mixing.op9_source_mixing,
    "op10_rule_ensemble": quality_classifier.op10_rule_ensemble,
    "op11_whitening": whitening.op11_whitening,
    "op12_line_dedup": line_dedup.op12_line_dedup,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}


def importable(query: Query) -> Query:
    """``query`` with small Arrow batches, and this code on the path of a local session's workers.

    On a cluster the package comes with ``--py-files``.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = str(Path(__file__).resolve().parents[2])
        variables = spark.sparkContext.environment
        held = variables.get("PYTHONPATH", "")
        if spark.sparkContext.master.startswith("local[") and root not in held.split(":"):
            variables["PYTHONPATH"] = f"{root}:{held}" if held else root
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def registered() -> dict[str, Query]:
    return {name: importable(query) for name, query in QUERIES.items()}


def statements() -> dict[str, str]:
    """SQL of the queries that need no trained model, tokenizer or 64-bit hash order."""
    return {
        "op3_hnsw_dedup": embedding_dedup.ORACLE_SQL,
        "op4_minhash_dedup": minhash_dedup.ORACLE_SQL,
        "op5_warc_archive": warc_archive.ORACLE_SQL,
        "op6_quality_rules": quality_rules.ORACLE_SQL,
        "op12_line_dedup": line_dedup.ORACLE_SQL,
        "op13_conversation_repair": conversation_repair.ORACLE_SQL,
    }
