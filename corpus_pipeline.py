"""Corpus pipeline: classify, apply rules, remove near-duplicates, mix sources, pack.

Every stage takes (spark, docs, sf_dir) and reads what the stage before it
wrote; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridpulse.llm import minhash_dedup, mixing, packing, quality_classifier, quality_rules
from gridpulse.llm._stage import small_batches, stage


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts; it is fitted on the labelled ones among ``docs``.

    Null and empty texts are judged like any other; repeated rows stay
    repeated, other columns as they are; an empty table gives no rows.
    """
    small_batches(spark)
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.accepted_documents(docs, model)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host passes.

    Null, empty and wordless texts fail; rows without source are judged by
    the base rules alone; repeated rows stay repeated.
    """
    small_batches(spark)
    return quality_rules.kept_documents(docs)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest doc_id.

    Documents without words, and rows without doc_id, are alone. Of rows that
    repeat a doc_id with equal texts one stays.
    """
    small_batches(spark)
    return minhash_dedup.kept_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: whole documents as often as their source's target takes them, at most twice.

    Null and wordless texts have no words to give and go; rows without source
    are a source.
    """
    small_batches(spark)
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in their sequences; null and empty texts are one end id, long texts are cut."""
    small_batches(spark)
    return packing.pack(docs, special=True)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("near duplicates", remove_copies),
    ("source mix", mix),
    ("packing", pack),
]

#: The fitted ensemble, the signatures and the tokenizer cannot be expressed in SQL;
#: tests hold rules and near-duplicates of the stages against the operators' SQL and the rest against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over ``documents``; every stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
