"""A corpus pipeline of four stages over ``documents``; every stage works on what the one before it kept.

All stages take tables with any further columns, whatever their names; the first three return the columns they were given, with repeated rows
treated alike. Null and empty texts are scored, linked with nothing, redacted and packed (as one end id) like others; empty tables give empty ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import jaccard_join, packing, pii, quality_gbdt
from corpusloom.llm.common import bounded_batches
from corpusloom.plans.lineage import cut, spread


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality. It learns from the labels of the documents that are there."""
    bounded_batches(spark)
    trees = quality_gbdt.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_gbdt.keep(docs, trees)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard similarity of 0.8 or more, directly or by others."""
    bounded_batches(spark)
    return jaccard_join.deduplicate(docs, n=5, num=80, den=100)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with spans of personal data replaced by their kind."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    bounded_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", keep_quality), ("near_duplicates", keep_one_of_each_group), ("personal_data", redact_personal_data), ("packing", pack_sequences)]
#: Fitted trees, fitted weights and a linear program decide in three stages, which SQL can't say; tests hold run()'s rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
