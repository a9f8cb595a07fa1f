"""A corpus pipeline of five stages: toxicity, exact and near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadlake.llm import common, exact_dedup, mixing, packing, simhash, toxicity


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.drop_toxic(spark, docs, common.table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.deduplicate(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts with SimHashes within 3 bits, or similar by 0.8 on five-word shingles, directly or through others, the one
    with the smallest doc_id stays."""
    return simhash.deduplicate(spark, docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences and places."""
    return packing.pack_public(spark, docs)


STAGES = [("toxicity", clean), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mix_sources", mixed), ("best_fit_packing", packed)]

#: The stages learn, sketch and tokenize; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = common.stage(spark, docs, f"pipeline-{name}")
    return docs
