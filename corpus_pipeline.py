"""The corpus pipeline: documents through five stages, each written as Parquet and read again for the next.

Defined results, in all stages: a null text counts as empty; rows that share a doc_id and differ in text are two
documents; of repeated rows (same doc_id and text) one stays after exact dedup; of equal texts the largest doc_id
stays, of near copies the least, null only where there is no other; a null source is a source of its own; columns
beside doc_id, text and source pass through to the last stage, whatever their names (those that begin with `_csift_`
are ours); an empty table of documents gives an empty result, and without labels of both kinds nothing is rejected.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from csift.llm import bpe, exact_dedup, mixing, quality, simhash
from csift.llm.common import drop_folder, shared_folder, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (5-word shingles, similarity 0.8), that of the least doc_id."""
    return simhash.drop_near_copies(docs, similarity=(4, 5))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and offsets of each row."""
    return bpe.encode(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_deduplication),
    ("simhash_near_dedup", near_deduplication),
    ("source_mixing", source_mixing),
    ("byte_bpe", tokenization),
]
#: A trained model, fingerprints and merges can't be put in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's checkpoints go once its table is written, and its table once its successor's is.

    The last stage's input and checkpoints stay, for the result is read from them.
    """
    docs = table(spark, sf_dir, "documents")
    usual = shared_folder(spark)
    folder = f"{usual}/csift-pipeline-{uuid.uuid4().hex}"
    try:
        for k, (name, stage) in enumerate(STAGES):
            spark.sparkContext.setCheckpointDir(f"{folder}/{k}-work")
            out = stage(spark, docs, sf_dir)
            if k == len(STAGES) - 1:
                return out
            out.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            drop_folder(spark, f"{folder}/{k}-work")
            if k:
                drop_folder(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    finally:
        spark.sparkContext.setCheckpointDir(usual)
    return docs
