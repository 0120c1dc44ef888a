"""The corpus pipeline: five stages over `documents`, each stored and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from planproof.llm import bagminhash, decontam, packing, pii, quality
from planproof.llm.common import scoped, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the lowest doc_id stays."""
    return bagminhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or re-parameterised, go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes typed placeholders."""
    return pii.mask(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", personal_data_stage),
    ("best_fit_packing", packing_stage),
]
ORACLE_SQL = None  # learned scores, signatures and token ids are beyond SQL; tests compare with brute force


@scoped
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, stored; what the stages stored on the way is removed."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
