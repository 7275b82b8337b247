"""A corpus pipeline: quality rules, quality classifier, near-duplicate removal, packing.

Each stage takes what the one before kept, and all but the last return the columns of documents. Results are written to
the shared folder between stages, so a lost executor costs no stage.

A null or empty text fails the base rule and goes in the first stage; a null id or any other null column is kept as it is,
and a null language has no cutoffs of its own. Very long texts are judged and packed whole. Of repeated rows and copies one
stays, the one with the least id. Ties are settled by ids, so runs agree. An empty table gives no rows, and documents may have
any further columns, of whatever name: they travel along to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import minhash_dedup, packing, quality_gam, quality_rules
from fieldloom.llm.storage import materialize


def rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the risk-controlled cutoffs keep."""
    return quality_rules.keep(docs, quality_rules.read_labels(spark, sf_dir))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model predicts as good."""
    return quality_gam.keep(docs, quality_rules.read_labels(spark, sf_dir))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, linked at a similarity of 0.8 or more."""
    return minhash_dedup.keep(docs, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining documents with their place in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", rule_stage), ("quality classifier", classifier_stage), ("near duplicates", near_duplicate_stage), ("best-fit packing", packing_stage)]
#: Calibration, boosting and bin filling have no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages make of the documents in sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
