"""A corpus pipeline over the documents table.

Quality classifier, quality rules, MinHash near-dedup, pseudonyms, packing: each
stage works on all that the one before it kept, its rows are written to the
shared folder and read again, so an executor that is lost costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import common, near_dedup, packing, pii, quality_classifier, quality_rules


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a classifier, trained on the labelled ones, rejects."""
    model = quality_classifier.train(docs, common.table(spark, sf_dir, "labels"))
    return quality_classifier.keep_accepted(docs, model)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that break a quality rule."""
    return quality_rules.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    return near_dedup.keep_one(docs)


def hide_persons(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms; n_chars follows the text."""
    return pii.pseudonymise(docs, pii.key_of(spark)).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 ids."""
    return packing.pack_documents(docs)


STAGES = [("quality classifier", classify), ("quality rules", apply_rules), ("near dedup", drop_copies), ("pii", hide_persons), ("packing", pack)]
#: No SQL can train the classifier; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = common.written(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
