"""A corpus pipeline of five stages over ``documents``.

Quality rules drop documents; SimHash keeps one document of each group of near
copies; substring dedup removes repeated passages; secrets are replaced by a
mark; the rest is packed into training sequences. Each stage reads what the one
before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm import common, debruijn, packing, quality_rules, secrets_crf, simhash_gray

#: SQL cannot express the stages; ``tests/llm/test_pipeline.py`` holds them against plain versions.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs, common.table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the row with the least id, ties by fingerprint, text and other columns."""
    return simhash_gray.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated words; a text that loses none stays as it is, one that loses all is empty."""
    return _counted(debruijn.cut_repeats(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each secret replaced."""
    return _counted(secrets_crf.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("secret_scans", secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again, the one before it goes."""
    docs, last = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = common.scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            common.remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
