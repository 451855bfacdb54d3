"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe_rounds, common, debruijn, kneser_ney, media_flac, packing, quality_rules, secrets_crf, simhash_gray, token_files, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.table(spark, sf_dir, "documents")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets_crf": lambda s, d: secrets_crf.digest(_documents(s, d)),
        "op2_simhash_near_dedup": lambda s, d: simhash_gray.digest(_documents(s, d)),
        "op3_toxicity": lambda s, d: toxicity.digest(_documents(s, d), common.table(s, d, "labels")),
        "op4_packing": lambda s, d: packing.packed(_documents(s, d), public_tokenizers.path("byte_bpe_50k.json")),
        "op5_bpe_rounds": lambda s, d: bpe_rounds.digest(_documents(s, d), public_tokenizers.path("word_bpe_49k.json")),
        "op6_token_files": lambda s, d: token_files.digest(_documents(s, d), public_tokenizers.path("word_bpe_49k.json")),
        "op7_debruijn_dedup": lambda s, d: debruijn.digest(_documents(s, d)),
        "op8_kneser_ney": lambda s, d: kneser_ney.classify(_documents(s, d), common.table(s, d, "labels")),
        "op9_quality_rules": lambda s, d: quality_rules.digest(_documents(s, d), common.table(s, d, "labels")),
        "op10_media_flac": lambda s, d: media_flac.media_digest(_documents(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {}
