"""The queries op1_ to op10_ and their SQL. Each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ego_join
from . import hyperminhash as minhash
from . import license_scan as licenses
from . import quality_rules as quality
from .bpe_codec import encoding_digest
from .html_mincut import extract_text
from .packing import pack
from .pseudo_likelihood import pseudo_likelihood
from .runtime import read
from .token_counts import token_counts
from .toxicity import toxicity, train

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, read(spark, sf_dir, "labels")))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digest(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.near_vectors(read(spark, sf_dir, "embeddings"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_quality_rules": op2_quality_rules,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_bpe_codec": op6_bpe_codec,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_html_extraction": op8_html_extraction,
    "op9_token_counts": op9_token_counts,
    "op10_license_scan": op10_license_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": quality.oracle_sql(),
    "op5_minhash_dedup": minhash.oracle_sql(),
    "op7_embedding_dedup": ego_join.oracle_sql(),
    "op10_license_scan": licenses.oracle_sql(),
}
