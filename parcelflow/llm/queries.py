"""The registered queries of the text operators, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .alignment import alignment
from .decontaminate import contamination
from .language_id import languages
from .license_scan import known_licenses, license_scan
from .line_dedup import line_dedup
from .lm_scoring import lm_scores
from .mixing import mix, natural_weights
from .near_dedup import near_duplicates
from .prefix_trie import prefix_trie
from .quality import quality_scores
from .spark_util import read_table
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .topk import top_k


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"), known_licenses(spark))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, natural_weights(docs))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read_table(spark, sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(read_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(read_table(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_quality_classifier, op2_decontamination, op3_license_scan, op4_source_mixing, op5_token_counts,
        op6_minhash_near_dedup, op7_suffix_array_dedup, op8_exact_top_k, op9_lm_scoring, op10_language_id,
        op11_token_alignment, op12_line_dedup, op13_prefix_trie,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": oracles.OP2,
        "op3_license_scan": oracles.license_sql(),
        "op4_source_mixing": oracles.OP4,
        "op6_minhash_near_dedup": oracles.OP6,
        "op8_exact_top_k": oracles.OP8,
        "op12_line_dedup": oracles.OP12,
        "op13_prefix_trie": oracles.op13_sql(),
    }
