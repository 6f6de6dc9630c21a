"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

STAGES lists (name, function); every function takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last
return the columns of ``documents``; the last adds each document's place in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm.decontaminate import remove_contaminated
from parcelflow.llm.language_id import with_languages
from parcelflow.llm.mixing import mix, natural_weights
from parcelflow.llm.near_dedup import deduplicated
from parcelflow.llm.spark_util import discard, read_table, written
from parcelflow.llm.suffix_dedup import without_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (null texts and texts without a letter); the others carry the predicted one."""
    return with_languages(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every group of near-duplicates, that of the smallest doc_id."""
    return deduplicated(docs).select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts 100-byte strings that occur earlier; a document that has nothing left goes."""
    return without_repeats(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a window of a benchmark item."""
    return remove_contaminated(docs, read_table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document in an interleaving of the sources at damped natural weights."""
    return mix(docs, natural_weights(docs), period=None)


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: SQL cannot express the language stage; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed rows that all stages leave; a stage's table is deleted when the next one is written."""
    docs = before = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, before, sf_dir), f"pipeline-{name}")
        if name != STAGES[0][0]:
            discard(before)
        before = docs
    return docs
