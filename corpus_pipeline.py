"""A corpus pipeline over `documents`: each stage reads what the one before it kept and wrote.

Every stage is (spark, docs, sf_dir) to a DataFrame. All but the last return the columns of `documents`: rejected documents go, of a
group of near-duplicates one stays, secrets are masked; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from samplewright.llm import packing, pivots, quality, secret_scan
from samplewright.llm.queries import tokenizer
from samplewright.session import scratch_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Null and empty texts stay or go by their score; rows that repeat go together;
    with no labels every document stays; an empty table stays empty."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates: the document with the smallest id of each group stays, a null id only where there is no other. Null, empty and blank
    texts are one group; of rows that repeat one stays; texts of any length are compared whole."""
    return pivots.keep_first(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret masked; null texts stay null, all other columns as they are, and no row goes."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows for training: a row per piece of every document; null and empty texts are one id, the end."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), end=2, grain=packing.GRAIN)


STAGES = [
    ("quality_classifier", good_quality), ("simhash_near_dedup", one_of_each_group), ("secret_scan", without_secrets), ("packing", packed)]

#: The classifier and the scanner learn, and no SQL states what they learned; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
