"""The corpus pipeline: documents are scored, deduplicated, cleared of personal data, mixed and packed.

Each stage takes (spark, docs, sf_dir) and gives the next one's docs. All but the last return the columns of
documents; texts that change get a new n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import mixing, neardup, packing, pii, quality


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels that aren't held out."""
    return quality.stage(spark, docs, sf_dir)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each group of near-duplicates: five words, 0.8."""
    return neardup.keep_one(docs, "doc_id", "text")


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced."""
    return pii.replace(docs, "text", pii.key_of(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.emit(docs, "doc_id", "text", "source")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix's documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs, "doc_id", "text")


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("pii", surrogates), ("mixing", mix), ("packing", pack)]
#: The stages use hashes, a trained model and a tokenizer, which SQL can't express; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
