"""From raw documents to token ids: quality, toxicity, near-duplicates, source mix, SentencePiece."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import compression, mixing, near, pieces, toxicity
from tidemark.llm.texts import saved

PIECE_FILE = "piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the word rules and compression bands keep."""
    return compression.keep_quality(docs)


def without_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a sentence that is likely toxic, by what the labels of these documents teach."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by shingles of five words."""
    return near.keep_first(docs, how=near.Nearness(words=5))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeated(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text, and whether they decode to it."""
    return pieces.round_trip(docs, public_tokenizers.path(PIECE_FILE)).drop("decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", without_toxicity),
    ("near-duplicates", without_near_duplicates),
    ("source mix", mixed_sources),
    ("SentencePiece", token_ids),
]

# Compression, training, sketches and vocabularies are not expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
