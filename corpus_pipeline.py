"""A training corpus in four stages: quality classifier, near-duplicates, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to the shared folder and read again as the next
stage's `docs`. All but the last keep the columns of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausegrid.llm import op5_mixing, op7_packing, op8_quality, op10_near_dedup
from clausegrid.llm.common import keep, table
from clausegrid.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return op8_quality.select_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (shingles of five words, similarity of 0.8 or more)."""
    return op10_near_dedup.deduplicate(docs, words=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken to their target weights: a document appears as often as the mix takes it."""
    return op5_mixing.choose(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return op7_packing.pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: The classifier, the packing and their tokens can't be expressed in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
