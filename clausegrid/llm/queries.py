"""Queries of this folder's operators and the pipeline: name -> (query, SQL or None where SQL can't express it)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.llm import (
    op1_fingerprints,
    op2_warc,
    op3_licenses,
    op4_topk,
    op5_mixing,
    op6_html,
    op7_packing,
    op8_quality,
    op9_sharding,
    op10_near_dedup,
    op11_whitening,
    op12_runs,
    op13_secrets,
)
from clausegrid.llm.common import table

TOKENIZER = "CLAUSEGRID_TOKENIZER"


def tokenizer_path() -> str:
    """The tokenizer's file: a setting, else the installed public one."""
    if path := os.environ.get(TOKENIZER):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_fingerprints.chained(table(spark, sf_dir, "documents"))


def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_warc.archive_round_trip(spark, table(spark, sf_dir, "pages")).drop("target_uri")


def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_licenses.scan(table(spark, sf_dir, "documents"))


def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_topk.topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_mixing.report(table(spark, sf_dir, "documents"))


def html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_html.extract_pages(table(spark, sf_dir, "pages"))


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_sharding.shard(table(spark, sf_dir, "documents"))


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_near_dedup.link(table(spark, sf_dir, "documents"), words=2)


def whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_whitening.report(table(spark, sf_dir, "embeddings"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_runs.report(table(spark, sf_dir, "documents"))


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_secrets.report(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {
    "op1_edit_fingerprints": (fingerprints, None),
    "op2_warc_chunks": (warc, op2_warc.SQL),
    "op3_license_scan": (licenses, op3_licenses.sql()),
    "op4_exact_topk": (topk, op4_topk.SQL),
    "op5_source_mixing": (mixing, op5_mixing.SQL),
    "op6_html_extraction": (html, None),
    "op7_packing": (packing, None),
    "op8_quality_classifier": (quality, None),
    "op9_sharding": (sharding, None),
    "op10_near_dedup": (near_dedup, op10_near_dedup.SQL),
    "op11_whitening": (whitening, None),
    "op12_periodic_runs": (runs, None),
    "op13_secret_scan": (secrets, op13_secrets.sql()),
    "pipeline": (pipeline, None),
}
