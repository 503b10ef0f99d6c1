"""Registered queries against their SQL, and the shape of the others."""

import os

import pytest
from compare import compare, connect

from clausegrid.llm.queries import QUERIES

SF = os.environ.get("CLAUSEGRID_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_sql(spark, name):
    query, sql = QUERIES[name]
    diff, rows = compare(spark, SF, connect(SF), name, query, sql)
    assert diff is None and rows > 0


def test_fourteen_queries():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)] + ["pipeline"]


def test_pipeline_stages(spark):
    from pyspark.sql import functions as F

    import corpus_pipeline as p
    from clausegrid.llm.common import keep

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in p.STAGES:
        docs = keep(stage(spark, docs, SF), f"test-{name}")
        found = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
        assert found and found <= ids
        ids = found
        if name != "packing":
            assert docs.columns == columns
    assert docs.agg(F.max("length")).first()[0] <= 2048
