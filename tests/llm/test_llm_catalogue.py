"""The registered queries of this package against their SQL, and the pipeline, on the smallest tables."""

import pytest
from compare import assert_same, database
from pyspark.sql import functions as F

import corpus_pipeline
from netledger.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    assert_same(queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name]))


def test_pipeline_stages_keep_their_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        ids = {r.doc_id for r in docs.collect()}
        assert ids <= seen and ids, name
        seen = ids
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count() and out.filter(F.size("ids") != F.col("n_tokens")).count() == 0


def test_pipeline_of_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
