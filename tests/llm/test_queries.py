"""Registered queries with SQL against the other engine; all others build and give whole results."""

import pytest

import corpus_pipeline
from tallymark.llm import queries
from tests.check_oracles import compare, connect

SF = "/root/testdata/sf0.001"
TABLES = {"op1_chat_format": None, "op3_url_filters": "pages", "op13_conversation_repair": None}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - {"op1_chat_format", "op13_conversation_repair"}))
def test_a_row_for_each_row(spark, name):
    table = spark.read.parquet(f"{SF}/{TABLES.get(name, 'documents')}.parquet")
    assert queries.QUERIES[name](spark, SF).count() == table.count()


def test_registered():
    assert set(corpus_pipeline.QUERIES) == {*queries.QUERIES, "pipeline"}
    assert sum(q.startswith("op") for q in queries.QUERIES) == 13
