"""Every registered query against its SQL counterpart."""

import pytest

import __spark_entry__ as entry
import workloads
from tests.check_oracles import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_a_counterpart():
    assert set(workloads.QUERIES) == set(workloads.ORACLES)
    assert set(workloads.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(workloads.QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    assert compare(df, con, entry.oracle_sql()[name]) is None
