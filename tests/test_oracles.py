"""Every registered query equals its SQL oracle at the smallest scale."""

import pytest

import __spark_entry__ as entry
from check import compare, open_oracle
from flowgraph.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return open_oracle(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    assert compare(spark, oracle, name, SF) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["salesOrder", "delivered", "billed"] and df.count() > 0
