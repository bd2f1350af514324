"""Every registered query against its SQL oracle."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert problem is None, problem


def test_entry(spark):
    top = entry.entry(spark).collect()
    assert len(top) == 10
    assert top[0]["LatestTemperature"] >= top[-1]["LatestTemperature"]
