import os

import pytest

import __spark_entry__ as contract
from tests.compare import connect, differences

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    result = contract.queries()[name](spark, SF_DIR)
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert not result.isEmpty()
    else:
        assert differences(result, duck, sql) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
