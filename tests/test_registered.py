"""Every registered query against its SQL, over the whole given tables."""

import pytest
from compare import difference

import __spark_entry__ as contract
from subflow.plans.oracle import ORACLE
from subflow.plans.registry import QUERIES

TABLES = "/root/testdata/sf0.001"


def test_every_query_has_its_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.keys() <= contract.queries().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    result = contract.queries()[name](spark, TABLES)
    assert difference(result, contract.oracle_sql()[name], TABLES) == ""


def test_entry(spark):
    assert contract.entry(spark).count() == 2
