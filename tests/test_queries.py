"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as contract
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
SLOW = [n for n in contract.queries() if n.startswith("train_")]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in contract.queries() if n not in SLOW])
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, name, SF) is None


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_profiles_every_column(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 11 and all(r["total"] == rows[0]["total"] > 0 for r in rows)
