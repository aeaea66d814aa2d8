"""Every registered query against its SQL; size by CARDFLOW_SF (default 0.001)."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle import compare, duck

SF_DIR = f"/root/testdata/sf{os.environ.get('CARDFLOW_SF', '0.001')}"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    rows, problems = compare(spark, con, queries()[name], SQL.get(name), SF_DIR)
    assert not problems
    assert rows > 0 or name.startswith("w11")


def test_entry(spark):
    assert entry(spark).count() > 0
