"""Every registered query runs, and equals its check in DuckDB where it has one."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    _, problems = compare(spark, con, SF, queries()[name], oracle_sql().get(name))
    assert not problems, "\n".join(problems)


def test_entry(spark):
    assert entry(spark).count() == 10


def test_names():
    assert set(oracle_sql()) <= set(queries())
