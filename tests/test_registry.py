"""Every registered query with SQL gives the rows DuckDB gives."""

import pytest

import __spark_entry__ as repo
from check import compare, database

SF_DIR = "/root/testdata/sf0.01"
SQL = repo.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return database(SF_DIR)


@pytest.mark.parametrize("name", list(repo.queries()))
def test_query(name, spark, db):
    outcome = compare(name, spark, db, SF_DIR, SQL.get(name))
    assert outcome.startswith("ok" if name in SQL else "rows"), outcome


def test_every_sql_has_a_query():
    assert set(SQL) <= set(repo.queries())


def test_entry(spark):
    assert repo.entry(spark).count() > 0
