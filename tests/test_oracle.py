"""Every registered query against DuckDB on the same files."""

import pytest

import __spark_entry__ as entry
from tests.compare import FOLDER, database, difference


@pytest.fixture(scope="module")
def connection():
    return database(FOLDER)


OWN = {name: check.sql for name, check in {**entry.STEPS, **entry.SQL_BOX}.items()}


@pytest.mark.parametrize("name", sorted(name for name, sql in OWN.items() if sql))
def test_same_rows_as_sql(spark, connection, name):
    assert difference(spark, connection, FOLDER, name) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["label", "x", "y"]
    assert {r.label for r in df.collect()} == {"total", "n"}


def test_every_query_has_sql():
    assert all(OWN.values())
    assert set(OWN) <= set(entry.queries())
