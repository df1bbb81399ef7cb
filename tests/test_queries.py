"""Every registered query against its SQL. CELLWRIGHT_TEST_SF names another data folder."""

import os

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect

SF_DIR = os.environ.get("CELLWRIGHT_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    good, note = compare(spark, duck, name, SF_DIR)
    assert good, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
