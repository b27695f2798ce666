"""Every registered query with SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from oracle_check import differences, duck
from panelspark import registry

FOLDER = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_key_with_sql_is_registered():
    assert set(ORACLES) <= set(entry.queries())
    without = set(registry.queries()) - set(ORACLES)
    assert all(key.endswith(("_model", "_model_b")) for key in without)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, con, key):
    assert differences(entry.queries()[key](spark, FOLDER), con, ORACLES[key]) == []


def test_entry(spark):
    assert entry.entry(spark).count() == 1
