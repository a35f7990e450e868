"""Every registered query equals its DuckDB oracle on the smallest driver
tables (row count, column names, order-insensitive value hash)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import compare, duck  # noqa: E402
from tickerwire.plans import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"
# the corpus queries have tests of their own
KEYS = sorted(catalog.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    missing = set(KEYS) - set(entry.oracle_sql())
    assert not missing, missing


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    r = compare(spark, con, key, entry.queries()[key], entry.oracle_sql().get(key), SF)
    assert r["status"] == "match", r


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["ArticleName", "Industry", "NewsSource", "PublishDate", "Sector", "Ticker", "Url"]
    assert df.count() >= 0
