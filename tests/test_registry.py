"""Registered queries against their SQL: one per product, or all with FOLIOSCOPE_ALL=1."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from tools.compare import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
SOME = ["scan_dump", "write_documents", "join_final_links", "search_dismax", "markup_segments", "series_lookup", "stream_views"]
KEYS = list(contract.queries()) if os.environ.get("FOLIOSCOPE_ALL") else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_sql(spark, con, key):
    ok, note, _ = compare(spark, con, FOLDER, key)
    assert ok, note


def test_contract(spark):
    assert contract.entry(spark).count() == 189
    assert set(contract.oracle_sql()) <= set(contract.queries())
