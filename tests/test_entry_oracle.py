"""Every registered query against its DuckDB oracle at sf0.001 (the driver's
check, at the smallest scale), plus the entry smoke test."""

import pytest

import __spark_entry__ as entry
from tableguard.plans.registry import QUERIES, load_all
from tests.oracle_harness import compare, duck_connection

SF = "/root/testdata/sf0.001"
load_all()
KEYS = sorted(QUERIES)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["column", "grp", "label", "rows", "spans"]
    assert df.count() >= 0


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    r = compare(spark, key, SF, con)
    assert r["status"] in ("match", "rows-only"), r
