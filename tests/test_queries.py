"""Every registered query against its check SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from factloom.plans.registry import TABLES
from tools.check import compare

ROOT = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{ROOT}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    status, n, _, note = compare(spark, ROOT, name, QUERIES[name], ORACLES.get(name), con)
    assert status == "ok" or name not in ORACLES and status in ("rows-only", "EMPTY"), note


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
