"""Registered queries against DuckDB. All of them run with TRACEWRIGHT_ALL_QUERIES=1."""

import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry_module
from tracewright.plans.catalog import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["file_profile", "edges_dedup", "components", "split_assignment", "slice_hash", "window_labels", "graded_attempts", "dev_score", "draws", "near_dups", "early_stop"]
NAMES = sorted(entry_module.oracle_sql()) if os.environ.get("TRACEWRIGHT_ALL_QUERIES") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    return float(value) if isinstance(value, (int, float, Decimal)) else value


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry_module.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert ours == theirs
