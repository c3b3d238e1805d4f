"""Every registered query on the smallest test tables, against its SQL where there is one."""

import os

import duckdb
import pytest

import __spark_entry__ as spark_entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", spark_entry.queries())
def test_query(spark, duck, name):
    df = spark_entry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    assert rows
    sql = spark_entry.oracle_sql().get(name)
    if sql is None:
        # fits of general data and learned or hashed figures: tested by brute force and invariants
        assert name.startswith(("op", "pipeline")) or name in ("kmeans_find_distance", "kmeans_detect_lineitem")
        return
    result = duck.sql(sql)
    at = [result.columns.index(c) for c in columns]
    assert len(result.columns) == len(columns)
    expected = [tuple(r[i] for i in at) for r in result.fetchall()]
    assert sorted(rows, key=str) == sorted(expected, key=str)


def test_entry(spark):
    assert {r["flag"] for r in spark_entry.entry(spark).collect()} <= {"yes", "no"}
