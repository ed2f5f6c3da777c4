"""Every core query with SQL gives the rows that the SQL gives on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from knotwork.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return value.isoformat() if hasattr(value, "isoformat") else repr(value)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, row)) for row in df.select(*columns).collect())
    result = duck.execute(catalogue.SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert got == want


def test_rows_only_queries_run(spark):
    for name in sorted(set(catalogue.QUERIES) - set(catalogue.SQL)):
        assert catalogue.QUERIES[name](spark, FOLDER).count() >= 0, name
