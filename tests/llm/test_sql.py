"""Every query of this subpackage with SQL gives the rows that the SQL gives on the smallest tables."""

import glob
import os

import duckdb
import pytest

from knotwork.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, FOLDER)
    result = con.execute(queries.SQL[name])
    names = sorted(c[0] for c in result.description)
    assert names == sorted(df.columns)
    order = [[c[0] for c in result.description].index(n) for n in names]
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(tuple(r[i] for i in order) for r in result.fetchall())
