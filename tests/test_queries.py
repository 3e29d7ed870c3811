"""Every query with an SQL form gives the SQL's rows."""

import glob
import os

import duckdb
import pytest

from lakelens.queries import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    if name in ORACLE:
        r = con.execute(ORACLE[name].replace("/sf0.01/", "/sf0.001/"))
        at = [[d[0] for d in r.description].index(c) for c in cols]
        assert got == sorted(str(tuple(x[i] for i in at)) for x in r.fetchall())
