"""Every registered query of the core against its SQL, on the smallest data set."""

import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CORE = [m for m in entry._CORE]


def registered():
    import importlib

    q, s = {}, {}
    for name in CORE:
        m = importlib.import_module(name)
        q.update(m.QUERIES)
        s.update(m.SQL)
    return q, s


QUERIES, SQL = registered()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.skipif(not os.path.exists(DATA), reason="test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted(repr(plain(tuple(r))) for r in df.select(*cols).collect())
    if name not in SQL:
        assert df.columns
        return
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    want = sorted(repr(plain(tuple(r))) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall())
    assert rows == want
