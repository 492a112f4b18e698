"""The registered queries of the subpackage: against SQL where there is any, else that they run."""

import os

import pytest

from palimpsest.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(DATA), reason="test data")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = {tuple(r) for r in df.collect()}
    assert rows
    if name in queries.SQL:
        import duckdb

        c = duckdb.connect()
        for t in ("documents", "eval_seeds", "vectors", "memories"):
            c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        cols = ", ".join(df.columns)
        assert rows == set(c.sql(f"select {cols} from ({queries.SQL[name]})").fetchall())
