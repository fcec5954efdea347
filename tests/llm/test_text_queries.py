"""The registered queries of the text operators against their SQL, on a small sample."""

import os

import pytest

from barlume.llm.queries import QUERIES, SQL

SAMPLE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SAMPLE):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SAMPLE}/{f}')")
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, SAMPLE)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = [[tuple(str(v) for v in r) for r in x] for x in (got.select(columns).collect(), con.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall())]
    assert sorted(rows[0]) == sorted(rows[1]) and rows[0]
