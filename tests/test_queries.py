"""Every query against its SQL in DuckDB on the smallest sample, and the flagship query."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry_points
from barlume.plans import catalogue

SAMPLE = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.load()

pytestmark = pytest.mark.skipif(not os.path.isdir(SAMPLE), reason="no sample data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SAMPLE):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SAMPLE}/{f}')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "if":
            df[c] = df[c].astype(float)
        elif df[c].dtype.kind == "M":
            df[c] = df[c].astype("datetime64[us]").astype(str)
        else:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = canonical(QUERIES[name](spark, SAMPLE).toPandas()), canonical(duck.sql(SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind == "f" and want[c].dtype.kind == "f":
            np.testing.assert_allclose(got[c], want[c], atol=2e-6, err_msg=c)
        else:
            assert got[c].where(got[c].notna(), None).tolist() == want[c].where(want[c].notna(), None).tolist(), c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"gmm_regimes", "rolling_mi"}))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SAMPLE).count() > 0


def test_rolling_information_has_a_row_for_each_pair_of_windows(spark, duck):
    folder = SAMPLE.replace("0.001", "0.01")  # the smallest sample has one window a symbol
    bars = dict(duck.sql(f"SELECT event_type, count(DISTINCT date_trunc('hour', ts)) FROM read_parquet('{folder}/events.parquet') GROUP BY 1").fetchall())
    got = QUERIES["rolling_mi"](spark, folder).groupBy("symbol").count().collect()
    assert {r["symbol"]: r["count"] for r in got} == {s: (n - 120) // 60 for s, n in bars.items()}


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(SQL) <= set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", ["mutual_information", "gmm_regimes"])
def test_information_and_mixture_take_every_symbol(spark, duck, name):
    bars = dict(duck.sql("SELECT event_type, count(DISTINCT date_trunc('hour', ts)) FROM events GROUP BY 1").fetchall())
    got = QUERIES[name](spark, SAMPLE).groupBy("symbol").count().collect()
    assert {r["symbol"]: r["count"] for r in got} == (bars if name == "gmm_regimes" else dict.fromkeys(bars, 4))


@pytest.mark.parametrize("name", ["mi_bootstrap", "mi_permutation"])
def test_resampling_takes_ten_thousand_replicates(spark, name, monkeypatch):
    from barlume.operators import selection

    real, drawn = selection.grouped_scores, []
    monkeypatch.setattr(selection, "grouped_scores", lambda *a: drawn.append(real(*a).persist()) or drawn[-1])
    got = QUERIES[name](spark, SAMPLE).collect()
    counts = {(r["symbol"], r["feature"]): r["count"] for r in drawn[0].groupBy("symbol", "feature").count().collect()}
    drawn[0].unpersist()
    assert len(got) == 20 and set(counts.values()) == {10_000} and set(counts) == {(r["symbol"], r["feature"]) for r in got}
    assert any(0 < r["p_value"] * 10_000 % 250 for r in got)  # finer than 40 replicates tell
