"""Events with values of 0 and below: the queries of risk variance against their SQL, which follows IEEE 754."""

import math
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barlume.plans import catalogue
from barlume.plans.spec import logarithm, quotient

QUERIES, SQL = catalogue.load()
EVENTS = "event_id bigint, ts timestamp_ntz, event_type string, value double"
INF, NAN = float("inf"), float("nan")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Five symbols of 90 bars: without defects, with a value of 0, with some in turn, with some below 0, and with nothing but 0."""
    path, rng, rows = tmp_path_factory.mktemp("zero"), np.random.default_rng(3), []
    for s in ("none", "zero", "twice", "below", "all"):
        for i in range(360):
            v = float(rng.integers(1, 20_000)) / 100
            if s == "all" or i == 130 and s != "none" or i in (131, 132, 133, 134, 135) and s == "twice":
                v = 0.0
            elif s == "below" and i in (40, 41, 300):
                v = -v
            rows.append((len(rows), datetime(2024, 1, 1) + timedelta(minutes=15 * i + len(rows) % 15), s, v))
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{path}/events.parquet")
    return str(path)


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    want = con.execute(SQL[name])
    names = [c[0] for c in want.description]
    df = QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(names)
    keys = [c for c in ("symbol", "ts", "bar") if c in names]
    # timestamps as texts; None stays apart from NaN
    table = lambda rows: sorted(([str(r[k]) for k in keys], [r[c] for c in names if c not in keys]) for r in rows)
    got, want = table(df.collect()), table([dict(zip(names, r, strict=True)) for r in want.fetchall()])
    assert [k for k, _ in got] == [k for k, _ in want]
    for (k, a), (_, b) in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == (pytest.approx(y, abs=2e-6, nan_ok=True) if isinstance(y, float) else y), k
    return [x for _, a in got for x in a]


def test_ieee_logarithms_and_quotients(frame):
    pairs = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, -0.0), (NAN, 0.0), (None, 0.0), (1.0, None), (0.0, 2.0), (3.0, 2.0), (-INF, 0.0)]
    got = [r["q"] for r in frame([(i, *p) for i, p in enumerate(pairs)], "i int, a double, b double").orderBy("i").select(quotient(F.col("a"), F.col("b")).alias("q")).collect()]
    assert got[5] is got[6] is None and np.array_equal(np.array([x for x in got if x is not None]), [INF, -INF, NAN, -INF, NAN, 0.0, 1.5, -INF], equal_nan=True)
    logs = [r["v"] for r in frame([(i, v) for i, v in enumerate([0.0, -0.0, -2.0, NAN, INF, math.e, None])], "i int, x double").orderBy("i").select(logarithm(F.col("x")).alias("v")).collect()]
    assert logs.pop() is None and np.array_equal(np.array(logs), [-INF, -INF, NAN, NAN, INF, 1.0], equal_nan=True)


@pytest.mark.parametrize("name", ["rv_bpv_jv", "vol_signature", "vol_ctc", "vol_garman_klass", "vol_gk_yang_zhang", "vol_parkinson", "vol_rogers_satchell", "vol_yang_zhang", "vol_components", "legacy_gk", "legacy_yz", "vol_dispersion_flags"])
def test_query_on_zero_prices_equals_sql(spark, folder, name):
    values = same_as_sql(spark, folder, name)
    assert any(isinstance(x, float) and not np.isfinite(x) for x in values)
