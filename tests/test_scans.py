"""Parallel scans against the single pass over each symbol, with symbols that span many ranges and ranges with many symbols."""

import numpy as np
import pytest

from barlume.operators import recursive, scans


@pytest.fixture
def bars(frame):
    rng = np.random.default_rng(1)
    sizes = {"long": 900, "a": 3, "b": 40, "c": 1, "d": 200, "e": 60}
    rows = []
    for s, n in sizes.items():
        x = 100 + rng.normal(size=n).cumsum()
        rows += [(s, t, float(v + 1 + rng.random()), float(v - 1 - rng.random()), float(v)) for t, v in enumerate(x)]
    rng.shuffle(rows)
    return frame([(str(s), int(t), float(h), float(lo), float(c)) for s, t, h, lo, c in rows], "symbol string, ts int, high double, low double, close double")


def same(a, b, outputs):
    a, b = ({(r["symbol"], r["ts"]): [r[o] for o in outputs] for r in x.collect()} for x in (a, b))
    assert set(a) == set(b) and a
    for k, v in a.items():
        np.testing.assert_allclose(v, b[k], rtol=1e-9, atol=1e-9, err_msg=str(k))


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_scans_equal_the_single_pass(bars, parts):
    same(scans.ema(bars, 10, parts=parts), recursive.indicator(bars, recursive.ema(10), ["value"]), ["value"])
    same(scans.macd(bars, parts=parts), recursive.indicator(bars, recursive.macd(), ["macd", "signal", "histogram"]), ["macd", "signal", "histogram"])
    same(scans.rsi(bars, 5, parts=parts), recursive.indicator(bars, recursive.rsi(5), ["value"]), ["value"])
    same(scans.atr(bars, 5, parts=parts), recursive.indicator(bars, recursive.atr(5), ["value"]), ["value"])


def test_one_symbol_takes_many_tasks_and_small_batches(spark, bars):
    one = bars.filter("symbol = 'long'")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = scans.placed(one, parts=10)
        assert rows.select("__part").distinct().count() >= 8
        same(scans.ema(one, 10, parts=10), recursive.indicator(one, recursive.ema(10), ["value"]), ["value"])
        same(scans.rsi(bars, 5, parts=4), recursive.indicator(bars, recursive.rsi(5), ["value"]), ["value"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def test_missing_values_leave_the_mean_as_it_is(frame):
    x = [None, None, 4.0, None, 8.0, 1.0, None, float("nan"), 3.0]
    df = frame([("s", i, v) for i, v in enumerate(x)] + [("t", i, None) for i in range(4)], "symbol string, ts int, close double")
    for parts in (1, 6):
        got = [r["m"] for r in scans.scanned(scans.placed(df, parts=parts), {"m": ("close", 0.5)}).orderBy("symbol", "ts").collect()]
        assert got == [None, None, 4.0, 4.0, 6.0, 3.5, 3.5, 3.5, 3.25, None, None, None, None]
    row = [r["__row"] for r in scans.scanned(scans.placed(df, parts=6), {"m": ("close", 0.5)}).orderBy("symbol", "ts").collect()]
    assert row == [*range(1, 10), *range(1, 5)]


def test_empty_table(frame):
    df = frame([], "symbol string, ts int, high double, low double, close double")
    assert scans.ema(df).count() == scans.rsi(df).count() == scans.macd(df).count() == scans.atr(df).count() == 0
    one = frame([("s", 0, 1.0)], "symbol string, ts int, close double")
    assert scans.scanned(scans.placed(one), {"m": ("close", 0.1)}, previous={"p": "close"}).select("m", "p").collect() == [(1.0, None)]
