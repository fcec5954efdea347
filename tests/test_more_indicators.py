"""Averages of varying length, extended stops and lines, grids, labels, the cache and the package's archive."""

import hashlib
import json
import subprocess
import sys
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlume.operators import batch, forecast, grids, labels, recursive, registry, store, windowed
from barlume.plans.shipping import ship
from barlume.plans.spec import BarSpec


@pytest.fixture
def bars(frame):
    rng = np.random.default_rng(1)
    rows = []
    for s in ("a", "b"):
        x = 1e6 + rng.normal(size=120).cumsum()
        rows += [(s, t, float(v + 0.5), float(v - 0.5), float(v), float(rng.integers(-3, 60))) for t, v in enumerate(x)]
    rows[7] = (*rows[7][:5], None)
    return frame(rows, "symbol string, ts int, high double, low double, close double, periods double")


@pytest.mark.parametrize("most", [10, 50])
def test_mavp_equals_slices(bars, most):
    got = {(r["symbol"], r["ts"]): r["value"] for r in windowed.mavp(bars, 2, most).collect()}
    want = {}
    for s, b in bars.toPandas().sort_values("ts").groupby("symbol"):
        x, p = b["close"].to_numpy(), b["periods"].to_numpy()
        for t in range(most - 1, len(x)):
            if not np.isnan(p[t]):
                n = int(min(max(int(p[t]), 2), most))
                want[s, t] = x[t - n + 1 : t + 1].mean()
    assert set(got) == set(want)
    np.testing.assert_allclose([got[k] for k in want], list(want.values()), rtol=1e-12)
    kept = windowed.mavp(bars, 2, most, spec=BarSpec(keep=True))
    assert kept.count() == 240 and set(kept.columns) == {*bars.columns, "value"}
    assert registry.get("mavp")(bars, most=most).count() == len(want)
    with pytest.raises(ValueError, match="least"):
        windowed.mavp(bars, 5, 3)


def test_mavp_with_missing_values(frame):
    df = frame([("s", t, None if t == 3 else float(t), 2.0) for t in range(8)], "symbol string, ts int, close double, periods double")
    assert {r["ts"]: r["value"] for r in windowed.mavp(df, 1, 2).collect()} == {1: 0.5, 2: 1.5, 5: 4.5, 6: 5.5, 7: 6.5}


def test_sarext_with_equal_sides_is_sar_with_signs(bars):
    plain = {(r["symbol"], r["ts"]): r["value"] for r in recursive.indicator(bars, recursive.sar(), ["value"]).collect()}
    ext = {(r["symbol"], r["ts"]): r["value"] for r in recursive.indicator(bars, recursive.sarext(start=1e6 - 3), ["value"]).collect()}
    assert set(plain) == set(ext) and min(ext.values()) < 0 < max(ext.values())
    later = [k for k in plain if k[1] > 60]  # by then both have reversed
    assert np.mean([abs(plain[k] - abs(ext[k])) < 1e-6 for k in later]) > 0.9
    short = recursive.sarext(start=-1e9)(pd.DataFrame({"high": [3.0, 2.0, 1.0], "low": [2.0, 1.0, 0.5]}))[1]["value"]
    assert np.isnan(short[0]) and (short[1:] < 0).all()


def test_macdext_by_its_averages(bars):
    same = recursive.indicator(bars, recursive.macdext(12, "ema", 26, 1, 9, "ema"), ["macd", "signal", "histogram"])
    base = recursive.indicator(bars, recursive.macd(), ["macd", "signal", "histogram"])
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, base.collect()))
    got = {(r["symbol"], r["ts"]): r["macd"] for r in recursive.indicator(bars, recursive.macdext(3, "sma", 5, "wma", 2, "trima"), ["macd", "signal", "histogram"]).collect()}
    for s, b in bars.toPandas().sort_values("ts").groupby("symbol"):
        x = b["close"].to_numpy()
        for t in (20, 90):
            w = np.arange(1, 6)
            assert got[s, t] == pytest.approx(x[t - 2 : t + 1].mean() - (x[t - 4 : t + 1] * w).sum() / 15, abs=1e-6)
    with pytest.raises(ValueError, match="unknown average"):
        recursive.macdext(fast_average="odd")
    out = batch.compute_indicators(bars, {"m": ("macdext", {}), "s": ("sarext", {}), "v": ("mavp", {"most": 10})})
    assert {"m_macd", "m_signal", "m_histogram", "s", "v"} <= set(out.columns) and out.count() == 240


def test_averages_equal_the_indicators(bars):
    x = bars.filter("symbol = 'a'").toPandas().sort_values("ts")["close"].to_numpy()
    w = np.arange(1, 8)
    np.testing.assert_allclose(recursive.AVERAGES["wma"](x, 7)[6:], [(x[t - 6 : t + 1] * w).sum() / w.sum() for t in range(6, len(x))], rtol=1e-12)
    assert np.isnan(recursive.AVERAGES["wma"](x[:3], 7)).all()


def test_grids_of_all_widths():
    assert grids.PERIODS["extended"] == [2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597, 2584]
    assert grids.FAST["extended"][-1] == 89 and grids.SLOW["extended"][0] == 13 and grids.SLOW["extended"][-1] == 987
    assert {"stochastic_midrange", "atr_midrange", "adx_midrange", "dx", "plus_di", "minus_di"} <= set(grids.GRIDS)
    assert grids.auto_grid({"period": 14}, "extended", most=10) == {"period": [2, 3, 5, 8]}
    assert grids.fibonacci_periods(1000) == [2, 3, 5, 8, 13, 21, 34] and grids.fibonacci_periods(10) == []


def test_labels_refuse_and_complete(bars):
    for h in (0, -1):
        with pytest.raises(ValueError, match="horizon"):
            labels.binary_next_bar(bars, h)
    df = bars.withColumn("close", F.col("close") - 1e6 + 50)
    one = labels.triple_barrier(df, labels.TripleBarrier(take_profit=0.05)).select("symbol", "ts", "label").collect()
    both = labels.triple_barrier(df, labels.TripleBarrier(take_profit=0.05, stop_loss=0.02)).select("symbol", "ts", "label").collect()
    assert sorted(one) == sorted(both)


def test_fingerprints_know_names_and_types(frame):
    a = frame([(1, 2.0)], "a int, b double")
    f = lambda df: store.data_fingerprint(df).first()["fingerprint"]
    assert len({f(a), f(a.withColumnsRenamed({"a": "c"})), f(a.withColumn("a", F.col("a").cast("bigint")))}) == 3 and f(a) == f(a.select("b", "a"))


def test_cache_keeps_the_old_when_a_write_fails_and_knows_empty_ones(spark, frame, tmp_path):
    cache = store.FeatureCache(spark, str(tmp_path))
    key = store.cache_key("s", "1h", "rsi", {"period": 3}, "d")
    cache.set(key, frame([(1,)], "v int"))
    cache.set(key, cache.get(key).selectExpr("v + 1 AS v"))  # what it reads is replaced only when it is written
    assert cache.get(key).collect() == [(2,)]
    with pytest.raises(Exception, match=r"(?s).*"):
        cache.set(key, frame([(1,)], "v int").selectExpr("raise_error('no') AS v"))
    assert cache.get(key).collect() == [(2,)] and cache.entries().count() == 1 and not list(tmp_path.glob("_new-*"))
    cache.set(key, frame([], "v int"))
    assert cache.get(key) is not None and cache.get(key).count() == 0 and cache.has(key)


def test_dictionary_signature(frame):
    entries = {"b": {"unit": "x"}, "a": {"unit": "y"}}
    want = hashlib.sha256(json.dumps({"entries": entries, "feature_dictionary_id": "f", "feature_dictionary_version": "1"}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert forecast.dictionary_signature("f", "1", entries) == want
    one, two = (forecast.dictionary_of(frame([], s), "f", "1") for s in ("a int, b double", "a bigint, b double"))
    assert one != two and one == forecast.dictionary_of(frame([(1, 2.0)], "a int, b double"), "f", "1")


def test_shipped_archive_holds_the_package(spark, tmp_path):
    archive = ship(spark)
    assert {"barlume/__init__.py", "barlume/operators/scans.py"} <= set(zipfile.ZipFile(archive).namelist())
    out = subprocess.run([sys.executable, "-c", "import barlume.operators.scans as s; print(s.__file__)"], cwd=tmp_path, env={"PYTHONPATH": archive}, capture_output=True, text=True)
    assert archive in out.stdout
