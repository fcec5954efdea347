"""Operators on small inputs with known results."""

import math
from datetime import datetime, timedelta
from decimal import Decimal, getcontext

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barlume.functions import variance
from barlume.operators import asof, derived, forecast, grids, labels, microstructure, recursive, regime, registry, resample, selection, store, sweeps, transforms, volatility, windowed
from barlume.operators.batch import compute_indicators
from barlume.plans.spec import skip

T0 = datetime(2024, 1, 15, 10)
BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def bars(frame, closes, symbol="A", minutes=60, spread=1.0):
    rows = [(symbol, T0 + timedelta(minutes=minutes * i), c, c + spread, c - spread, float(c), 1000.0 + i) for i, c in enumerate(closes)]
    return frame([(s, t, float(o), float(h), float(lo), c, v) for s, t, o, h, lo, c, v in rows], BAR)


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*(order or ("symbol", "ts"))).collect()]


def test_true_range_by_hand(frame):
    df = frame([("A", T0, 100.0, 110.0, 95.0, 105.0, 1.0), ("A", T0 + timedelta(hours=1), 105.0, 108.0, 102.0, 106.0, 1.0)], BAR)
    assert column(derived.derived_fields(df), "true_range") == [15.0, 6.0]


def test_sma_by_hand(frame):
    assert column(windowed.sma(bars(frame, [10, 20, 30, 40, 50]), 3), "value") == [20.0, 30.0, 40.0]


def test_missing_columns_and_unknown_names(frame):
    with pytest.raises(ValueError):
        derived.derived_fields(frame([("A", T0)], "symbol string, ts timestamp_ntz"))
    with pytest.raises(ValueError):
        registry.get("nothing")
    with pytest.raises(ValueError):
        windowed.candle(bars(frame, [1.0]), "moon")
    assert registry.get("RSI").parameters == {"period": 14} and "macd" in registry.names()
    with pytest.raises(ValueError):
        registry.get("sma").resolve({"colour": 1})
    with pytest.raises(ValueError):
        registry.get("sma").resolve({"period": 0})
    with pytest.raises(ValueError):
        registry.get("sma")(bars(frame, [1.0]), inputs={"close": "nothing"})


def test_registry_describes_itself():
    assert len(registry.names()) >= 50 and set(registry.names("volume")) >= {"obv", "ad", "adosc"}
    assert "ema" in registry.names(inputs=("close",)) and "atr" not in registry.names(inputs=("close",))
    assert registry.get("macd").resolve({"fastperiod": 30, "slowperiod": 10}) == {"fast": 10, "slow": 30, "signal": 9}
    assert registry.get("atr").metadata() == {"name": "atr", "category": "volatility", "inputs": ["high", "low", "close"], "outputs": ["value"], "parameters": {"period": 14, "midrange": False}, "recursive": True}


def test_all_indicators_at_once_equal_each_alone(frame):
    """Rows in which a single indicator has all outputs agree with the batch; other bars are kept there."""
    b = bars(frame, [100 + 5 * math.sin(i / 3) + (i * 7 % 11) / 5 for i in range(120)])
    every = {n: (n, {}) for n in registry.names()}
    rows = {r["ts"]: r.asDict() for r in compute_indicators(b, every).collect()}
    assert len(rows) == 120 and all(any(r[c] is not None for r in rows.values()) for c in rows[T0])
    for n in ("stochastic", "hma", "cci", "aroon", "linearreg_angle", "minmaxindex", "cdlhammer", "roll_extreme_midrange", "kama", "tema", "macd", "adx_midrange", "plus_di", "dx"):
        i = registry.get(n)
        alone = i(b).collect()
        assert set(i.outputs) <= set(alone[0].asDict()) if alone else True
        for r in alone:
            for o in i.outputs:
                v, w = r[o], rows[r["ts"]][n if o == "value" else f"{n}_{o}"]
                assert (v is None and w is None) or v == pytest.approx(w), (n, o)
    renamed = compute_indicators(b.withColumn("other", F.col("high")), {"x": ("sma", {"period": 5})}, inputs={"close": "other"}).filter("x IS NOT NULL").count()
    assert renamed == 116


def test_registry_runs_by_name(frame):
    b = bars(frame, [100 + 5 * math.sin(i / 3) for i in range(80)])
    for name in ("sma", "rsi", "macd", "bbands", "atr"):
        i = registry.get(name)
        assert set(i.outputs) <= set(i(b).columns) and i(b).count() > 0


def test_series_start_the_same_without_their_end(frame):
    """No indicator looks ahead."""
    closes = [100 + 7 * math.sin(i / 4) + (i % 5) for i in range(90)]
    for f in (windowed.bbands, windowed.wma, windowed.cci, windowed.aroon, lambda b: recursive.indicator(b, recursive.rsi(), ["value"]), lambda b: recursive.indicator(b, recursive.adx(5), ["adx"])):
        whole, part = f(bars(frame, closes)).orderBy("ts").collect(), f(bars(frame, closes[:70])).orderBy("ts").collect()
        assert len(part) and whole[: len(part)] == part


def test_symbols_do_not_meet(frame):
    a, b = bars(frame, range(1, 31)), bars(frame, range(100, 130), "B")
    both = derived.returns(a.unionByName(b))
    assert column(both.filter("symbol = 'B'"), "return")[1:] == column(derived.returns(b), "return")[1:]
    assert both.filter("return IS NULL").count() == 2


def test_rsi_range_and_flat_series(frame):
    v = column(recursive.indicator(bars(frame, [100 + 9 * math.sin(i) for i in range(60)]), recursive.rsi(), ["value"]), "value")
    assert all(0 <= x <= 100 for x in v)
    assert set(column(recursive.indicator(bars(frame, [5.0] * 30), recursive.rsi(), ["value"]), "value")) == {100.0}


def test_zigzag(frame):
    out = recursive.zigzag(bars(frame, [100, 102, 105, 103, 101, 104, 108]), 0.02).orderBy("ts").collect()
    assert [(r["direction"], r["pivot"], r["price"]) for r in out] == [("short", "high", 105.0), ("long", "low", 101.0)]


def test_sar_stays_outside_the_bars(frame):
    b = bars(frame, [100 + i for i in range(20)])
    out = recursive.indicator(b, recursive.sar(), ["value"]).join(b, ["symbol", "ts"])
    assert out.filter("value > low").count() == 0


def test_resample(frame):
    b = bars(frame, range(100, 110), minutes=60)
    out = resample.aggregate_to_timeframe(b, "1h", "4h").orderBy("ts").collect()
    assert [(r["ts"].hour, r["open"], r["close"]) for r in out] == [(12, 102.0, 105.0), (16, 106.0, 109.0)]
    assert resample.aggregate_to_timeframe(b, "1h", "4h", True).count() == 3
    assert resample.aggregate_to_timeframe(b.filter("false"), "1h", "4h").count() == 0
    for pair in (("4h", "1h"), ("1h", "7h")):
        with pytest.raises(ValueError):
            resample.aggregate_to_timeframe(b, *pair)


def test_asof(frame):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    base = frame([("A", at(m)) for m in (1, 2, 3, 6)] + [("B", at(1))], "symbol string, ts timestamp_ntz")
    feats = frame([("A", at(0), 100.0), ("A", at(5), 200.0), ("B", at(9), 1.0)], "symbol string, ts timestamp_ntz, v double")
    assert column(asof.align_feature_frame(base, feats), "v") == [100.0, 100.0, 100.0, 200.0, None]
    assert column(asof.align_feature_frame(base, feats, shift=1, prefix="p_"), "p_v") == [None, None, None, 100.0, None]
    assert column(asof.align_feature_frame(base, feats.filter("false")), "v") == [None] * 5
    assert asof.align_feature_frames(base, {"q": feats, "t": feats.withColumnRenamed("v", "w")}).columns == ["symbol", "ts", "q_v", "t_w"]


def test_trade_bars_and_stream(spark, frame, tmp_path):
    rows = [("A", T0 + timedelta(seconds=30 * i), 100.0 + i, 1.0 + i % 2, ["buy", "sell"][i % 2]) for i in range(6)]
    trades = frame(rows, "symbol string, ts timestamp_ntz, price double, quantity double, side string")
    first = microstructure.trade_bars(trades, "1 minute").orderBy("ts").first()
    assert (first["trade_count"], first["volume"], first["last_price"], first["trade_imbalance"]) == (2, 3.0, 101.0, pytest.approx(-1 / 3)) and first["vwap"] == pytest.approx(302 / 3)
    from barlume.streaming.trade_bars import stream_trade_bars

    trades.unionByName(frame([("A", T0 + timedelta(hours=9), 1.0, 1.0, "buy")], trades.schema)).coalesce(1).write.parquet(f"{tmp_path}/in")
    q = stream_trade_bars(spark.readStream.schema(trades.schema).parquet(f"{tmp_path}/in"), "1 minute", "1 minute").writeStream.format("memory").queryName("bars").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("bars").count() == 3 and spark.table("bars").agg(F.sum("volume")).first()[0] == 9.0


def test_quotes_and_book(frame):
    q = microstructure.quote_features(frame([("A", T0, 100.0, 100.2, 5.0, 4.0)], "symbol string, ts timestamp_ntz, bid double, ask double, bid_size double, ask_size double")).first()
    assert (q["quote_mid"], q["quoted_spread"], q["quote_imbalance"]) == (pytest.approx(100.1), pytest.approx(0.2), pytest.approx(1 / 9))
    assert microstructure.corwin_schultz_spread(bars(frame, [1.0], spread=0.0)).first()["spread"] == 0.0


def test_labels(frame):
    b = bars(frame, [100, 102, 98, 101, 103], spread=0.5)
    assert column(labels.triple_barrier(b, labels.TripleBarrier(0.02, 0.02, 3)), "label")[0] == 1
    assert column(labels.triple_barrier(bars(frame, [100, 101, 102]), labels.TripleBarrier(0.05, 0.05)), "label")[-1] == 0
    assert column(labels.binary_next_bar(b), "label") == [1.0, 0.0, 1.0, 1.0, 0.0]
    flat = labels.triple_barrier_atr(bars(frame, [100.0] * 6), 3).orderBy("ts").collect()
    assert (flat[3]["sl"], flat[3]["tp"], flat[3]["label"]) == (98.0, 104.0, 0)


# ---- volatility


def test_formulas_against_decimals(frame):
    getcontext().prec = 50
    o, h, lo, c, p = (Decimal(x).ln() for x in ("100", "104.5", "98.25", "101.75", "99.5"))
    ln2 = Decimal(2).ln()
    gk = (h - lo) ** 2 / 2 - (2 * ln2 - 1) * (c - o) ** 2
    want = {"ctc": (c - p) ** 2, "parkinson": (h - lo) ** 2 / (4 * ln2), "garman_klass": gk, "rogers_satchell": (h - o) * (h - c) + (lo - o) * (lo - c), "gk_yang_zhang": (o - p) ** 2 + gk}
    row = frame([tuple(float(x) for x in (o, h, lo, c, p))], "o double, h double, l double, c double, p double")
    o, h, lo, c, p = (F.col(x) for x in "ohlcp")
    got = row.select(variance.ctc(c, p).alias("ctc"), variance.parkinson(h, lo).alias("parkinson"), variance.garman_klass(o, h, lo, c).alias("garman_klass"), variance.rogers_satchell(o, h, lo, c).alias("rogers_satchell"), variance.gk_yang_zhang(o, h, lo, c, p).alias("gk_yang_zhang")).first()
    for k, v in want.items():
        assert got[k] == pytest.approx(float(v), abs=1e-12)


def test_estimate_gates(frame):
    b = bars(frame, [100 + i % 7 for i in range(40)])
    with pytest.raises(volatility.SpecError):
        volatility.estimate_variance(b, volatility.VarianceSpec("rv"))
    with pytest.raises(volatility.SpecError):
        volatility.estimate_variance(b, volatility.VarianceSpec(min_periods=30))
    with pytest.raises(volatility.PointInTimeError):
        volatility.estimate_variance(b, asof=T0 + timedelta(hours=5))
    with pytest.raises(volatility.DataQualityError):
        volatility.estimate_variance(b.withColumn("close", F.when(F.col("volume") > 1035, -1.0).otherwise(F.col("close"))))
    used = volatility.estimate_variance(b.withColumn("open", F.when(F.col("volume") != 1005, F.col("open"))))
    assert used.first()["estimator_used"] == "parkinson"


def test_estimate_targets_and_units(frame):
    b = bars(frame, [100 + i % 7 for i in range(40)])
    spec = volatility.VarianceSpec
    for bad in (spec(target="other"), spec(unit="other"), spec(target="quadratic_variation"), spec(periods_per_year=None)):
        with pytest.raises(volatility.SpecError):
            volatility.estimate_variance(b, bad)
    year = volatility.estimate_variance(b).orderBy("ts").collect()[-1]
    for unit in ("per_bar_variance", "per_bar_vol"):
        last = volatility.estimate_variance(b, spec(unit=unit, periods_per_year=None, target="quadratic_variation", sampling="5m")).orderBy("ts").collect()[-1]
        assert last["var_per_bar"] == year["var_per_bar"] > 0 and last["vol_per_bar"] == year["vol_per_bar"] and last["var_annualized"] is last["vol_annualized"] is None
    assert year["var_annualized"] == pytest.approx(252 * year["var_per_bar"])


def test_estimates_together_equal_each_alone(frame):
    b = bars(frame, [100 + i % 7 for i in range(40)]).unionByName(bars(frame, [50 + i % 5 for i in range(30)], "B").withColumn("open", F.when(F.col("volume") != 1005, F.col("open"))))
    names = [n for n in volatility.ESTIMATORS if n != "rv"]
    together = volatility.compare_estimates(b, names)
    for n in names:
        alone = volatility.estimate_variance(b, volatility.VarianceSpec(n), gate=False)
        assert column(together, n) == column(alone, "var_per_bar") and any(column(alone, "var_per_bar"))
    with pytest.raises(volatility.SpecError):
        volatility.compare_estimates(b, ["rv"])


def test_returns_within_bars_give_the_signature(frame):
    b = bars(frame, [100 + i % 7 for i in range(30)])
    bounce = [("A", T0 + timedelta(hours=25), i, 0.01 * (-1) ** i) for i in range(60)]  # back and forth: noise, not movement
    calm = [("A", T0 + timedelta(hours=26), i, 0.01) for i in range(60)]
    returns = frame(bounce + calm, "symbol string, ts timestamp_ntz, seq int, r double")
    out = volatility.estimate_variance(b, returns=returns)
    rows = {r["ts"]: r for r in out.collect()}
    assert out.count() == 30 and rows[T0]["volatility_signature"] is None
    noisy, quiet = rows[T0 + timedelta(hours=25)], rows[T0 + timedelta(hours=26)]
    fine, coarse = 60 * 0.01**2, 12 * 0.01**2  # five returns in turn add up to one of them
    assert fine >= 2 * coarse and noisy["volatility_signature"] == pytest.approx(coarse) and "NOISY_RV_TARGET" in noisy["flags"]
    assert quiet["volatility_signature"] == pytest.approx(fine) and "NOISY_RV_TARGET" not in quiet["flags"]


@settings(max_examples=8, deadline=None)
@given(k=st.floats(0.1, 1000), seed=st.integers(0, 1000))
def test_variance_does_not_depend_on_the_price_scale(spark, k, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(30):
        o, c = 100 + rng.normal(0, 2, 2)
        rows.append(("A", T0 + timedelta(days=i), float(o), float(max(o, c) + rng.random()), float(min(o, c) - rng.random()), float(c), 1.0))
    one = spark.createDataFrame(rows, BAR)
    two = one.withColumns({x: F.col(x) * k for x in ("open", "high", "low", "close")})
    a, b = (column(volatility.estimate_variance(d, volatility.VarianceSpec(window=10, min_periods=10)), "var_per_bar", "ts") for d in (one, two))
    assert [x is None for x in a] == [x is None for x in b]
    np.testing.assert_allclose([x for x in a if x], [x for x in b if x], rtol=1e-6)


def test_target_and_corporate_action(frame):
    rows = [("A", datetime(2024, 1, 2, 20, 59), 100.0, 100.0, None)] + [("A", datetime(2024, 1, 3, 14, 30) + timedelta(minutes=i), 101 * 1.001**i if i else 101.0, 101 * 1.001 ** (i + 1), datetime(2024, 1, 4)) for i in range(21)]
    b = frame([(s, t, float(o), float(c), e) for s, t, o, c, e in rows], "symbol string, ts timestamp_ntz, open double, close double, corporate_action_effective_ts timestamp_ntz")
    r = forecast.target_rv_total(b).first()
    assert r["overnight_gap_var"] == pytest.approx(math.log(1.01) ** 2) and r["intraday_bar_rv"] == pytest.approx(21 * math.log(1.001) ** 2)
    assert not r["promotion_eligible"] and r["reason_codes"] == ["CA_ADJACENT"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-0.1, 0.1), min_size=3, max_size=40), st.integers(1, 20))
def test_semivariances_add_up(spark, returns, window):
    df = spark.createDataFrame([("A", T0 + timedelta(hours=i), r) for i, r in enumerate(returns)], "symbol string, ts timestamp_ntz, r double")
    for x in forecast.semivariance(df, "r", window).collect():
        assert x["downside_rv"] + x["upside_rv"] == pytest.approx(x["bar_rv"], abs=1e-12)


def test_universe_and_labels(spark, frame):
    e = frame([("a", "garch", True, 5), ("a", "ewma", True, 5), ("b", "GARCH", False, 30), ("c", "ewma", False, 30), ("d", "ewma", False, 3)], "symbol string, baseline string, eligible boolean, sessions_available int")
    assert {r["symbol"]: r["universe"] for r in forecast.universe_membership(e).collect()} == {"a": "common-eligible", "b": "limited-history", "c": "production-coverage", "d": "limited-history"}
    top = spark.range(1).select(forecast.resolve_labels(F.array(F.lit("x"), F.lit("y"), F.lit("z")), {"x": 1.0, "y": 2.0, "z": 2.0}).alias("l")).first()["l"]
    assert top == ["y", "z"]
    with pytest.raises(ValueError):
        forecast.gap_jump_labels(e, 2.0)


# ---- transforms, selection, regimes


def test_transforms(frame):
    b = bars(frame, range(1, 11))
    assert transforms.fracdiff_weights(1.0)[:2] == [1.0, -1.0]
    scaler = transforms.Scaler("diffusion").fit(b, "close")
    assert column(b.select("symbol", "ts", scaler.transform(F.col("close")).alias("v")), "v")[::9] == [-1.0, 1.0]
    p = transforms.FeaturePipeline("nn").fit(b)
    assert transforms.FeaturePipeline.from_json(p.to_json()) == p
    with pytest.raises(RuntimeError):
        transforms.FeaturePipeline("nn").transform(b)
    q = frame([(55.556,), (float("inf"),), (float("nan"),), (-5.0,)], "v double").select(transforms.quantize(F.col("v"), "rsi").alias("q")).collect()
    assert [r["q"] for r in q] == [5556, 10000, None, 0]


def test_false_discovery(frame):
    rows = [(i, p) for i, p in enumerate([0.01, 0.04, 0.03, None, 0.2, float("nan")])]
    got = {r["i"]: (r["q_value"], r["significant"]) for r in selection.benjamini_hochberg(frame(rows, "i int, p double"), "p").collect()}
    assert got[0][0] == pytest.approx(0.04) and got[1][0] == got[2][0] == pytest.approx(0.04 * 4 / 3) and got[4][0] == pytest.approx(0.2)
    assert got[3] == got[5] == (None, None) and got[0][1] and not got[1][1]


def test_information_finds_the_signal(spark):
    rng = np.random.default_rng(42)
    x1, x2 = rng.normal(size=(2, 800))
    df = spark.createDataFrame([(i, float(a), float(b), float(a + 0.1 * e)) for i, (a, b, e) in enumerate(zip(x1, x2, rng.normal(size=800), strict=True))], "i long, x1 double, x2 double, y double")
    mi = {r["feature"]: r["mi"] for r in selection.mutual_information(df, "i", ["x1", "x2"], "y").collect()}
    assert mi["x1"] > 1.0 > 0.2 > mi["x2"] >= 0
    perm = {r["feature"]: r["p_value"] for r in selection.resampled_information(df, "i", ["x1", "x2"], "y", "permutation", 20).collect()}
    assert perm["x1"] == 0 and perm["x2"] > 0
    assert [f for f, _ in selection.mrmr(df, "y", ["x2", "x1"], 2)] == ["x1", "x2"]
    few = selection.mutual_information(df.limit(50), "i", ["x1"], "y").first()["mi"]
    assert few is None


def test_digamma():
    np.testing.assert_allclose(selection.digamma(np.array([1.0, 2.0, 10.0])), [-0.5772156649, 0.4227843351, 2.2517525891], rtol=1e-8)


def test_correlated_features_cluster(frame):
    df = frame([(float(i), 2.0 * i + i % 2, float((i * 37) % 11)) for i in range(60)], "a double, b double, c double")
    got = selection.cluster_features(selection.correlation_pairs(df, ["a", "b", "c"]))
    assert got["a"] == got["b"] != got["c"]
    assert {(r["f1"], r["f2"]) for r in selection.highly_correlated_pairs(selection.correlation_pairs(df, ["a", "b", "c"])).collect()} == {("a", "b")}


def test_regimes(spark, frame):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(5 * (i % 3), 0.3, 2)], i % 3) for i in range(90)]
    df = frame(rows, "id long, v array<double>, label int")
    found = regime.kmeans_regimes(df, "v", 3)
    assert regime.adjusted_rand(found, "label", "cluster_id").first()["ari"] == pytest.approx(1.0)
    assert regime.nearest_centroid(df, "id", "v", "label").join(df.withColumnRenamed("id", "row"), "row").filter("prediction <> label").count() == 0
    assert regime.svm_regimes(df, df, "v", "label").filter("prediction <> label").count() <= 5
    assert {r["label"]: r["coverage"] for r in regime.terminal_coverage(df, "label", [0, 9]).collect()} == {0: pytest.approx(1 / 3), 9: 0.0}
    votes = frame([(1, "a", 0, 0.9), (1, "b", 1, 0.6), (1, "b", 0, 0.4)], "row int, model string, label int, p double")
    assert regime.weighted_vote(votes, "row", "model", "label", "p", {"a": 1.0, "b": 1.0}).first()["prediction"] == 0


# ---- store and grids


def test_invalid_assignments(frame):
    rows = [(0, 0.5, 0.5), (1, 1.0, 0.0), (2, 0.5, 0.5), (-1, 0.5, 0.5), (None, 0.5, 0.5), (0, 0.5, None), (0, float("nan"), 0.5), (0, -0.1, 1.1), (0, 0.5, 0.4), (0, 0.5, 0.5 + 5e-7)]
    df = frame(rows, "k int, regime_0 double, regime_1 double")
    got = [r["reason"] for r in regime.invalid_assignments(df, "k", ["regime_0", "regime_1"]).collect()]
    assert sorted(got) == ["cluster"] * 3 + ["probability"] * 3 + ["sum"]
    with pytest.raises(ValueError):
        regime.invalid_assignments(df, "k", ["regime_0"])


def test_cache(spark, frame, tmp_path):
    cache = store.FeatureCache(spark, f"{tmp_path}/cache")
    b = bars(frame, range(1, 9))
    key = store.cache_key("EUR/USD".replace("/", "_"), "1h", "rsi", {"period": 14}, "abc")
    assert cache.get(key) is None
    assert cache.set(key, b).count() == 8 and cache.has(key) and cache.get(key).count() == 8
    e = cache.query(indicator="R?I").first()
    assert (e["symbol"], e["indicator"], e["timeframe"], e["data_hash"]) == ("EUR_USD", "rsi", "1h", "abc") and e["size_bytes"] > 0
    assert cache.query(indicator="ema").count() == 0 and cache.query(older_than="1d").count() == 0
    with pytest.raises(ValueError):
        cache.clean()
    assert cache.clean(dry_run=True, indicator="*")[0] == 1 and cache.has(key)
    assert cache.clean(everything=True)[0] == 1 and not cache.has(key)
    one, two = (store.data_fingerprint(d).first()["fingerprint"] for d in (b, b.orderBy(F.desc("ts"))))
    assert one == two != store.data_fingerprint(b.limit(7)).first()["fingerprint"]


def test_feature_sets_need_their_dependencies(frame):
    f = store.FeatureDefinition("x", lambda df, c: df.select("symbol", "ts", c), 0, "close", ("y",))
    with pytest.raises(ValueError):
        store.compute_feature_set(bars(frame, [1.0, 2.0]), store.FeatureSet("s", [f]))
    assert skip(bars(frame, range(5)), 2).count() == 3


def test_cache_pages_and_filters(spark, frame, tmp_path):
    cache = store.FeatureCache(spark, f"{tmp_path}/none yet")
    assert cache.query().count() == 0 and cache.clean(everything=True) == (0, 0)
    b = bars(frame, range(1, 4))
    keys = sorted(store.cache_key("A+B %", "1h", "ema", {"period": p}, d) for p in (5, 8) for d in ("x", "y"))
    for key in keys:
        cache.set(key, b)
    got = lambda **f: [r["key"] for r in cache.query(**f).orderBy("key").collect()]
    assert got() == keys and got(limit=2, offset=1) == keys[1:3] and got(offset=3) == keys[3:] and got(limit=0) == []
    assert got(data_hash="x") == [k for k in keys if k.endswith(":x")] and len(got(params_hash=grids.hash_params({"period": 8}), symbol="A+B %", data_hash="y")) == 1
    with pytest.raises(ValueError):
        cache.query(colour="red")


def test_feature_store_computes_once(spark, frame, tmp_path):
    kept, calls = store.FeatureStore(store.FeatureCache(spark, f"{tmp_path}/cache"), "demo", "1h"), []

    def mean_of(df, c):
        calls.append(c)
        return windowed.sma(df, 2, c)

    def gap(df, c):
        calls.append("gap")
        return df.select("symbol", "ts", (F.col(c) - F.col("mean")).alias("v"))

    mean = store.FeatureDefinition("mean", mean_of, 1)
    both = store.FeatureSet("both", [store.FeatureDefinition("gap", gap, 0, "close", ("mean",)), mean])
    b, other = bars(frame, [1, 2, 4, 8, 16]), bars(frame, [1, 2, 4, 8, 17])
    want = store.compute_feature_set(b, both)[1].collect()
    calls.clear()
    for _ in range(2):
        parts, whole = kept.compute_feature_set(b, both)
        assert sorted(whole.select("symbol", "ts", "gap", "mean").collect()) == sorted(tuple(r[c] for c in ("symbol", "ts", "gap", "mean")) for r in want) and set(parts) == {"gap", "mean"}
        kept.compute_feature(b, mean)
    assert calls == ["close", "gap"]  # the set wrote what compute_feature then found
    kept.compute_feature_set(other, both)
    assert calls == ["close", "gap"] * 2  # other rows, other keys
    kept.compute_feature(b, mean, force=True)
    assert calls == ["close", "gap"] * 2 + ["close"]
    assert kept.compute_feature_set(b, store.FeatureSet("none")) == ({}, None)


def test_sweeps(frame):
    found = sweeps.specs({"sma": {"period": [5, 8]}, "macd": {"fast": [5, 34], "slow": [13], "signal": [5]}, "obv": {}, "unheard": {"x": [1]}})
    assert [s.key for s in found[:2]] == ["sma_period5", "sma_period8"] and len(found) == len(set(found))
    assert [s.key for s in found if s.name in ("obv", "unheard")] == ["obv", "unheard_x1"]
    assert [dict(s.params) for s in found if s.name == "macd"] == [{"fast": 5, "slow": 13, "signal": 5}, registry.get("macd").parameters]
    assert sweeps.IndicatorSpec.of("a", {"x": 1, "y": 2}) == sweeps.IndicatorSpec.of("a", {"y": 2, "x": 1})
    assert {s.name for s in sweeps.specs(indicators=["rsi"])} == {"rsi"} and len(sweeps.specs(include_defaults=False)) < len(sweeps.specs())
    made = sweeps.registry_grids(timeframe="1d")
    assert "cdldoji" not in made and "avgprice" not in made and max(made["sma"]["period"]) <= 108 and len(made) > 50
    assert list(sweeps.registry_grids(only=["sma", "rsi"], exclude=("rsi",))) == ["sma"] and {"sma", "rsi"} <= set(sweeps.single_price()) and "atr" not in sweeps.single_price()
    b = bars(frame, [float(i % 9) + 1 for i in range(60)])
    every = sweeps.compute(b, sweeps.specs({"rsi": {"period": [3, 5]}, "bbands": {"period": [8], "std_dev": [1.5]}}, include_defaults=False))
    assert every.columns[2:4] == ["rsi_period3", "rsi_period5"] and all(c.startswith("bbands_period8_std_dev1_5_") for c in every.columns[4:]) and every.count() == 60
    assert column(every, "rsi_period5")[5:] == column(registry.get("rsi")(b, period=5), "value")


def test_generated_grids_run(frame):
    b = bars(frame, [float(i % 9) + 1 for i in range(40)])
    wanted = [s for s in sweeps.specs(sweeps.registry_grids("coarse", exclude_categories=()), include_defaults=False) if all(not isinstance(v, (int, float)) or v <= 8 for _, v in s.params)]
    assert len(sweeps.compute(b, wanted[::7]).columns) > len(wanted[::7]) and len({s.name for s in wanted}) > 40


def test_grids():
    assert grids.fibonacci_periods(1000) == [2, 3, 5, 8, 13, 21, 34]
    assert grids.format_params({"b": [1, 2], "a": {"z": 1}}) == 'a={"z":1},b=1;2' and grids.format_params({}) == "default"
    assert grids.hash_params({"a": 1, "b": {"d": 1, "c": 2}}) == grids.hash_params({"b": {"c": 2, "d": 1}, "a": 1})
    assert len(grids.expand(grids.GRIDS["macd"])) == 24 and grids.count_combinations({"x": {"a": [1, 2], "b": [1, 2, 3]}, "y": {}}) == 7
    assert grids.auto_grid({"period": 14, "fast": 3, "nbdev": 2.0})["nbdev"] == [1.0, 2.0, 4.0]


def test_command_line(spark, frame, tmp_path, capsys):
    from barlume.cli import main

    bars(frame, range(1, 9)).write.parquet(f"{tmp_path}/b.parquet")
    root = f"{tmp_path}/cache"
    assert main(["compute", f"{tmp_path}/b.parquet", "--symbol", "A", "--timeframe", "1h", "--root", root]) == 0
    assert main(["list", "--root", root]) == main(["stats", "--root", root]) == 0 and main(["clean", "--root", root]) == 1
    assert main(["clean", "--root", root, "--all"]) == 0 and "1 entries" in capsys.readouterr().out


def brute_information(x, y, k, rng):
    n = len(x)
    x, y = (v / s if (s := v.std()) > 0 else v for v in (x, y))
    x, y = x + 1e-10 * max(1, np.abs(x).mean()) * rng.standard_normal(n), y + 1e-10 * max(1, np.abs(y).mean()) * rng.standard_normal(n)
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    radius = np.nextafter(np.sort(np.maximum(dx, dy), axis=1)[:, k], 0)[:, None]
    psi = selection.digamma
    return max(0.0, float(psi(np.array([n]))[0] + psi(np.array([k]))[0] - psi((dx <= radius).sum(axis=1)).mean() - psi((dy <= radius).sum(axis=1)).mean()))


@pytest.mark.parametrize("n", [4, 5, 40, 300])
@pytest.mark.parametrize("digits", [0, 6])
def test_neighbours_equal_all_pairs(n, digits):
    rng = np.random.default_rng(n)
    own = [(np.round(x, digits), y) for x, y in rng.normal(size=(6, 2, n)).cumsum(axis=1)]
    got = selection.ksg_many([(x, y, np.random.default_rng(i)) for i, (x, y) in enumerate(own)], 3)
    np.testing.assert_allclose(got, [brute_information(x, y, 3, np.random.default_rng(i)) for i, (x, y) in enumerate(own)], atol=1e-9)


def test_information_by_group_equals_each_group_alone(spark):
    rng = np.random.default_rng(3)
    rows = [(g, i, float(a), float(b)) for g, n in ((None, 130), ("p", 150), ("q", 3)) for i, (a, b) in enumerate(rng.normal(size=(n, 2)))]
    df = spark.createDataFrame(rows, "g string, i long, x double, y double")
    runs = {
        "mi": lambda d, by: selection.mutual_information(d, "i", ["x"], "y", by=by),
        "boot": lambda d, by: selection.resampled_information(d, "i", ["x"], "y", "bootstrap", 30, by=by, block=20),
        "roll": lambda d, by: selection.rolling_information(d, "i", ["x"], "y", 60, 30, by=by),
    }
    for run in runs.values():
        got = {(r["g"], r.asDict().get("window")): r for r in run(df, ["g"]).collect()}
        alone = {(g, r.asDict().get("window")): r for g in (None, "p", "q") for r in run(df.filter(F.col("g").eqNullSafe(F.lit(g))), None).collect()}
        assert set(got) == set(alone)
        for k, r in alone.items():
            assert {c: v if v is None else pytest.approx(v) for c, v in r.asDict().items()} == {c: got[k][c] for c in r.asDict()}


def test_stability_of_equal_scores(frame):
    rows = [(w, f, 0.0 if w == 1 else float(ord(f) * s)) for w, s in ((0, 1), (1, 1), (2, 1), (3, -1)) for f in "abc"]
    got = {r["w"]: (r["spearman"], r["regime_change"]) for r in selection.rank_stability(frame(rows, "w int, f string, s double"), "w", "f", "s").collect()}
    assert got == {1: (1.0, False), 2: (1.0, False), 3: (pytest.approx(-1.0), True)}


def sample(frame, n=400):
    """x drives y, noise does not; z copies x with holes."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal(n)
    y, noise = x + 0.3 * rng.standard_normal(n), rng.standard_normal(n)
    z = [None if i % 7 == 0 else float(round(v, 1)) for i, v in enumerate(x)]
    return frame([(i, float(a), float(b), float(c), d) for i, (a, b, c, d) in enumerate(zip(x, y, noise, z, strict=True))], "n bigint, x double, y double, noise double, z double")


def test_correlations_by_pair_and_ranks_equal_pandas(frame):
    df = sample(frame)
    cols = ["x", "y", "noise", "z"]
    pdf = df.toPandas()[cols].astype(float)
    for listwise, want in ((False, pdf.corr()), (True, pdf.dropna().corr())):
        got = selection.correlation_pairs(df, cols, listwise)
        assert {(r["f1"], r["f2"]): pytest.approx(r["corr"]) for r in got.collect()} == {(a, b): want.loc[a, b] for i, a in enumerate(cols) for b in cols[i:]}
    want = pdf.dropna().corr("spearman")
    assert {(r["f1"], r["f2"]): pytest.approx(r["corr"]) for r in selection.spearman_pairs(df, cols).collect()} == {(a, b): want.loc[a, b] for i, a in enumerate(cols) for b in cols[i:]}
    ranks = selection.distributed_ranks(selection.long_form(df, "n", ["z"]), parts=5).orderBy("value").collect()
    want = pdf["z"].dropna()
    assert {r["value"]: r["rank"] for r in ranks} == dict(zip(want, want.rank(), strict=True))
    constant = frame([(1, 5.0, 1.0), (2, 5.0, 2.0)], "n int, a double, b double")
    assert [r["corr"] for r in selection.correlation_pairs(constant, ["a", "b"]).orderBy("f1", "f2").collect()] == [None, None, 1.0]


def test_information_of_a_driver_against_noise(frame):
    df = sample(frame)
    matrix = {(r["f1"], r["f2"]): r["mi"] for r in selection.information_matrix(df, "n", ["x", "y", "noise"]).collect()}
    assert set(matrix) == {("x", "y"), ("x", "noise"), ("y", "noise")} and matrix["x", "y"] > 0.5 > 5 * matrix["x", "noise"]
    r = selection.paired_difference(df, "n", [("x", "noise")], "y", replicates=60, block=20).first()
    assert r["low"] > 0.3 and r["difference"] == pytest.approx(matrix["x", "y"] - matrix["y", "noise"], abs=0.15) and r["p_value"] == 0.0
    assert selection.paired_difference(df.limit(2), "n", [("x", "noise")], "y", replicates=4).first()["difference"] is None
    out = {r["feature"]: r for r in selection.validate_out_of_sample(df, "n", ["x", "noise"], "y").collect()}
    assert out["x"]["rank_in"] == out["x"]["rank_out"] == 1 and abs(out["x"]["degradation"]) < 0.4
    told = {r["feature"]: r for r in selection.sensitivity(df, "n", ["x"], "y").collect()}
    assert told["x"]["robust"] and told["x"]["low"] <= told["x"]["mean"] <= told["x"]["high"]
    report = {r["feature"]: r for r in selection.significance_report(df, "n", ["x", "noise"], "y", replicates=60).collect()}
    assert report["x"]["significant"] and not report["noise"]["significant"]


def test_effect_sizes_of_many_columns(frame):
    rng = np.random.default_rng(2)
    a, b = rng.normal(1, 1, 50), rng.normal(0, 1, 40)
    df = frame([("A", float(x), 1.0) for x in a] + [("B", float(x), 1.0) for x in b] + [("C", 9.0, 1.0)], "g string, v double, flat double")
    out = {r["feature"]: r for r in selection.cohens_d_batch(df, "g", ["v", "flat"], "A", "B").collect()}
    d = (a.mean() - b.mean()) / np.sqrt((49 * a.var(ddof=1) + 39 * b.var(ddof=1)) / 88)
    half = 1.959963984540054 * np.sqrt(90 / 2000 + d * d / 180)
    assert (out["v"]["cohens_d"], out["v"]["low"], out["v"]["high"]) == pytest.approx((d, d - half, d + half)) and out["flat"]["cohens_d"] is None


def test_periods_from_the_data_or_a_table(frame):
    assert grids.periods_for_timeframe("1d")[-1] == 89 and grids.periods_for_timeframe("1w")[-1] == 377
    assert grids.periods_for_timeframe("1d", bars(frame, range(1, 101))) == [2, 3, 5]
