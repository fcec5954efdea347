"""Queries over keys, grids, fingerprints and feature sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlume.operators import grids, store, windowed
from barlume.plans.bar_queries import MID, on_bars
from barlume.plans.catalogue import query
from barlume.plans.oracle import W, r, roll, rounded, with_bars
from barlume.sources import market

KEYS = """CASE WHEN c_custkey % 11 = 0 THEN concat('S', c_custkey % 5, '/features/x') ELSE concat('S', c_custkey % 5, '/indicators/', CASE c_custkey % 3 WHEN 0 THEN 'rsi' WHEN 1 THEN 'ema' ELSE 'macd' END, '/p', c_custkey, ':',
  CASE c_custkey % 2 WHEN 0 THEN '1h' ELSE '1d' END, ':d', c_custkey % 7) END"""
PARTS = "('S' || c_custkey % 5) AS symbol, CASE c_custkey % 3 WHEN 0 THEN 'rsi' WHEN 1 THEN 'ema' ELSE 'macd' END AS indicator, CASE c_custkey % 2 WHEN 0 THEN '1h' ELSE '1d' END AS timeframe"


def entries(spark, sf_dir):  # noqa: ANN001, ANN201
    return store.parse_keys(market.table(spark, sf_dir, "customer").selectExpr(f"{KEYS} AS key", "c_custkey AS size_bytes"))


@query("cache_keys", f"SELECT {PARTS}, 'p' || c_custkey AS params_hash, 'd' || c_custkey % 7 AS data_hash, c_custkey AS size_bytes FROM customer WHERE c_custkey % 11 <> 0")
def cache_keys(spark, sf_dir):  # noqa: ANN001, ANN201
    return entries(spark, sf_dir).drop("key")


@query("cache_usage", f"""WITH e AS (SELECT {PARTS}, c_custkey FROM customer WHERE c_custkey % 11 <> 0) SELECT CASE WHEN symbol IS NOT NULL THEN 'symbol' WHEN indicator IS NOT NULL THEN 'indicator' ELSE 'timeframe' END AS dimension,
  coalesce(symbol, indicator, timeframe) AS name, count(*) AS entries, CAST(sum(c_custkey) AS BIGINT) AS size_bytes FROM e GROUP BY GROUPING SETS (symbol, indicator, timeframe)""")
def cache_usage(spark, sf_dir):  # noqa: ANN001, ANN201
    return store.usage(entries(spark, sf_dir))


@query("cache_filter", f"SELECT {PARTS}, c_custkey AS size_bytes FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 = 2")
def cache_filter(spark, sf_dir):  # noqa: ANN001, ANN201
    return entries(spark, sf_dir).filter(store.matches("*M*") & (F.col("symbol") == "S2")).select("symbol", "indicator", "timeframe", "size_bytes")


@query("durations", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_custkey * 86400 WHEN 1 THEN c_custkey * 3600 WHEN 2 THEN c_custkey * 60 WHEN 3 THEN c_custkey * 604800 END AS seconds FROM customer")
def durations(spark, sf_dir):  # noqa: ANN001, ANN201
    c = market.table(spark, sf_dir, "customer")
    return c.select("c_custkey", store.parse_duration(F.concat(F.col("c_custkey").cast("string"), F.element_at(F.array(*[F.lit(u) for u in ("d", "h", "m", "w", "y")]), (F.col("c_custkey") % 5 + 1).cast("int")))).alias("seconds"))


@query("period_pairs", "WITH p AS (SELECT unnest([2, 3, 5, 8, 13, 21, 34, 55]) AS p) SELECT a.p AS fast, b.p AS slow FROM p a JOIN p b ON a.p < b.p")
def period_pairs(spark, sf_dir):  # noqa: ANN001, ANN201
    return grids.period_pairs(spark, grids.fibonacci_periods(1200))


@query("data_fingerprint")
def data_fingerprint(spark, sf_dir):  # noqa: ANN001, ANN201
    return store.data_fingerprint(market.table(spark, sf_dir, "customer"))


FEATURES = store.FeatureSet("demo", [
    store.FeatureDefinition("mid_mean", lambda df, c: windowed.sma(df, 5, c), 4, "midrange"),
    store.FeatureDefinition("gap", lambda df, c: df.select("symbol", "ts", (F.col(c) - F.col("mid_mean")).alias("v")), 0, "close", ("mid_mean",)),
])
on_bars("feature_set", with_bars(
    f"SELECT *, {MID} AS m FROM prev", f"SELECT symbol, ts, close, {roll('avg', 'm', 5)} AS a FROM prev", f"SELECT *, row_number() OVER {W} AS n FROM prev WHERE a IS NOT NULL",
    f"SELECT symbol, ts, a, close - a AS g, row_number() OVER {W} AS k FROM prev WHERE n > 4", f"SELECT symbol, ts, {r('a', 'mid_mean')}, {r('g', 'gap')} FROM prev WHERE k > 4",
), lambda b: rounded(store.compute_feature_set(b, FEATURES)[1]))
