"""Bars of a longer timeframe from bars of a shorter one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlume.plans.spec import BARS, BarSpec, require

#: Minutes of the timeframes, by name: fixed values.
TIMEFRAMES = {"1min": 1, "1m": 1, "5min": 5, "5m": 5, "15min": 15, "15m": 15, "30min": 30, "30m": 30, "1h": 60, "4h": 240, "1d": 1440, "1w": 10080}


def bar_start(ts: Column, timeframe: str) -> Column:
    """The start of the bar that holds ts; weeks start on Mondays."""
    if timeframe == "1w":
        return F.date_trunc("week", ts).cast("timestamp_ntz")
    return F.window(ts, f"{TIMEFRAMES[timeframe]} minutes")["start"].cast("timestamp_ntz")


def aggregate_to_timeframe(df: DataFrame, source: str, target: str, include_incomplete: bool = False, spec: BarSpec = BARS) -> DataFrame:
    """OHLC and the summed volume, if there is one, by symbol and target bar.

    Bars of fewer source bars than fit are dropped, wherever they are, unless include_incomplete. ValueError for unknown
    timeframes and for a target that is not longer than the source. An empty table gives an empty one.
    """
    for name in (source, target):
        if name not in TIMEFRAMES:
            raise ValueError(f"unknown timeframe {name}")
    if TIMEFRAMES[target] <= TIMEFRAMES[source]:
        raise ValueError(f"{target} is not longer than {source}")
    require(df, spec.ts, "open", "high", "low", "close")
    aggregates = [F.min_by("open", spec.ts).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", spec.ts).alias("close")]
    if "volume" in df.columns:
        aggregates.append(F.sum("volume").alias("volume"))
    out = df.groupBy(spec.symbol, bar_start(F.col(spec.ts), target).alias("__bar")).agg(*aggregates, F.count("*").alias("__n"))
    if not include_incomplete:
        out = out.filter(F.col("__n") >= TIMEFRAMES[target] // TIMEFRAMES[source])
    return out.drop("__n").withColumnRenamed("__bar", spec.ts)
