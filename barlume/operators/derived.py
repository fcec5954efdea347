"""Derived price fields, returns, volatility and the feature block for currency pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlume.plans.spec import BARS, BarSpec, ratio, require, skip

RETURN_WINDOWS = [55, 210, 340, 890, 3750]  # fixed values


def true_range(spec: BarSpec = BARS, previous: str = "close") -> Column:
    """The greatest of the bar's range and its distances from the previous close; the first bar has only its range."""
    p = spec.lag(previous)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - p), F.abs(F.col("low") - p))


def midrange() -> Column:
    return (F.col("high") + F.col("low")) / 2


def derived_fields(df: DataFrame, spec: BarSpec = BARS) -> DataFrame:
    """Adds midrange, range, true_range, true_range_midrange and true_range_hl."""
    require(df, "open", "high", "low", "close")
    spread = F.col("high") - F.col("low")
    df = df.withColumns({"midrange": midrange(), "range": spread, "true_range": true_range(spec)})
    return df.withColumns({
        "true_range_midrange": F.greatest(spread, F.abs(F.col("midrange") - spec.lag("midrange"))),
        "true_range_hl": F.greatest(spread, F.abs(F.col("high") - spec.lag("high")), F.abs(F.col("low") - spec.lag("low"))),
    })


def change(column: str, periods: int, log: bool, spec: BarSpec) -> Column:
    before = spec.lag(column, periods)
    r = ratio(F.col(column), before)
    return F.ln(r) if log else r - 1


def returns(df: DataFrame, column: str = "close", periods: int = 1, log_returns: bool = False, spec: BarSpec = BARS) -> DataFrame:
    """Adds return (log_return), with _n for several periods; null where there is no earlier price or it is 0."""
    require(df, column)
    name = ("log_return" if log_returns else "return") + (f"_{periods}" if periods > 1 else "")
    before = spec.lag(column, periods)
    value = F.ln(ratio(F.col(column), before)) if log_returns else ratio(F.col(column) - before, before)
    return df.withColumn(name, value)


def volatility(df: DataFrame, column: str = "close", window: int = 20, annualize: bool = True, periods_per_year: int = 252, spec: BarSpec = BARS) -> DataFrame:
    """Adds volatility: the rolling sample deviation of the returns, annualised on request. A return column of df is used as it is."""
    if "return" not in df.columns:
        df = returns(df, column, spec=spec)
    scale = periods_per_year**0.5 if annualize else 1.0
    return df.withColumn("volatility", spec.roll(F.stddev_samp, "return", window) * scale)


def rolling_returns(df: DataFrame, column: str = "close", windows: list[int] | None = None, log_returns: bool = True, aggregations: tuple[str, ...] = ("sum", "mean"), spec: BarSpec = BARS) -> DataFrame:
    """Adds return_<aggregation>_<window> for every window; all share one sort."""
    fs = {"sum": F.sum, "mean": F.avg}
    df = df.withColumn("__r", change(column, 1, log_returns, spec))
    return df.withColumns({f"return_{a}_{n}": spec.roll(fs[a], "__r", n) for n in windows or RETURN_WINDOWS for a in aggregations}).drop("__r")


def multi_window_volatility(df: DataFrame, column: str = "close", windows: list[int] | None = None, annualize: bool = True, periods_per_year: int = 252, spec: BarSpec = BARS) -> DataFrame:
    """Adds volatility_<window> for every window."""
    df = df.withColumn("__r", change(column, 1, False, spec))
    scale = periods_per_year**0.5 if annualize else 1.0
    return df.withColumns({f"volatility_{n}": spec.roll(F.stddev_samp, "__r", n) * scale for n in windows or RETURN_WINDOWS}).drop("__r")


def forex_features(df: DataFrame, atr_window: int = 14, zscore_window: int = 50, warmup_cut: int | None = None, spec: BarSpec = BARS) -> DataFrame:
    """(symbol, ts, midrange_return, range_change, volume_change, atr_zscore) without the warm-up and rows with nulls.

    The warm-up is cut only from symbols that are longer than it. Changes from nothing or from 0 are 0.
    """
    cut = max(50, 3 * zscore_window) if warmup_cut is None else warmup_cut
    volume = F.col("volume") if "volume" in df.columns else F.lit(0.0)
    df = df.select(spec.symbol, spec.ts, midrange().alias("mid"), (F.col("high") - F.col("low")).alias("spread"), volume.alias("vol"), true_range(spec).alias("tr"))
    step = lambda c: F.coalesce(ratio(F.col(c) - spec.lag(c), spec.lag(c)), F.lit(0.0))
    df = df.withColumns({"midrange_return": F.ln(ratio(F.col("mid"), spec.lag("mid"))), "range_change": step("spread"), "volume_change": step("vol"), "atr": spec.roll(F.avg, "tr", atr_window)})
    mean, dev = spec.roll(F.avg, "atr", zscore_window), spec.roll(F.stddev_samp, "atr", zscore_window)
    df = df.withColumn("atr_zscore", (F.col("atr") - mean) / (dev + 1e-10))
    df = df.withColumns({"__n": F.row_number().over(spec.order), "__all": F.count("*").over(Window.partitionBy(spec.symbol))})
    df = df.filter((F.col("__all") <= cut) | (F.col("__n") > cut))
    return df.select(spec.symbol, spec.ts, "midrange_return", "range_change", "volume_change", "atr_zscore").dropna()


__all__ = ["RETURN_WINDOWS", "derived_fields", "forex_features", "midrange", "multi_window_volatility", "returns", "rolling_returns", "skip", "true_range", "volatility"]
