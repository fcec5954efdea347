"""Forward-looking labels. Barriers are searched in arrays of the bars ahead, so a label needs no join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlume.operators.derived import true_range
from barlume.plans.spec import BARS, BarSpec, ratio, require


@dataclass(frozen=True)
class TripleBarrier:
    """Barriers as shares of the price, or, unless both are given, as multiples of the returns' deviation."""

    take_profit: float | None = None
    stop_loss: float | None = None
    max_holding: int = 5
    profit_std_multiple: float = 2.0
    loss_std_multiple: float = 2.0
    volatility_window: int = 20


ONE_SIDED = 0.02  # the other barrier where one is given


def binary_next_bar(df: DataFrame, horizon: int = 1, spec: BarSpec = BARS) -> DataFrame:
    """Adds label: 1.0 if the close horizon bars on is higher, else 0.0, at the end too. ValueError for a horizon below 1."""
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    ahead = F.lead("close", horizon).over(spec.order)
    return df.withColumn("label", F.when(ahead > F.col("close"), 1.0).otherwise(0.0))


def to_binary(label: Column) -> Column:
    return F.when(label > 0, 1.0).otherwise(0.0)


def first_touch(ahead: Column, up: Column, down: Column) -> Column:
    """1 or -1 for the barrier that a price of ahead meets first, up before down; 0 if none does."""
    hits = F.filter(F.transform(ahead, lambda p: F.when(p >= up, 1).when(p <= down, -1).otherwise(0)), lambda x: x != 0)
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(0))


def triple_barrier(df: DataFrame, config: TripleBarrier = TripleBarrier(), spec: BarSpec = BARS) -> DataFrame:
    """Adds label (-1, 0, 1). Barriers are fixed shares where one is given, the other then being ONE_SIDED, else multiples of the deviation.

    The deviation's window grows up to its size, its first return is 0, and where it is 0 or missing 0.01 stands.
    """
    require(df, "close")
    df = df.withColumn("__ahead", F.collect_list("close").over(spec.next(config.max_holding)))
    if config.take_profit is not None or config.stop_loss is not None:
        profit, loss = (ONE_SIDED if x is None else x for x in (config.take_profit, config.stop_loss))
        up, down = F.col("close") * (1 + profit), F.col("close") * (1 - loss)
    else:
        change = F.coalesce(ratio(F.col("close") - spec.lag("close"), spec.lag("close")), F.lit(0.0))
        df = df.withColumn("__r", change)
        dev = F.stddev_samp("__r").over(spec.last(config.volatility_window))
        df = df.withColumn("__d", F.when(dev > 0, dev).otherwise(0.01))
        up, down = F.col("close") * (1 + config.profit_std_multiple * F.col("__d")), F.col("close") * (1 - config.loss_std_multiple * F.col("__d"))
    return df.withColumn("label", first_touch(F.col("__ahead"), up, down)).drop("__ahead", "__r", "__d")


def triple_barrier_atr(df: DataFrame, atr_window: int = 20, profit_atr: float = 2.0, stop_atr: float = 1.0, max_holding: int = 3, spec: BarSpec = BARS) -> DataFrame:
    """Adds atr, sl, tp and label: 1 if a high ahead meets the target before a low meets the stop, the stop first within a bar."""
    df = df.withColumns({"atr": F.avg(true_range(spec)).over(spec.last(atr_window)), "__ahead": F.collect_list(F.struct("high", "low")).over(spec.next(max_holding))})
    df = df.withColumns({"sl": F.col("close") - stop_atr * F.col("atr"), "tp": F.col("close") + profit_atr * F.col("atr")})
    hits = F.filter(F.transform("__ahead", lambda b: F.when(b["low"] <= F.col("sl"), -1).when(b["high"] >= F.col("tp"), 1).otherwise(0)), lambda x: x != 0)
    label = F.when((F.col("atr") > 0) & (F.get(hits, F.lit(0)) == 1), 1).otherwise(0)
    return df.withColumn("label", label).drop("__ahead")


def forex_labels(df: DataFrame, horizon: int = 72, atr_window: int = 14, threshold_k: float = 0.5, price: str = "close", spread_bps: str | None = None, spec: BarSpec = BARS) -> DataFrame:
    """(symbol, ts, label): 2 above, 0 below and 1 within a band around no change, from the return horizon bars ahead.

    The band is threshold_k times the ATR, or times the given spread in basis points. Rows without a return or band go.
    """
    if horizon <= 0:
        raise ValueError("the horizon must be positive")
    require(df, price)
    ahead = F.ln(ratio(F.lead(price, horizon).over(spec.order), F.col(price)))
    df = df.withColumn("__tr", true_range(spec))
    band = threshold_k * (F.col(spread_bps) / 10000 if spread_bps else spec.roll(F.avg, "__tr", atr_window))
    df = df.select(spec.symbol, spec.ts, ahead.alias("r"), band.alias("k")).dropna()
    return df.select(spec.symbol, spec.ts, F.when(F.col("r") > F.col("k"), 2).when(F.col("r") < -F.col("k"), 0).otherwise(1).alias("label"))
