"""Features of quotes, trades, order books, funding and open interest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlume.plans.spec import BARS, BarSpec, ratio, require


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def corwin_schultz_spread(df: DataFrame, spec: BarSpec = BARS) -> DataFrame:
    """(symbol, spread): one estimate for each symbol from its highs and lows, never below 0."""
    require(df, "high", "low")
    x = df.select(spec.symbol, spec.ts, F.ln(ratio(F.col("high"), F.col("low"))).alias("x"))
    x = x.withColumn("p", spec.lag("x"))
    sums = x.groupBy(spec.symbol).agg(F.sum(F.col("x") ** 2 + F.col("p") ** 2).alias("beta"), F.sum((F.col("x") + F.col("p")) ** 2).alias("gamma"))
    alpha = (F.sqrt(2 * F.col("beta")) - F.sqrt("beta")) / (3 - 2 * 2**0.5)
    value = F.when((F.col("beta") > 0) & (F.col("gamma") > 0) & (alpha < 700), F.greatest(F.lit(0.0), 2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha)))).otherwise(F.when(alpha >= 700, 2.0).otherwise(0.0))
    return sums.select(spec.symbol, zero(value).alias("spread"))


def quote_features(df: DataFrame, spec: BarSpec = BARS) -> DataFrame:
    """Mid, spread, their changes, and from the sizes, where there are any, imbalance, microprice and its edge."""
    require(df, "bid", "ask")
    df = df.withColumns({"quote_mid": (F.col("bid") + F.col("ask")) / 2, "quoted_spread": F.col("ask") - F.col("bid")})
    change = lambda c: zero(ratio(F.col(c) - spec.lag(c), spec.lag(c)))
    df = df.withColumns({"quoted_spread_bps": zero(ratio(F.col("quoted_spread") * 10000, F.col("quote_mid"))), "mid_return": change("quote_mid"), "spread_change": change("quoted_spread")})
    if {"bid_size", "ask_size"} <= set(df.columns):
        b, a = F.col("bid_size"), F.col("ask_size")
        df = df.withColumns({"quote_imbalance": zero(ratio(b - a, b + a)), "microprice": zero(ratio(F.col("bid") * a + F.col("ask") * b, b + a))})
    else:
        df = df.withColumns({"quote_imbalance": F.lit(0.0), "microprice": F.col("quote_mid")})
    return df.withColumn("microprice_edge_bps", zero(ratio(F.col("microprice") - F.col("quote_mid"), F.col("quote_mid"))) * 10000)


def trade_bars(df: DataFrame, every: str = "1 hour", spec: BarSpec = BARS) -> DataFrame:
    """Half-open bars by symbol, stamped with their start, without empty ones: count, last price, volume, notional, signed volume, vwap and imbalance.

    Works on streams too, see streaming.trade_bars. Of trades at the last moment the one with the greatest price, then
    quantity, gives the last price.
    """
    require(df, "price", "quantity", "side")
    signed = F.when(F.col("side") == "buy", F.col("quantity")).when(F.col("side") == "sell", -F.col("quantity")).otherwise(0.0)
    out = df.groupBy(spec.symbol, F.window(spec.ts, every).alias("w")).agg(
        F.count("*").alias("trade_count"), F.max_by("price", F.struct(spec.ts, "price", "quantity")).alias("last_price"), F.sum("quantity").alias("volume"),
        F.sum(F.col("price") * F.col("quantity")).alias("notional"), F.sum(signed).alias("signed_volume"),
    )
    return out.select(
        spec.symbol, F.col("w.start").alias(spec.ts), "trade_count", "last_price", "volume", "notional", "signed_volume",
        ratio(F.col("notional"), F.col("volume")).alias("vwap"), ratio(F.col("signed_volume"), F.col("volume")).alias("trade_imbalance"),
    )


def order_book_features(df: DataFrame, depth: int = 1, spec: BarSpec = BARS) -> DataFrame:
    """Best prices, sizes, spread and imbalance within depth levels, by symbol and time, from one conditional aggregation."""
    bid, ask, near = F.col("side") == "bid", F.col("side") == "ask", F.col("level") < depth
    out = df.groupBy(spec.symbol, spec.ts).agg(
        F.max(F.when(bid & near, F.col("price"))).alias("best_bid"), F.min(F.when(ask & near, F.col("price"))).alias("best_ask"),
        F.sum(F.when(bid & near, F.col("size"))).alias("bid_size"), F.sum(F.when(ask & near, F.col("size"))).alias("ask_size"),
    )
    total = zero(F.col("bid_size")) + zero(F.col("ask_size"))
    return out.withColumns({"spread": F.col("best_ask") - F.col("best_bid"), "imbalance": zero(ratio(zero(F.col("bid_size")) - zero(F.col("ask_size")), total))})


def funding_features(df: DataFrame, spec: BarSpec = BARS) -> DataFrame:
    """Rate in basis points, its sign and its change as a share of the present rate; the mark's return. Missing ones are 0."""
    rate = F.col("funding_rate")
    return df.withColumns({
        "funding_bps": rate * 10000, "funding_direction": F.when(rate > 0, 1).when(rate < 0, -1).otherwise(0),
        "funding_rate_change": zero(ratio(rate - spec.lag("funding_rate"), rate)), "mark_return": zero(ratio(F.col("mark_price") - spec.lag("mark_price"), spec.lag("mark_price"))),
    })


def open_interest_features(df: DataFrame, spec: BarSpec = BARS) -> DataFrame:
    """Changes of open interest and of its value, and its share of the supply. Missing ones are 0."""
    change = lambda c: F.col(c) - spec.lag(c)
    return df.withColumns({
        "oi_change": zero(change("open_interest")), "oi_change_pct": zero(ratio(change("open_interest"), spec.lag("open_interest"))),
        "oi_value_change_pct": zero(ratio(change("open_interest_value"), spec.lag("open_interest_value"))), "oi_supply_ratio": zero(ratio(F.col("open_interest"), F.col("circulating_supply"))),
    })
