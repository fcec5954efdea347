"""Indicators with bounded frames: each is a DataFrame function over one window specification, all on the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlume.operators.derived import midrange, true_range
from barlume.plans.spec import BARS, BarSpec, ratio, require


def finish(df: DataFrame, spec: BarSpec, values: dict[str, Column], full: bool = True) -> DataFrame:
    """(symbol, ts, values), if full without rows in which a value is missing: the warm-up goes. See BarSpec for keep."""
    if spec.keep:
        return df.withColumns(values)
    out = df.select(spec.symbol, spec.ts, *[v.alias(k) for k, v in values.items()])
    return out.dropna(subset=list(values)) if full else out


def sma(df: DataFrame, period: int = 20, column: str = "close", spec: BarSpec = BARS) -> DataFrame:
    return finish(df, spec, {"value": spec.roll(F.avg, column, period)})


def bbands(df: DataFrame, period: int = 20, std_dev: float = 2.0, column: str = "close", spec: BarSpec = BARS) -> DataFrame:
    """Mean and std_dev sample deviations around it."""
    m, s = spec.roll(F.avg, column, period), spec.roll(F.stddev_samp, column, period)
    return finish(df, spec, {"upper": m + std_dev * s, "middle": m, "lower": m - std_dev * s})


def roc(df: DataFrame, period: int = 10, column: str = "close", spec: BarSpec = BARS) -> DataFrame:
    before = spec.lag(column, period)
    return finish(df, spec, {"value": ratio(F.col(column) - before, before) * 100})


def mom(df: DataFrame, period: int = 10, column: str = "close", spec: BarSpec = BARS) -> DataFrame:
    return finish(df, spec, {"value": F.col(column) - spec.lag(column, period)})


def stochastic(df: DataFrame, k_period: int = 14, d_period: int = 3, smooth_k: int = 3, high: str = "high", low: str = "low", close: str = "close", spec: BarSpec = BARS) -> DataFrame:
    """%K smoothed and %D; a flat window has no %K, nor have the means it takes part in."""
    top, bottom = spec.roll(F.max, high, k_period), spec.roll(F.min, low, k_period)
    df = df.withColumn("__k", ratio(F.col(close) - bottom, top - bottom) * 100)
    df = df.withColumn("stoch_k", spec.roll(F.avg, "__k", smooth_k))
    return finish(df, spec, {"stoch_k": F.col("stoch_k"), "stoch_d": spec.roll(F.avg, "stoch_k", d_period)})


def stochastic_midrange(df: DataFrame, k_period: int = 14, d_period: int = 3, smooth_k: int = 3, spec: BarSpec = BARS) -> DataFrame:
    """The stochastic of the midrange within its own extremes."""
    return stochastic(df.withColumn("midrange", midrange()), k_period, d_period, smooth_k, "midrange", "midrange", "midrange", spec)


def weighted(x: str, n: int, spec: BarSpec) -> Column:
    """Mean of the last n values with weights 1 to n."""
    total = sum(((n - k) * spec.lag(x, k) for k in range(1, n)), n * F.col(x)) / (n * (n + 1) / 2)
    return F.when(F.count(x).over(spec.last(n)) == n, total)


def wma(df: DataFrame, period: int = 20, column: str = "close", spec: BarSpec = BARS) -> DataFrame:
    return finish(df, spec, {"value": weighted(column, period, spec)})


def hma(df: DataFrame, period: int = 55, column: str = "close", spec: BarSpec = BARS) -> DataFrame:
    """The weighted mean, over the root of the period, of twice the half-period mean less the whole-period one."""
    df = df.withColumn("__h", 2 * weighted(column, period // 2, spec) - weighted(column, period, spec))
    return finish(df, spec, {"value": weighted("__h", int(period**0.5), spec)})


def mavp(df: DataFrame, least: int = 2, most: int = 30, column: str = "close", periods: str = "periods", spec: BarSpec = BARS) -> DataFrame:
    """The mean of as many last values as the column periods says, kept within least and most; from the most-th row of a symbol on.

    Running sums, of differences from the symbol's first value, and those of the row before the frame, which a join by row
    number finds: so most may be any number. Null where the period, or a value of the frame, is missing. Without a column
    periods all are most.
    """
    require(df, column)
    period = F.col(periods) if periods in df.columns else F.lit(most)
    if not 1 <= least <= most:
        raise ValueError("1 <= least <= most must hold")
    first = F.first(column, ignorenulls=True).over(spec.so_far)
    own = df.withColumns({"__rn": F.row_number().over(spec.order), "__base": first})
    own = own.withColumns({"__s": F.sum(F.coalesce(F.col(column) - F.col("__base"), F.lit(0.0))).over(spec.so_far), "__k": F.count(column).over(spec.so_far)})
    own = own.withColumn("__p", F.when(period.isNotNull(), F.greatest(F.lit(least), F.least(F.lit(most), period.cast("int")))))
    past = own.select(F.col(spec.symbol).alias("__symbol"), F.col("__rn").alias("__at"), F.col("__s").alias("__s0"), F.col("__k").alias("__k0"))
    met = own.join(past, F.col(spec.symbol).eqNullSafe(F.col("__symbol")) & (F.col("__rn") - F.col("__p") == F.col("__at")), "left")
    full = (F.col("__k") - F.coalesce("__k0", F.lit(0)) == F.col("__p")) & (F.col("__rn") >= most)
    value = F.when(full, F.col("__base") + (F.col("__s") - F.coalesce("__s0", F.lit(0.0))) / F.col("__p"))
    met = met.withColumn("value", value).drop("__rn", "__base", "__s", "__k", "__p", "__symbol", "__at", "__s0", "__k0")
    return met if spec.keep else met.select(spec.symbol, spec.ts, "value").filter("value IS NOT NULL")


def abnormal_turnover(df: DataFrame, window: int = 55, spec: BarSpec = BARS) -> DataFrame:
    require(df, "volume")
    m, s = spec.roll(F.avg, "volume", window), spec.roll(F.stddev_samp, "volume", window)
    return finish(df, spec, {"value": ratio(F.col("volume") - m, s)})


def normalized_volume(df: DataFrame, window: int = 55, spec: BarSpec = BARS) -> DataFrame:
    require(df, "volume")
    return finish(df, spec, {"value": ratio(F.col("volume"), spec.roll(F.avg, "volume", window))})


def roll_extreme_midrange(df: DataFrame, lookback: int = 20, spec: BarSpec = BARS) -> DataFrame:
    """Half the sum of the highest high and the lowest low; kept with nulls until the frame is full."""
    return finish(df, spec, {"value": (spec.roll(F.max, "high", lookback) + spec.roll(F.min, "low", lookback)) / 2}, full=False)


def roll_mean_midrange(df: DataFrame, lookback: int = 20, spec: BarSpec = BARS) -> DataFrame:
    return finish(df, spec, {"value": spec.roll(F.avg, midrange(), lookback)}, full=False)


def trailing_range_vol(df: DataFrame, lookback: int = 20, spec: BarSpec = BARS) -> DataFrame:
    return finish(df, spec, {"value": spec.roll(F.avg, F.col("high") - F.col("low"), lookback)}, full=False)


def willr(df: DataFrame, period: int = 14, spec: BarSpec = BARS) -> DataFrame:
    top, bottom = spec.roll(F.max, "high", period), spec.roll(F.min, "low", period)
    return finish(df, spec, {"value": ratio(top - F.col("close"), top - bottom) * -100})


def cci(df: DataFrame, period: int = 14, spec: BarSpec = BARS) -> DataFrame:
    """Distance of the typical price from its mean, in 0.015 mean absolute deviations."""
    df = df.withColumn("__tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    df = df.withColumns({"__m": spec.roll(F.avg, "__tp", period), "__all": F.collect_list("__tp").over(spec.last(period))})
    dev = F.aggregate("__all", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("__m"))) / period
    return finish(df, spec, {"value": ratio(F.col("__tp") - F.col("__m"), 0.015 * dev)})


def mfi(df: DataFrame, period: int = 14, spec: BarSpec = BARS) -> DataFrame:
    """100 where no money flows out."""
    df = df.withColumn("__tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    flow, step = F.col("__tp") * F.col("volume"), F.col("__tp") - spec.lag("__tp")
    df = df.withColumns({"__up": F.when(step.isNotNull(), F.when(step > 0, flow).otherwise(0.0)), "__down": F.when(step.isNotNull(), F.when(step < 0, flow).otherwise(0.0))})
    up, down = spec.roll(F.sum, "__up", period), spec.roll(F.sum, "__down", period)
    return finish(df, spec, {"value": F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + ratio(up, down)))})


def obv(df: DataFrame, spec: BarSpec = BARS) -> DataFrame:
    step = F.col("close") - spec.lag("close")
    df = df.withColumn("__v", F.when(step > 0, F.col("volume")).when(step < 0, -F.col("volume")).otherwise(0.0))
    return finish(df, spec, {"value": F.sum("__v").over(spec.so_far)})


def close_location() -> Column:
    """Where the close lies in the bar, -1 to 1; 0 in a flat bar."""
    return F.coalesce(ratio(2 * F.col("close") - F.col("low") - F.col("high"), F.col("high") - F.col("low")), F.lit(0.0))


def ad(df: DataFrame, spec: BarSpec = BARS) -> DataFrame:
    df = df.withColumn("__f", close_location() * F.col("volume"))
    return finish(df, spec, {"value": F.sum("__f").over(spec.so_far)})


def arg_extreme(x: str, n: int, spec: BarSpec, highest: bool) -> Column:
    """Bars since the extreme of the last n values, the latest of equal ones."""
    place = F.struct((F.col(x) if highest else -F.col(x)).alias("v"), F.col("__rn").alias("i"))
    return F.row_number().over(spec.order) - F.max(F.when(F.col(x).isNotNull(), place)).over(spec.last(n))["i"]


def aroon(df: DataFrame, period: int = 14, spec: BarSpec = BARS) -> DataFrame:
    df = df.withColumn("__rn", F.row_number().over(spec.order))
    full = F.count("high").over(spec.last(period + 1)) == period + 1
    value = lambda x, top: F.when(full, 100.0 * (period - arg_extreme(x, period + 1, spec, top)) / period)
    return finish(df, spec, {"aroon_up": value("high", True), "aroon_down": value("low", False)})


def bop(df: DataFrame, spec: BarSpec = BARS) -> DataFrame:
    return finish(df, spec, {"value": ratio(F.col("close") - F.col("open"), F.col("high") - F.col("low"))})


def ultosc(df: DataFrame, period1: int = 7, period2: int = 14, period3: int = 28, spec: BarSpec = BARS) -> DataFrame:
    """Buying pressure over true range in three frames, weighted 4, 2 and 1."""
    p = spec.lag("close")
    df = df.withColumns({"__bp": F.col("close") - F.least(F.col("low"), p), "__tr": F.when(p.isNotNull(), true_range(spec))})
    df = df.withColumn("__bp", F.when(F.col("__tr").isNotNull(), F.col("__bp")))
    part = lambda n: ratio(spec.roll(F.sum, "__bp", n), spec.roll(F.sum, "__tr", n))
    return finish(df, spec, {"value": 100 * (4 * part(period1) + 2 * part(period2) + part(period3)) / 7})


def trange(df: DataFrame, spec: BarSpec = BARS) -> DataFrame:
    return finish(df, spec, {"value": true_range(spec)})


def stoch_fast(df: DataFrame, k_period: int = 14, d_period: int = 3, spec: BarSpec = BARS) -> DataFrame:
    top, bottom = spec.roll(F.max, "high", k_period), spec.roll(F.min, "low", k_period)
    df = df.withColumn("fast_k", ratio(F.col("close") - bottom, top - bottom) * 100)
    return finish(df, spec, {"fast_k": F.col("fast_k"), "fast_d": spec.roll(F.avg, "fast_k", d_period)})


def pair_frame(f: Callable[[Column, Column], Column], y: Column, x: Column, n: int, spec: BarSpec) -> Column:
    both = F.when(y.isNotNull() & x.isNotNull(), F.lit(1))
    return F.when(F.count(both).over(spec.last(n)) == n, f(y, x).over(spec.last(n)))


def beta(df: DataFrame, period: int = 5, spec: BarSpec = BARS) -> DataFrame:
    """Slope of the close's returns on the high's."""
    change = lambda c: ratio(F.col(c), spec.lag(c)) - 1
    df = df.withColumns({"__y": change("close"), "__x": change("high")})
    return finish(df, spec, {"value": pair_frame(F.regr_slope, F.col("__y"), F.col("__x"), period, spec)})


def correl(df: DataFrame, period: int = 30, spec: BarSpec = BARS) -> DataFrame:
    """Correlation of close and high."""
    return finish(df, spec, {"value": pair_frame(F.corr, F.col("close"), F.col("high"), period, spec)})


def min_max_index(df: DataFrame, period: int = 30, column: str = "close", spec: BarSpec = BARS) -> DataFrame:
    """Rolling extremes and the bars since them."""
    df = df.withColumn("__rn", F.row_number().over(spec.order))
    full = F.count(column).over(spec.last(period)) == period
    return finish(df, spec, {
        "min": spec.roll(F.min, column, period), "max": spec.roll(F.max, column, period),
        "min_ago": F.when(full, arg_extreme(column, period, spec, False)), "max_ago": F.when(full, arg_extreme(column, period, spec, True)),
    })


def autocorr(df: DataFrame, period: int = 30, lag: int = 1, column: str = "close", spec: BarSpec = BARS) -> DataFrame:
    """Correlation with the series lag bars before; ValueError unless period > lag."""
    if period <= lag:
        raise ValueError("period must exceed lag")
    df = df.withColumn("__x", spec.lag(column, lag))
    return finish(df, spec, {"value": pair_frame(F.corr, F.col(column), F.col("__x"), period, spec)})


def linearreg_slope(df: DataFrame, period: int = 14, column: str = "close", spec: BarSpec = BARS) -> DataFrame:
    df = df.withColumn("__rn", F.row_number().over(spec.order).cast("double"))
    return finish(df, spec, {"value": pair_frame(F.regr_slope, F.col(column), F.col("__rn"), period, spec)})


def price_transforms(df: DataFrame, spec: BarSpec = BARS) -> DataFrame:
    """Median, typical, weighted and average price."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return finish(df, spec, {"medprice": (h + lo) / 2, "typprice": (h + lo + c) / 3, "wclprice": (h + lo + 2 * c) / 4, "avgprice": (o + h + lo + c) / 4})


def candle(df: DataFrame, pattern: str, spec: BarSpec = BARS) -> DataFrame:
    """100, -100 or 0 for a candle pattern: doji, hammer or engulfing."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    body, spread = F.abs(c - o), h - lo
    if pattern == "doji":
        value = F.when((spread > 0) & (body <= 0.1 * spread), 100).otherwise(0)
    elif pattern == "hammer":
        value = F.when((body > 0) & (F.least(o, c) - lo >= 2 * body) & (h - F.greatest(o, c) <= body), 100).otherwise(0)
    elif pattern == "engulfing":
        po, pc = spec.lag("open"), spec.lag("close")
        value = F.when((pc < po) & (c > o) & (c >= po) & (o <= pc), 100).when((pc > po) & (c < o) & (o >= pc) & (c <= po), -100).otherwise(0)
    else:
        raise ValueError(f"unknown pattern {pattern}")
    return finish(df, spec, {"value": value})


def extreme(highest: bool) -> Callable[..., DataFrame]:
    def f(df: DataFrame, period: int = 30, column: str = "close", spec: BarSpec = BARS) -> DataFrame:
        return finish(df, spec, {"value": spec.roll(F.max if highest else F.min, column, period)})

    return f


def extreme_index(highest: bool) -> Callable[..., DataFrame]:
    def f(df: DataFrame, period: int = 30, column: str = "close", spec: BarSpec = BARS) -> DataFrame:
        """Bars since the extreme."""
        df = df.withColumn("__rn", F.row_number().over(spec.order))
        return finish(df, spec, {"value": F.when(F.count(column).over(spec.last(period)) == period, arg_extreme(column, period, spec, highest))})

    return f


def min_max(df: DataFrame, period: int = 30, column: str = "close", spec: BarSpec = BARS) -> DataFrame:
    return finish(df, spec, {"min": spec.roll(F.min, column, period), "max": spec.roll(F.max, column, period)})


def midpoint(df: DataFrame, period: int = 14, column: str = "close", spec: BarSpec = BARS) -> DataFrame:
    return finish(df, spec, {"value": (spec.roll(F.max, column, period) + spec.roll(F.min, column, period)) / 2})


def midprice(df: DataFrame, period: int = 14, spec: BarSpec = BARS) -> DataFrame:
    return finish(df, spec, {"value": (spec.roll(F.max, "high", period) + spec.roll(F.min, "low", period)) / 2})


def rolling_sum(df: DataFrame, period: int = 30, column: str = "close", spec: BarSpec = BARS) -> DataFrame:
    return finish(df, spec, {"value": spec.roll(F.sum, column, period)})


def stddev(df: DataFrame, period: int = 5, deviations: float = 1.0, column: str = "close", spec: BarSpec = BARS) -> DataFrame:
    """Population deviations of the last values."""
    return finish(df, spec, {"value": deviations * spec.roll(F.stddev_pop, column, period)})


def variance(df: DataFrame, period: int = 5, column: str = "close", spec: BarSpec = BARS) -> DataFrame:
    return finish(df, spec, {"value": spec.roll(F.var_pop, column, period)})


def rocp(df: DataFrame, period: int = 10, column: str = "close", spec: BarSpec = BARS) -> DataFrame:
    return finish(df, spec, {"value": ratio(F.col(column), spec.lag(column, period)) - 1})


def rocr(df: DataFrame, period: int = 10, factor: float = 1.0, column: str = "close", spec: BarSpec = BARS) -> DataFrame:
    return finish(df, spec, {"value": factor * ratio(F.col(column), spec.lag(column, period))})


def trima(df: DataFrame, period: int = 30, column: str = "close", spec: BarSpec = BARS) -> DataFrame:
    """The mean of means, over half the period each."""
    df = df.withColumn("__s", spec.roll(F.avg, column, (period + 1) // 2))
    return finish(df, spec, {"value": spec.roll(F.avg, "__s", period // 2 + 1)})


def linear_regression(df: DataFrame, period: int = 14, column: str = "close", spec: BarSpec = BARS) -> DataFrame:
    """The line through the last values: its value at the last bar and at the next, at the first, and its angle in degrees."""
    df = df.withColumn("__rn", F.row_number().over(spec.order).cast("double"))
    fit = lambda f: pair_frame(f, F.col(column), F.col("__rn"), period, spec)
    df = df.withColumns({"__a": fit(F.regr_intercept), "__b": fit(F.regr_slope)})
    at = lambda n: F.col("__a") + F.col("__b") * (F.col("__rn") + n)
    return finish(df, spec, {"value": at(0), "forecast": at(1), "intercept": at(1 - period), "angle": F.degrees(F.atan("__b"))})
