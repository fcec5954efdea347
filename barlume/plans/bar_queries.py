"""Queries over single bars and bounded frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlume.operators import derived, windowed
from barlume.plans.catalogue import query
from barlume.plans.oracle import W, frame, lag, last, r, roll, rounded, values, with_bars
from barlume.sources import market

P = "(lag(close) OVER (PARTITION BY symbol ORDER BY ts))"
TR = f"greatest(high - low, abs(high - {P}), abs(low - {P}))"
MID = "((high + low) / 2)"


def on_bars(name: str, sql: str, f: Callable[[DataFrame], DataFrame], unit: str = "hour") -> None:
    """Registers f over the bars."""
    query(name, sql)(lambda spark, sf_dir: rounded(f(market.bars(spark, sf_dir, unit))))


on_bars("derived_fields", with_bars(
    f"SELECT *, {MID} AS midrange, high - low AS range, {TR} AS true_range FROM prev",
    f"""SELECT symbol, ts, open, high, low, close, volume, {r('midrange', 'midrange')}, {r('range', 'range')}, {r('true_range', 'true_range')},
      {r(f"greatest(range, abs(midrange - {lag('midrange')}))", 'true_range_midrange')}, {r(f"greatest(range, abs(high - {lag('high')}), abs(low - {lag('low')}))", 'true_range_hl')} FROM prev""",
), derived.derived_fields)

on_bars("returns_simple", with_bars(f"SELECT symbol, ts, {r(f'(close - {P}) / nullif({P}, 0)', 'return')} FROM prev"), lambda b: derived.returns(b).select("symbol", "ts", "return"))
on_bars("returns_log_5", with_bars(f"SELECT symbol, ts, {r(f'ln(close / nullif({lag("close", 5)}, 0))', 'log_return_5')} FROM prev"), lambda b: derived.returns(b, periods=5, log_returns=True).select("symbol", "ts", "log_return_5"))
RET = f"SELECT symbol, ts, close / nullif({P}, 0) - 1 AS q FROM prev"
on_bars("volatility_20", with_bars(RET, f"SELECT symbol, ts, {r(roll('stddev_samp', 'q', 20) + ' * sqrt(252)', 'volatility')} FROM prev"), lambda b: derived.volatility(b).select("symbol", "ts", "volatility"))
on_bars("rolling_returns", with_bars(
    f"SELECT symbol, ts, ln(close / nullif({P}, 0)) AS q FROM prev",
    "SELECT symbol, ts, " + ", ".join(r(roll({"sum": "sum", "mean": "avg"}[a], "q", n), f"return_{a}_{n}") for n in (55, 210) for a in ("sum", "mean")) + " FROM prev",
), lambda b: derived.rolling_returns(b, windows=[55, 210]).drop("open", "high", "low", "close", "volume"))
on_bars("multi_window_volatility", with_bars(RET, "SELECT symbol, ts, " + ", ".join(r(roll("stddev_samp", "q", n) + " * sqrt(252)", f"volatility_{n}") for n in (55, 210, 340)) + " FROM prev"),
        lambda b: derived.multi_window_volatility(b, windows=[55, 210, 340]).drop("open", "high", "low", "close", "volume"))

on_bars("sma", with_bars(values("prev", {"value": roll("avg", "close", 20)})), windowed.sma)
on_bars("bbands", with_bars(f"SELECT *, {roll('avg', 'close', 20)} AS m, {roll('stddev_samp', 'close', 20)} AS s FROM prev", values("prev", {"upper": "m + 2.0 * s", "middle": "m", "lower": "m - 2.0 * s"})), windowed.bbands)
on_bars("roc", with_bars(values("prev", {"value": f"(close - {lag('close', 10)}) / nullif({lag('close', 10)}, 0) * 100"})), windowed.roc)
on_bars("mom", with_bars(values("prev", {"value": f"close - {lag('close', 10)}"})), windowed.mom)


def stochastic_sql(h: str, lo: str, c: str) -> str:
    top, bottom = roll("max", h, 14), roll("min", lo, 14)
    return with_bars(
        f"SELECT *, {MID} AS midrange FROM prev", f"SELECT symbol, ts, ({c} - {bottom}) / nullif({top} - {bottom}, 0) * 100 AS k FROM prev",
        f"SELECT symbol, ts, {roll('avg', 'k', 3)} AS stoch_k FROM prev", values("prev", {"stoch_k": "stoch_k", "stoch_d": roll("avg", "stoch_k", 3)}),
    )


on_bars("stochastic", stochastic_sql("high", "low", "close"), windowed.stochastic)
on_bars("stochastic_midrange", stochastic_sql("midrange", "midrange", "midrange"), windowed.stochastic_midrange)


def weighted_sql(x: str, n: int) -> str:
    total = " + ".join([f"{n} * {x}", *[f"{n - k} * {lag(x, k)}" for k in range(1, n)]])
    return f"(CASE WHEN count({x}) OVER {last(n)} = {n} THEN ({total}) / {n * (n + 1) / 2} END)"


on_bars("wma", with_bars(values("prev", {"value": weighted_sql("close", 20)})), windowed.wma)
on_bars("hma", with_bars(f"SELECT symbol, ts, 2 * {weighted_sql('close', 27)} - {weighted_sql('close', 55)} AS h FROM prev", values("prev", {"value": weighted_sql("h", 7)})), windowed.hma)
on_bars("abnormal_turnover", with_bars(values("prev", {"value": f"(volume - {roll('avg', 'volume', 55)}) / nullif({roll('stddev_samp', 'volume', 55)}, 0)"})), windowed.abnormal_turnover)
on_bars("normalized_volume", with_bars(values("prev", {"value": f"volume / nullif({roll('avg', 'volume', 55)}, 0)"})), windowed.normalized_volume)
on_bars("roll_extreme_midrange", with_bars(f"SELECT symbol, ts, {r(f'({roll("max", "high", 20)} + {roll("min", "low", 20)}) / 2', 'value')} FROM prev"), windowed.roll_extreme_midrange)
on_bars("roll_mean_midrange", with_bars(f"SELECT symbol, ts, {r(roll('avg', MID, 20), 'value')} FROM prev"), windowed.roll_mean_midrange)
on_bars("trailing_range_vol", with_bars(f"SELECT symbol, ts, {r(roll('avg', '(high - low)', 20), 'value')} FROM prev"), windowed.trailing_range_vol)
on_bars("willr", with_bars(values("prev", {"value": f"({roll('max', 'high', 14)} - close) / nullif({roll('max', 'high', 14)} - {roll('min', 'low', 14)}, 0) * -100"})), windowed.willr)
TP = "(high + low + close) / 3 AS tp"
on_bars("cci", with_bars(
    f"SELECT symbol, ts, {TP} FROM prev", f"SELECT *, {roll('avg', 'tp', 14)} AS m, list(tp) OVER {last(14)} AS xs FROM prev",
    values("(SELECT symbol, ts, tp, m, list_sum(list_transform(xs, lambda x: abs(x - m))) / 14 AS d FROM prev)", {"value": "(tp - m) / nullif(0.015 * d, 0)"}),
), windowed.cci)
on_bars("mfi", with_bars(
    f"SELECT *, {TP} FROM prev", f"SELECT *, tp - {lag('tp')} AS d, tp * volume AS f FROM prev",
    "SELECT *, CASE WHEN d IS NOT NULL THEN CASE WHEN d > 0 THEN f ELSE 0 END END AS up, CASE WHEN d IS NOT NULL THEN CASE WHEN d < 0 THEN f ELSE 0 END END AS down FROM prev",
    values("prev", {"value": f"CASE WHEN {roll('sum', 'down', 14)} = 0 THEN 100.0 ELSE 100 - 100 / (1 + {roll('sum', 'up', 14)} / {roll('sum', 'down', 14)}) END"}),
), windowed.mfi)
on_bars("obv", with_bars(f"SELECT *, CASE WHEN close > {P} THEN volume WHEN close < {P} THEN -volume ELSE 0 END AS v FROM prev", values("prev", {"value": f"sum(v) OVER {frame('UNBOUNDED PRECEDING')}"})), windowed.obv)
CLV = "coalesce((2 * close - low - high) / nullif(high - low, 0), 0)"
on_bars("ad", with_bars(f"SELECT *, {CLV} * volume AS f FROM prev", values("prev", {"value": f"sum(f) OVER {frame('UNBOUNDED PRECEDING')}"})), windowed.ad)


def ago(x: str, n: int, sign: str) -> str:
    return f"(CASE WHEN count({x}) OVER {last(n)} = {n} THEN rn - (max({{'v': {sign}{x}, 'i': rn}}) OVER {last(n)}).i END)"


RN = f"SELECT *, row_number() OVER {W} AS rn FROM prev"
on_bars("aroon", with_bars(RN, values("prev", {"aroon_up": f"100.0 * (14 - {ago('high', 15, '')}) / 14", "aroon_down": f"100.0 * (14 - {ago('low', 15, '-')}) / 14"})), windowed.aroon)
on_bars("min_max_index", with_bars(RN, f"""SELECT symbol, ts, {r('mn', 'min')}, {r('mx', 'max')}, CAST(a AS INTEGER) AS min_ago, CAST(b AS INTEGER) AS max_ago FROM (
  SELECT symbol, ts, {roll('min', 'close', 30)} AS mn, {roll('max', 'close', 30)} AS mx, {ago('close', 30, '-')} AS a, {ago('close', 30, '')} AS b FROM prev) WHERE mn IS NOT NULL"""), windowed.min_max_index)
on_bars("bop", with_bars(values("prev", {"value": "(close - open) / nullif(high - low, 0)"})), windowed.bop)


def ult(n: int) -> str:
    return f"{roll('sum', 'bp', n)} / nullif({roll('sum', 'tr', n)}, 0)"


on_bars("ultosc", with_bars(
    f"SELECT symbol, ts, CASE WHEN {P} IS NOT NULL THEN close - least(low, {P}) END AS bp, CASE WHEN {P} IS NOT NULL THEN {TR} END AS tr FROM prev",
    values("prev", {"value": f"100 * (4 * ({ult(7)}) + 2 * ({ult(14)}) + {ult(28)}) / 7"}),
), windowed.ultosc)
on_bars("trange", with_bars(values("prev", {"value": TR})), windowed.trange)
on_bars("stoch_fast", with_bars(
    f"SELECT symbol, ts, (close - {roll('min', 'low', 14)}) / nullif({roll('max', 'high', 14)} - {roll('min', 'low', 14)}, 0) * 100 AS k FROM prev", values("prev", {"fast_k": "k", "fast_d": roll("avg", "k", 3)}),
), windowed.stoch_fast)


def pair(f: str, y: str, x: str, n: int) -> str:
    return f"(CASE WHEN count({y} + {x}) OVER {last(n)} = {n} THEN {f}({y}, {x}) OVER {last(n)} END)"


def some(x: str) -> str:
    """DuckDB gives NaN where a frame has no spread; here that is missing."""
    return f"CASE WHEN isfinite({x}) THEN {x} END"


on_bars("beta", with_bars(f"SELECT symbol, ts, close / nullif({P}, 0) - 1 AS y, high / nullif({lag('high')}, 0) - 1 AS x FROM prev", values("prev", {"value": some(pair("regr_slope", "y", "x", 5))})), windowed.beta)
on_bars("correl", with_bars(values("prev", {"value": some(pair("corr", "close", "high", 30))})), windowed.correl)
on_bars("autocorr", with_bars(f"SELECT *, {P} AS x FROM prev", values("prev", {"value": some(pair("corr", "close", "x", 30))})), windowed.autocorr)
on_bars("linearreg_slope", with_bars(RN, values("prev", {"value": pair("regr_slope", "close", "CAST(rn AS DOUBLE)", 14)})), windowed.linearreg_slope)
on_bars("price_transforms", with_bars(values("prev", {"medprice": "(high + low) / 2", "typprice": "(high + low + close) / 3", "wclprice": "(high + low + 2 * close) / 4", "avgprice": "(open + high + low + close) / 4"})), windowed.price_transforms)
PO = lag("open")
CANDLES = {
    "doji": "CASE WHEN high > low AND abs(close - open) <= 0.1 * (high - low) THEN 100 ELSE 0 END",
    "hammer": "CASE WHEN abs(close - open) > 0 AND least(open, close) - low >= 2 * abs(close - open) AND high - greatest(open, close) <= abs(close - open) THEN 100 ELSE 0 END",
    "engulfing": f"CASE WHEN {P} < {PO} AND close > open AND close >= {PO} AND open <= {P} THEN 100 WHEN {P} > {PO} AND close < open AND open >= {P} AND close <= {PO} THEN -100 ELSE 0 END",
}
for _name, _sql in CANDLES.items():
    on_bars(f"cdl_{_name}", with_bars(f"SELECT symbol, ts, {_sql} AS value FROM prev"), lambda b, n=_name: windowed.candle(b, n))

CHANGE = "coalesce(({0} - {1}) / nullif({1}, 0), 0)"
on_bars("forex_features", with_bars(
    f"SELECT symbol, ts, {MID} AS mid, high - low AS spread, volume AS vol, {TR} AS tr FROM prev",
    f"""SELECT *, ln(mid / nullif({lag('mid')}, 0)) AS a, {CHANGE.format('spread', lag('spread'))} AS b, {CHANGE.format('vol', lag('vol'))} AS c,
      {roll('avg', 'tr', 14)} AS atr, row_number() OVER {W} AS n, count(*) OVER (PARTITION BY symbol) AS n_all FROM prev""",
    f"SELECT *, (atr - {roll('avg', 'atr', 50)}) / ({roll('stddev_samp', 'atr', 50)} + 1e-10) AS d FROM prev",
    values("(SELECT * FROM prev WHERE n_all <= 150 OR n > 150)", {"midrange_return": "a", "range_change": "b", "volume_change": "c", "atr_zscore": "d"}),
), derived.forex_features)


@query("indicator_batch", with_bars(f"""SELECT symbol, ts, {r(roll('avg', 'close', 20), 'sma')}, {r(f'close / nullif({lag("close", 10)}, 0) * 100 - 100', 'roc')},
    {r(roll('stddev_pop', 'close', 20), 'dev')} FROM prev"""))
def indicator_batch(spark, sf_dir):  # noqa: ANN001, ANN201
    """Several indicators in one projection over one sort, instead of a join for each."""
    from barlume.operators.batch import compute_indicators

    return rounded(compute_indicators(market.bars(spark, sf_dir), {"sma": ("sma", {"period": 20}), "roc": ("roc", {"timeperiod": 10}), "dev": ("stddev", {"period": 20})}))


SWEEP = {"sma": {"period": [5, 8]}, "mom": {"period": [3, 5]}, "stddev": {"period": [8]}}


@query("indicator_sweep", with_bars(f"""SELECT symbol, ts, {r(roll('avg', 'close', 5), 'sma_period5')}, {r(roll('avg', 'close', 8), 'sma_period8')}, {r(f'close - {lag("close", 3)}', 'mom_period3')},
    {r(f'close - {lag("close", 5)}', 'mom_period5')}, {r(roll('stddev_pop', 'close', 8), 'stddev_period8')} FROM prev"""))
def indicator_sweep(spark, sf_dir):  # noqa: ANN001, ANN201
    """Every combination of several grids in one job."""
    from barlume.operators import sweeps

    return rounded(sweeps.compute(market.bars(spark, sf_dir), sweeps.specs(SWEEP, include_defaults=False)))
