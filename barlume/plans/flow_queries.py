"""Queries over resampling, alignment, microstructure, labels and recursive indicators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlume.operators import asof, labels, microstructure, recursive, resample, scans
from barlume.operators.batch import compute_indicators
from barlume.plans.bar_queries import CANDLES, MID, TR, P, ago, on_bars, pair
from barlume.plans.catalogue import SQL, query
from barlume.plans.oracle import BOOK_SQL, TRADES_SQL, W, bars_sql, frame, lag, last, r, roll, rounded, values, with_bars
from barlume.sources import market

# ---- resampling and alignment


def resample_sql(start: str, least: int) -> str:
    return f"""SELECT symbol, {start} AS ts, min_by(open, ts) AS open, max(high) AS high, min(low) AS low, max_by(close, ts) AS close, sum(volume) AS volume
      FROM bars GROUP BY 1, 2 HAVING count(*) >= {least}"""


STARTS = {"4h": "time_bucket(INTERVAL '4 hours', ts)", "1d": "date_trunc('day', ts)", "1w": "CAST(date_trunc('week', ts) AS TIMESTAMP)"}
for _name, _target, _least, _all in [("resample_4h", "4h", 4, False), ("resample_4h_all", "4h", 0, True), ("resample_1d_complete", "1d", 24, False), ("resample_1w", "1w", 0, True)]:
    on_bars(_name, with_bars(resample_sql(STARTS[_target], _least)), lambda b, t=_target, a=_all: resample.aggregate_to_timeframe(b, "1h", t, a))

HIGHER = f"h AS ({resample_sql(STARTS['4h'], 0)})"


@query("asof_higher_tf", f"WITH {bars_sql()}, {HIGHER} SELECT b.*, h.open AS open_higher, h.high AS high_higher, h.low AS low_higher, h.close AS close_higher, h.volume AS volume_higher FROM bars b ASOF LEFT JOIN h ON b.symbol = h.symbol AND b.ts >= h.ts")
def asof_higher_tf(spark, sf_dir):  # noqa: ANN001, ANN201
    b = market.bars(spark, sf_dir)
    return asof.align_higher_timeframe(b, resample.aggregate_to_timeframe(b, "1h", "4h", True))


@query("asof_features_shifted", f"""WITH {bars_sql()}, {HIGHER}, s AS (SELECT symbol, ts, lag(close) OVER {W} AS c FROM h)
  SELECT b.symbol, b.ts, b.close, s.c AS f_close FROM bars b ASOF LEFT JOIN s ON b.symbol = s.symbol AND b.ts >= s.ts""")
def asof_features_shifted(spark, sf_dir):  # noqa: ANN001, ANN201
    b = market.bars(spark, sf_dir)
    higher = resample.aggregate_to_timeframe(b, "1h", "4h", True).select("symbol", "ts", "close")
    return asof.align_feature_frame(b.select("symbol", "ts", "close"), higher, shift=1, prefix="f_")


@query("asof_multi", f"""WITH {bars_sql()}, {HIGHER}, d AS ({resample_sql(STARTS['1d'], 0)})
  SELECT b.symbol, b.ts, h.close AS four_close, d.volume AS day_volume FROM bars b ASOF LEFT JOIN h ON b.symbol = h.symbol AND b.ts >= h.ts
  ASOF LEFT JOIN d ON b.symbol = d.symbol AND b.ts >= d.ts""")
def asof_multi(spark, sf_dir):  # noqa: ANN001, ANN201
    b = market.bars(spark, sf_dir)
    up = lambda t, c: resample.aggregate_to_timeframe(b, "1h", t, True).select("symbol", "ts", c)
    return asof.align_feature_frames(b.select("symbol", "ts"), {"four": up("4h", "close"), "day": up("1d", "volume")})


# ---- microstructure


@query("trade_bars", f"""WITH {TRADES_SQL}, g AS (SELECT symbol, date_trunc('day', ts) AS t, ts, price, quantity, side FROM trades)
  SELECT symbol, CAST(t AS TIMESTAMP) AS ts, count(*) AS trade_count, {r("(max({'t': ts, 'p': price, 'q': quantity})).p", 'last_price')}, {r('sum(quantity)', 'volume')}, {r('sum(price * quantity)', 'notional')},
  {r("sum(CASE side WHEN 'buy' THEN quantity ELSE -quantity END)", 'signed_volume')}, {r('sum(price * quantity) / nullif(sum(quantity), 0)', 'vwap')},
  {r("sum(CASE side WHEN 'buy' THEN quantity ELSE -quantity END) / nullif(sum(quantity), 0)", 'trade_imbalance')} FROM g GROUP BY 1, 2""")
def trade_bars(spark, sf_dir):  # noqa: ANN001, ANN201
    return rounded(microstructure.trade_bars(market.trades(spark, sf_dir), "1 day"))


QUOTES = "SELECT symbol, ts, low AS bid, high AS ask, volume AS bid_size, CAST(1 + floor(open) AS DOUBLE) AS ask_size FROM prev"


def change(c: str) -> str:
    return f"coalesce(({c} - {lag(c)}) / nullif({lag(c)}, 0), 0)"


@query("quote_features", with_bars(
    QUOTES, "SELECT *, (bid + ask) / 2 AS m, ask - bid AS s, coalesce((bid * ask_size + ask * bid_size) / nullif(bid_size + ask_size, 0), 0) AS mp FROM prev",
    f"""SELECT symbol, ts, {r('m', 'quote_mid')}, {r('s', 'quoted_spread')}, {r('coalesce(s * 10000 / nullif(m, 0), 0)', 'quoted_spread_bps')}, {r(change('m'), 'mid_return')}, {r(change('s'), 'spread_change')},
    {r('coalesce((bid_size - ask_size) / nullif(bid_size + ask_size, 0), 0)', 'quote_imbalance')}, {r('mp', 'microprice')}, {r('coalesce((mp - m) / nullif(m, 0), 0) * 10000', 'microprice_edge_bps')} FROM prev""",
))
def quote_features(spark, sf_dir):  # noqa: ANN001, ANN201
    return rounded(microstructure.quote_features(market.quotes(spark, sf_dir)).drop("bid", "ask", "bid_size", "ask_size"))


@query("order_book", f"""WITH {BOOK_SQL}, g AS (SELECT symbol, ts, max(CASE WHEN side = 'bid' AND level < 2 THEN price END) AS bb, min(CASE WHEN side = 'ask' AND level < 2 THEN price END) AS ba,
  sum(CASE WHEN side = 'bid' AND level < 2 THEN size END) AS bs, sum(CASE WHEN side = 'ask' AND level < 2 THEN size END) AS az FROM book GROUP BY 1, 2)
  SELECT symbol, ts, {r('bb', 'best_bid')}, {r('ba', 'best_ask')}, {r('bs', 'bid_size')}, {r('az', 'ask_size')}, {r('ba - bb', 'spread')},
  {r('coalesce((coalesce(bs, 0) - coalesce(az, 0)) / nullif(coalesce(bs, 0) + coalesce(az, 0), 0), 0)', 'imbalance')} FROM g""")
def order_book(spark, sf_dir):  # noqa: ANN001, ANN201
    return rounded(microstructure.order_book_features(market.book(spark, sf_dir), depth=2))


@query("funding", with_bars(
    "SELECT symbol, ts, (close - open) / 10000 AS f, close AS m FROM prev",
    f"""SELECT symbol, ts, {r('f', 'funding_rate')}, {r('m', 'mark_price')}, {r('f * 10000', 'funding_bps')}, CASE WHEN f > 0 THEN 1 WHEN f < 0 THEN -1 ELSE 0 END AS funding_direction,
    {r(f"coalesce((f - {lag('f')}) / nullif(f, 0), 0)", 'funding_rate_change')}, {r(change('m'), 'mark_return')} FROM prev""",
))
def funding(spark, sf_dir):  # noqa: ANN001, ANN201
    return rounded(microstructure.funding_features(market.funding(spark, sf_dir)))


@query("open_interest", with_bars(
    "SELECT symbol, ts, volume AS o, volume * close AS v FROM prev",
    f"""SELECT symbol, ts, {r(f"coalesce(o - {lag('o')}, 0)", 'oi_change')}, {r(change('o'), 'oi_change_pct')}, {r(change('v'), 'oi_value_change_pct')}, {r('o / 10000', 'oi_supply_ratio')} FROM prev""",
))
def open_interest(spark, sf_dir):  # noqa: ANN001, ANN201
    return rounded(microstructure.open_interest_features(market.open_interest(spark, sf_dir)).drop("open_interest", "open_interest_value", "circulating_supply"))


@query("corwin_schultz", with_bars(
    "SELECT symbol, ts, ln(high / nullif(low, 0)) AS x FROM prev", f"SELECT symbol, x, {lag('x')} AS p FROM prev",
    "SELECT symbol, sum(x * x + p * p) AS b, sum((x + p) * (x + p)) AS g FROM prev GROUP BY 1", "SELECT symbol, b, g, (sqrt(2 * b) - sqrt(b)) / (3 - 2 * sqrt(2)) AS a FROM prev",
    f"SELECT symbol, {r('CASE WHEN b > 0 AND g > 0 THEN CASE WHEN a >= 700 THEN 2.0 ELSE greatest(0, 2 * (exp(least(a, 700)) - 1) / (1 + exp(least(a, 700)))) END ELSE 0 END', 'spread')} FROM prev",
))
def corwin_schultz(spark, sf_dir):  # noqa: ANN001, ANN201
    return rounded(microstructure.corwin_schultz_spread(market.bars(spark, sf_dir)))


# ---- labels

AHEAD = frame("1 FOLLOWING", "5 FOLLOWING")
TOUCH = "CAST(coalesce(list_filter(list_transform(f, lambda p: CASE WHEN p >= up THEN 1 WHEN p <= down THEN -1 ELSE 0 END), lambda z: z <> 0)[1], 0) AS INTEGER) AS label"
on_bars("binary_next_bar", with_bars(f"SELECT symbol, ts, CASE WHEN lead(close) OVER {W} > close THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label FROM prev"), lambda b: labels.binary_next_bar(b).select("symbol", "ts", "label"))
on_bars("triple_barrier_fixed", with_bars(f"SELECT *, list(close) OVER {AHEAD} AS f, close * (1 + 0.02::DOUBLE) AS up, close * (1 - 0.02::DOUBLE) AS down FROM prev", f"SELECT symbol, ts, {TOUCH} FROM prev"),
        lambda b: labels.triple_barrier(b, labels.TripleBarrier(0.02, 0.02)).select("symbol", "ts", "label"))
on_bars("triple_barrier_adaptive", with_bars(
    f"SELECT *, {change('close')} AS q FROM prev", f"SELECT *, list(close) OVER {AHEAD} AS f, stddev_samp(q) OVER {last(20)} AS d FROM prev",
    "SELECT *, close * (1 + 2.0::DOUBLE * CASE WHEN d > 0 THEN d ELSE 0.01::DOUBLE END) AS up, close * (1 - 2.0::DOUBLE * CASE WHEN d > 0 THEN d ELSE 0.01::DOUBLE END) AS down FROM prev", f"SELECT symbol, ts, {TOUCH} FROM prev",
), lambda b: labels.triple_barrier(b).select("symbol", "ts", "label"))
on_bars("triple_barrier_atr", with_bars(
    f"SELECT *, {TR} AS tr FROM prev", f"SELECT *, avg(tr) OVER {last(20)} AS atr, list({{'h': high, 'l': low}}) OVER {frame('1 FOLLOWING', '3 FOLLOWING')} AS f FROM prev",
    "SELECT *, close - atr AS sl, close + 2.0::DOUBLE * atr AS tp FROM prev",
    f"""SELECT symbol, ts, {r('atr', 'atr')}, {r('sl', 'sl')}, {r('tp', 'tp')}, CAST(CASE WHEN atr > 0 AND
    list_filter(list_transform(f, lambda x: CASE WHEN x.l <= sl THEN -1 WHEN x.h >= tp THEN 1 ELSE 0 END), lambda z: z <> 0)[1] = 1 THEN 1 ELSE 0 END AS INTEGER) AS label FROM prev""",
), lambda b: labels.triple_barrier_atr(b).select("symbol", "ts", "atr", "sl", "tp", "label"))
on_bars("forex_labels", with_bars(
    f"SELECT *, {TR} AS tr FROM prev", f"SELECT symbol, ts, ln(lead(close, 72) OVER {W} / nullif(close, 0)) AS q, 0.5 * (CASE WHEN count(tr) OVER {last(14)} = 14 THEN avg(tr) OVER {last(14)} END) AS k FROM prev",
    "SELECT symbol, ts, CASE WHEN q > k THEN 2 WHEN q < -k THEN 0 ELSE 1 END AS label FROM prev WHERE q IS NOT NULL AND k IS NOT NULL",
), labels.forex_labels)

# ---- recursive indicators: their SQL walks the rows by recursion


def ewm(name: str, source: str, columns: dict[str, tuple[str, float]]) -> str:
    """A recursive table of exponential means over source (symbol, rn, inputs)."""
    first = ", ".join(f"CAST({x} AS DOUBLE) AS {o}" for o, (x, _) in columns.items())
    then = ", ".join(f"{a!r}::DOUBLE * s.{x} + (1 - {a!r}::DOUBLE) * e.{o}" for o, (x, a) in columns.items())
    return f"{name} AS (SELECT symbol, rn, {first} FROM {source} WHERE rn = 1 UNION ALL SELECT s.symbol, s.rn, {then} FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.rn = e.rn + 1)"


def recursion(columns: str, *ctes: str, final: str) -> str:
    return f"WITH RECURSIVE {bars_sql()}, x AS (SELECT *, row_number() OVER {W} AS rn, {columns} FROM bars),\n" + ",\n".join(ctes) + "\n" + final


def on_kernel(name: str, sql: str, kernel: Callable, outputs: list[str]) -> None:
    on_bars(name, sql, lambda b: recursive.indicator(b, kernel, outputs))


def joined(table: str, cols: dict[str, str], skipped: int) -> str:
    return values(f"(SELECT x.*, e.* EXCLUDE (symbol, rn) FROM x JOIN {table} e USING (symbol, rn) WHERE rn > {skipped})", cols)


DIFF = f"close - {P}"
TRM = f"greatest(high - low, abs(high - lag({MID}) OVER {W}), abs(low - lag({MID}) OVER {W}))"
on_kernel("ema", recursion("close AS c", ewm("e", "x", {"y": ("c", 2 / 21)}), final=joined("e", {"value": "y"}, 20)), recursive.ema(), ["value"])
on_kernel("rsi", recursion(f"coalesce(greatest({DIFF}, 0), 0) AS g, coalesce(greatest(-({DIFF}), 0), 0) AS l", ewm("e", "x", {"ag": ("g", 1 / 14), "al": ("l", 1 / 14)}),
          final=joined("e", {"value": "CASE WHEN al = 0 THEN 100.0 ELSE 100 - 100 / (1 + ag / al) END"}, 14)), recursive.rsi(), ["value"])
on_kernel("macd", recursion("close AS c", ewm("e", "x", {"f": ("c", 2 / 13), "s": ("c", 2 / 27)}), "m AS (SELECT symbol, rn, f - s AS m FROM e)", ewm("g", "m", {"sg": ("m", 2 / 10)}), "k AS (SELECT symbol, rn, m, sg FROM m JOIN g USING (symbol, rn))",
          final=joined("k", {"macd": "m", "signal": "sg", "histogram": "m - sg"}, 26)), recursive.macd(), ["macd", "signal", "histogram"])
on_kernel("atr", recursion(f"{TR} AS tr", ewm("e", "x", {"y": ("tr", 1 / 14)}), final=joined("e", {"value": "y"}, 14)), recursive.atr(), ["value"])
for _name, _scan in (("ema", scans.ema), ("rsi", scans.rsi), ("macd", scans.macd), ("atr", scans.atr)):
    on_bars(f"{_name}_scan", SQL[_name], _scan)
on_kernel("atr_midrange", recursion(f"{TRM} AS tr", ewm("e", "x", {"y": ("tr", 1 / 14)}), final=joined("e", {"value": "y"}, 14)), recursive.atr(midrange=True), ["value"])
on_kernel("natr", recursion(f"{TR} AS tr", ewm("e", "x", {"y": ("tr", 1 / 14)}), final=joined("e", {"value": "100 * y / nullif(close, 0)"}, 14)), recursive.natr(), ["value"])


def adx_sql(tr: str) -> str:
    up, down = f"(high - {lag('high')})", f"({lag('low')} - low)"
    return recursion(
        f"{tr} AS tr, CASE WHEN {up} > {down} AND {up} > 0 THEN {up} ELSE 0 END AS pdm, CASE WHEN {down} > {up} AND {down} > 0 THEN {down} ELSE 0 END AS mdm",
        ewm("e", "x", {"w": ("tr", 1 / 14), "p": ("pdm", 1 / 14), "m": ("mdm", 1 / 14)}),
        "d AS (SELECT symbol, rn, coalesce(100 * p / nullif(w, 0), 0) AS pdi, coalesce(100 * m / nullif(w, 0), 0) AS mdi FROM e)", "dd AS (SELECT *, coalesce(100 * abs(pdi - mdi) / nullif(pdi + mdi, 0), 0) AS dx FROM d)",
        ewm("a", "dd", {"v": ("dx", 1 / 14)}), "k AS (SELECT * FROM dd JOIN a USING (symbol, rn))", final=joined("k", {"adx": "v", "plus_di": "pdi", "minus_di": "mdi"}, 28),
    )


on_kernel("adx", adx_sql(TR), recursive.adx(), ["adx", "plus_di", "minus_di"])
on_kernel("adx_midrange", adx_sql(TRM), recursive.adx(midrange=True), ["adx", "plus_di", "minus_di"])
on_kernel("ppo", recursion("close AS c", ewm("e", "x", {"f": ("c", 2 / 13), "s": ("c", 2 / 27)}), final=joined("e", {"value": "100 * (f - s) / nullif(s, 0)"}, 26)), recursive.ppo(), ["value"])
on_kernel("trix", recursion("close AS c", ewm("e1", "x", {"y": ("c", 2 / 16)}), ewm("e2", "e1", {"z": ("y", 2 / 16)}), ewm("e3", "e2", {"t": ("z", 2 / 16)}),
          f"k AS (SELECT symbol, rn, t, lag(t) OVER (PARTITION BY symbol ORDER BY rn) AS q FROM e3)", final=joined("k", {"value": "100 * (t - q) / nullif(q, 0)"}, 15)), recursive.trix(), ["value"])
on_kernel("adosc", recursion(f"sum(coalesce((2 * close - low - high) / nullif(high - low, 0), 0) * volume) OVER {frame('UNBOUNDED PRECEDING')} AS c", ewm("e", "x", {"f": ("c", 2 / 4), "s": ("c", 2 / 11)}),
          final=joined("e", {"value": "f - s"}, 10)), recursive.adosc(), ["value"])
on_kernel("sar", f"""WITH RECURSIVE {bars_sql()}, x AS (SELECT *, row_number() OVER {W} AS rn, lag(high) OVER {W} AS h1, lag(low) OVER {W} AS l1,
    coalesce(lag(high, 2) OVER {W}, lag(high) OVER {W}) AS h2, coalesce(lag(low, 2) OVER {W}, lag(low) OVER {W}) AS l2 FROM bars),
  z AS (SELECT symbol, rn, true AS up, low AS stop, high AS top, 0.02::DOUBLE AS speed FROM x WHERE rn = 1
  UNION ALL SELECT symbol, rn, up <> flip, CASE WHEN flip THEN top ELSE s END, CASE WHEN flip THEN CASE WHEN up THEN low ELSE high END WHEN up THEN greatest(high, top) ELSE least(low, top) END,
    CASE WHEN flip THEN 0.02::DOUBLE WHEN CASE WHEN up THEN high > top ELSE low < top END THEN least(0.2::DOUBLE, speed + 0.02::DOUBLE) ELSE speed END
  FROM (SELECT *, CASE WHEN up THEN low < s ELSE high > s END AS flip FROM (
    SELECT x.symbol, x.rn, x.high, x.low, z.up, z.top, z.speed, CASE WHEN z.up THEN least(z.stop + z.speed * (z.top - z.stop), l1, l2) ELSE greatest(z.stop + z.speed * (z.top - z.stop), h1, h2) END AS s
    FROM z JOIN x ON x.symbol = z.symbol AND x.rn = z.rn + 1)))
""" + joined("(SELECT symbol, rn, stop FROM z)", {"value": "stop"}, 1), recursive.sar(), ["value"])
GAINS = f"coalesce(greatest({DIFF}, 0), 0) AS g, coalesce(greatest(-({DIFF}), 0), 0) AS l"
on_kernel("stochrsi", recursion(
    GAINS, ewm("e", "x", {"ag": ("g", 1 / 14), "al": ("l", 1 / 14)}),
    "q AS (SELECT symbol, ts, rn, CASE WHEN al = 0 THEN 100.0 ELSE 100 - 100 / (1 + ag / al) END AS v FROM x JOIN e USING (symbol, rn))",
    f"k AS (SELECT symbol, ts, rn, 100 * (v - {roll('min', 'v', 14)}) / nullif({roll('max', 'v', 14)} - {roll('min', 'v', 14)}, 0) AS k FROM q)",
    f"m AS (SELECT symbol, ts, rn, {roll('avg', 'k', 3)} AS stoch_k FROM k)",
    final=values(f"(SELECT symbol, ts, rn, stoch_k, {roll('avg', 'stoch_k', 3)} AS stoch_d FROM m)", {"stoch_k": "stoch_k", "stoch_d": "stoch_d"}),
), recursive.stochrsi(), ["stoch_k", "stoch_d"])

MIX = {
    "sma": ("sma", {"period": 20}), "ema": ("ema", {"timeperiod": 20}), "mid": ("midpoint", {}), "midprice": ("midprice", {}), "trima": ("trima", {"period": 9}), "line": ("linearreg", {}), "next": ("tsf", {}),
    "start": ("linearreg_intercept", {}), "angle": ("linearreg_angle", {}), "var": ("var", {"period": 10}), "sum": ("sum", {"period": 7}), "mm": ("minmax", {"period": 12}), "ratio": ("rocr100", {"period": 3}),
    "ago": ("minindex", {"period": 12}), "apo": ("apo", {"fast": 26, "slow": 12}), "cmo": ("cmo", {}), "dema": ("dema", {"period": 30}), "doji": ("cdldoji", {}), "typ": ("typprice", {}), "range": ("trailing_range_vol", {"lookback": 5}),
}
RNF = "CAST(rn AS DOUBLE)"
SLOPE, AT0 = pair("regr_slope", "close", RNF, 14), pair("regr_intercept", "close", RNF, 14)


def from_row(n: int, x: str, name: str) -> str:
    return r(f"CASE WHEN rn > {n} THEN {x} END", name)


@query("indicator_mix", recursion(
    "close AS c, " + GAINS, ewm("e", "x", {"y": ("c", 2 / 21), "f": ("c", 2 / 13), "s": ("c", 2 / 27), "d": ("c", 2 / 31), "ag": ("g", 1 / 14), "al": ("l", 1 / 14)}), ewm("e2", "e", {"dd": ("d", 2 / 31)}),
    f"t AS (SELECT x.*, e.* EXCLUDE (symbol, rn), e2.dd FROM x JOIN e USING (symbol, rn) JOIN e2 USING (symbol, rn)), u AS (SELECT *, {roll('avg', 'close', 5)} AS half, {SLOPE} AS b, {AT0} AS a FROM t)",
    final=f"""SELECT symbol, ts, {r(roll('avg', 'close', 20), 'sma')}, {from_row(20, 'y', 'ema')}, {r(f"({roll('max', 'close', 14)} + {roll('min', 'close', 14)}) / 2", 'mid')}, {r(f"({roll('max', 'high', 14)} + {roll('min', 'low', 14)}) / 2", 'midprice')},
      {r(roll('avg', 'half', 5), 'trima')}, {r('a + b * rn', 'line')}, {r('a + b * (rn + 1)', 'next')}, {r('a + b * (rn - 13)', 'start')}, {r('degrees(atan(b))', 'angle')}, {r(roll('var_pop', 'close', 10), 'var')}, {r(roll('sum', 'close', 7), 'sum')},
      {r(roll('min', 'close', 12), 'mm_min')}, {r(roll('max', 'close', 12), 'mm_max')}, {r(f"100 * close / nullif({lag('close', 3)}, 0)", 'ratio')}, CAST({ago('close', 12, '-')} AS INTEGER) AS ago,
      {from_row(26, 'f - s', 'apo')}, {from_row(14, 'coalesce(100 * (ag - al) / nullif(ag + al, 0), 0)', 'cmo')}, {from_row(59, '2 * d - dd', 'dema')},
      {CANDLES['doji']} AS doji, {r('(high + low + close) / 3', 'typ')}, {r(roll('avg', '(high - low)', 5), 'range')} FROM u""",
))
def indicator_mix(spark, sf_dir):  # noqa: ANN001, ANN201
    """Twenty indicators by name, bounded and recursive ones together, one of them with fast and slow the wrong way round."""
    return rounded(compute_indicators(market.bars(spark, sf_dir), MIX))


on_bars("zigzag", f"""WITH RECURSIVE {bars_sql()}, x AS (SELECT symbol, ts, close AS p, row_number() OVER {W} AS rn FROM bars),
z AS (SELECT symbol, rn, 0 AS way, p AS lp, ts AS lt, CAST(NULL AS VARCHAR) AS dir, CAST(NULL AS DOUBLE) AS ep, CAST(NULL AS TIMESTAMP) AS et FROM x WHERE rn = 1
  UNION ALL SELECT x.symbol, x.rn,
    CASE WHEN way = 0 THEN CASE WHEN (p - lp) / lp >= 0.01 THEN 1 WHEN (p - lp) / lp <= -0.01 THEN -1 ELSE 0 END
         WHEN way = 1 AND NOT p > lp AND (p - lp) / lp <= -0.01 THEN -1 WHEN way = -1 AND NOT p < lp AND (p - lp) / lp >= 0.01 THEN 1 ELSE way END,
    CASE WHEN (way = 0 AND abs((p - lp) / lp) >= 0.01) OR (way = 1 AND (p > lp OR (p - lp) / lp <= -0.01)) OR (way = -1 AND (p < lp OR (p - lp) / lp >= 0.01)) THEN p ELSE lp END,
    CASE WHEN (way = 0 AND abs((p - lp) / lp) >= 0.01) OR (way = 1 AND (p > lp OR (p - lp) / lp <= -0.01)) OR (way = -1 AND (p < lp OR (p - lp) / lp >= 0.01)) THEN x.ts ELSE lt END,
    CASE WHEN way = 1 AND NOT p > lp AND (p - lp) / lp <= -0.01 THEN 'short' WHEN way = -1 AND NOT p < lp AND (p - lp) / lp >= 0.01 THEN 'long' END, lp, lt
  FROM z JOIN x ON x.symbol = z.symbol AND x.rn = z.rn + 1)
SELECT symbol, et AS ts, dir AS direction, CASE dir WHEN 'short' THEN 'high' ELSE 'low' END AS pivot, ep AS price FROM z WHERE dir IS NOT NULL""", recursive.zigzag)
