"""Indicators that depend on all earlier bars: exponential means and state machines, one pass over each symbol's rows.

Several indicators of one batch share the pass, so a table is shuffled and sorted once for all of them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from barlume.plans.spec import BARS, BarSpec, require

Kernel = Callable[[pd.DataFrame], tuple[int, dict[str, np.ndarray]]]


def mean(x: np.ndarray, alpha: float) -> np.ndarray:
    """y[t] = alpha x[t] + (1 - alpha) y[t - 1], from x[0]."""
    return pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy()


def span(n: int) -> float:
    return 2 / (n + 1)


def ranges(b: pd.DataFrame, previous: np.ndarray) -> np.ndarray:
    h, lo = b["high"].to_numpy(), b["low"].to_numpy()
    p = np.concatenate([[np.nan], previous[:-1]])
    return np.fmax(h - lo, np.fmax(np.abs(h - p), np.abs(lo - p)))


def divided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0)


def ema(period: int = 20, column: str = "close") -> Kernel:
    return lambda b: (period, {"value": mean(b[column].to_numpy(), span(period))})


def rsi_values(x: np.ndarray, period: int) -> np.ndarray:
    d = np.diff(x, prepend=x[0])
    gain, loss = mean(np.maximum(d, 0), 1 / period), mean(np.maximum(-d, 0), 1 / period)
    return np.where(loss == 0, 100.0, 100 - 100 / (1 + np.divide(gain, loss, out=np.zeros(len(x)), where=loss != 0)))


def rsi(period: int = 14) -> Kernel:
    return lambda b: (period, {"value": rsi_values(b["close"].to_numpy(), period)})


def macd(fast: int = 12, slow: int = 26, signal: int = 9) -> Kernel:
    def f(b: pd.DataFrame) -> tuple[int, dict[str, np.ndarray]]:
        c = b["close"].to_numpy()
        m = mean(c, span(fast)) - mean(c, span(slow))
        s = mean(m, span(signal))
        return slow, {"macd": m, "signal": s, "histogram": m - s}

    return f


def middle(b: pd.DataFrame) -> np.ndarray:
    return ((b["high"] + b["low"]) / 2).to_numpy()


def atr(period: int = 14, midrange: bool = False) -> Kernel:
    return lambda b: (period, {"value": mean(ranges(b, middle(b) if midrange else b["close"].to_numpy()), 1 / period)})


def natr(period: int = 14) -> Kernel:
    return lambda b: (period, {"value": divided(100 * atr(period)(b)[1]["value"], b["close"].to_numpy())})


def directions(b: pd.DataFrame, period: int, midrange: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """+DI, -DI and DX."""
    up, down = np.diff(b["high"].to_numpy(), prepend=np.nan), -np.diff(b["low"].to_numpy(), prepend=np.nan)
    plus = np.where((up > down) & (up > 0), up, 0.0)
    minus = np.where((down > up) & (down > 0), down, 0.0)
    width = mean(ranges(b, middle(b) if midrange else b["close"].to_numpy()), 1 / period)
    p = np.nan_to_num(divided(100 * mean(plus, 1 / period), width))
    m = np.nan_to_num(divided(100 * mean(minus, 1 / period), width))
    return p, m, np.nan_to_num(divided(100 * np.abs(p - m), p + m))


def adx(period: int = 14, midrange: bool = False) -> Kernel:
    def f(b: pd.DataFrame) -> tuple[int, dict[str, np.ndarray]]:
        p, m, dx = directions(b, period, midrange)
        return 2 * period, {"adx": mean(dx, 1 / period), "plus_di": p, "minus_di": m}

    return f


def direction(which: int) -> Callable[..., Kernel]:
    """One of +DI, -DI and DX alone."""

    def make(period: int = 14, midrange: bool = False) -> Kernel:
        return lambda b: (period, {"value": directions(b, period, midrange)[which]})

    return make


def stacked(order: int) -> Callable[..., Kernel]:
    """The exponential mean less its lag, from as many means of means: two for dema, three for tema."""

    def make(period: int = 30, column: str = "close") -> Kernel:
        def f(b: pd.DataFrame) -> tuple[int, dict[str, np.ndarray]]:
            e = [mean(b[column].to_numpy(), span(period))]
            for _ in range(order - 1):
                e.append(mean(e[-1], span(period)))
            return order * (period - 1) + 1, {"value": 2 * e[0] - e[1] if order == 2 else 3 * e[0] - 3 * e[1] + e[2]}

        return f

    return make


def kama(period: int = 30, fast: int = 2, slow: int = 30, column: str = "close") -> Kernel:
    """An exponential mean that is as fast as the last move was straight."""

    def f(b: pd.DataFrame) -> tuple[int, dict[str, np.ndarray]]:
        x = b[column].to_numpy()
        out = np.full(len(x), np.nan)
        if len(x) <= period:
            return period, {"value": out}
        path = pd.Series(np.abs(np.diff(x, prepend=x[0]))).rolling(period).sum().to_numpy()
        way = np.abs(x - np.concatenate([np.full(period, np.nan), x[:-period]]))
        speed = (np.where(path > 0, way / np.where(path > 0, path, 1), 0.0) * (span(fast) - span(slow)) + span(slow)) ** 2
        out[period - 1] = x[period - 1]
        for i in range(period, len(x)):
            out[i] = out[i - 1] + speed[i] * (x[i] - out[i - 1])
        return period, {"value": out}

    return f


def apo(fast: int = 12, slow: int = 26) -> Kernel:
    def f(b: pd.DataFrame) -> tuple[int, dict[str, np.ndarray]]:
        c = b["close"].to_numpy()
        return slow, {"value": mean(c, span(fast)) - mean(c, span(slow))}

    return f


def cmo(period: int = 14) -> Kernel:
    """Gains less losses over both, by Wilder's means."""

    def f(b: pd.DataFrame) -> tuple[int, dict[str, np.ndarray]]:
        c = b["close"].to_numpy()
        d = np.diff(c, prepend=c[0])
        gain, loss = mean(np.maximum(d, 0), 1 / period), mean(np.maximum(-d, 0), 1 / period)
        return period, {"value": np.nan_to_num(divided(100 * (gain - loss), gain + loss))}

    return f


def ppo(fast: int = 12, slow: int = 26) -> Kernel:
    def f(b: pd.DataFrame) -> tuple[int, dict[str, np.ndarray]]:
        c = b["close"].to_numpy()
        s = mean(c, span(slow))
        return slow, {"value": divided(100 * (mean(c, span(fast)) - s), s)}

    return f


def trix(period: int = 15) -> Kernel:
    def f(b: pd.DataFrame) -> tuple[int, dict[str, np.ndarray]]:
        t = b["close"].to_numpy()
        for _ in range(3):
            t = mean(t, span(period))
        p = np.concatenate([[np.nan], t[:-1]])
        return period, {"value": 100 * divided(t - p, p)}

    return f


def adosc(fast: int = 3, slow: int = 10) -> Kernel:
    def f(b: pd.DataFrame) -> tuple[int, dict[str, np.ndarray]]:
        h, lo, c = (b[x].to_numpy() for x in ("high", "low", "close"))
        line = np.cumsum(np.nan_to_num(divided(2 * c - lo - h, h - lo)) * b["volume"].to_numpy())
        return slow, {"value": mean(line, span(fast)) - mean(line, span(slow))}

    return f


def stochrsi(period: int = 14, k_period: int = 14, d_period: int = 3, smooth_k: int = 3) -> Kernel:
    def f(b: pd.DataFrame) -> tuple[int, dict[str, np.ndarray]]:
        x = pd.Series(rsi_values(b["close"].to_numpy(), period))
        top, bottom = x.rolling(k_period).max(), x.rolling(k_period).min()
        k = pd.Series(divided(100 * (x - bottom).to_numpy(), (top - bottom).to_numpy())).rolling(smooth_k).mean()
        return period, {"stoch_k": k.to_numpy(), "stoch_d": k.rolling(d_period).mean().to_numpy()}

    return f


def sar(step: float = 0.02, most: float = 0.2) -> Kernel:
    """Parabolic stop and reverse, rising first; the stop never enters the ranges of the two bars before."""

    def f(b: pd.DataFrame) -> tuple[int, dict[str, np.ndarray]]:
        h, lo = b["high"].to_numpy(), b["low"].to_numpy()
        out = np.full(len(b), np.nan)
        if len(b) < 2:
            return 1, {"value": out}
        rising, stop, extreme, speed = True, lo[0], h[0], step
        for i in range(1, len(b)):
            stop += speed * (extreme - stop)
            if rising:
                stop = min(stop, lo[i - 1], lo[max(0, i - 2)])
            else:
                stop = max(stop, h[i - 1], h[max(0, i - 2)])
            if (lo[i] < stop) if rising else (h[i] > stop):
                rising, stop, extreme, speed = not rising, extreme, lo[i] if rising else h[i], step
            elif (h[i] > extreme) if rising else (lo[i] < extreme):
                extreme, speed = (h[i] if rising else lo[i]), min(most, speed + step)
            out[i] = stop
        return 1, {"value": out}

    return f


def sarext(start: float = 0.0, offset: float = 0.0, first_long: float = 0.02, step_long: float = 0.02, most_long: float = 0.2, first_short: float = 0.02, step_short: float = 0.02, most_short: float = 0.2) -> Kernel:
    """Parabolic stop and reverse with a speed of its own for each side; negative while short.

    A start above 0 is a first stop below the price, one below 0 a first stop above it; 0 lets the first two bars decide,
    short if the lows fell by more than the highs rose. At a reversal the stop is moved off by the share offset.
    """

    def f(b: pd.DataFrame) -> tuple[int, dict[str, np.ndarray]]:
        h, lo = b["high"].to_numpy(), b["low"].to_numpy()
        out = np.full(len(b), np.nan)
        if len(b) < 2:
            return 1, {"value": out}
        fell, rose = max(lo[0] - lo[1], 0.0), max(h[1] - h[0], 0.0)
        rising = start > 0 or (start == 0 and not fell > rose)
        stop = abs(start) if start else (lo[0] if rising else h[0])
        extreme, speed = (h[0], first_long) if rising else (lo[0], first_short)
        for i in range(1, len(b)):
            if i > 1 or not start:
                stop += speed * (extreme - stop)
                near = (lo if rising else h)[max(0, i - 2) : i]
                stop = min(stop, near.min()) if rising else max(stop, near.max())
            if (lo[i] < stop) if rising else (h[i] > stop):
                rising = not rising
                stop = extreme * (1 - offset) if rising else extreme * (1 + offset)
                extreme, speed = (h[i], first_long) if rising else (lo[i], first_short)
            elif (h[i] > extreme) if rising else (lo[i] < extreme):
                extreme = h[i] if rising else lo[i]
                speed = min(most_long, speed + step_long) if rising else min(most_short, speed + step_short)
            out[i] = stop if rising else -stop
        return 1, {"value": out}

    return f


def weighted_mean(x: np.ndarray, n: int) -> np.ndarray:
    w = np.arange(n, 0, -1) / (n * (n + 1) / 2)
    return np.concatenate([np.full(min(n - 1, len(x)), np.nan), np.convolve(x, w)[n - 1 : len(x)]])


#: Moving averages by name and by the number under which they are also known.
AVERAGES: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {
    "sma": lambda x, n: pd.Series(x).rolling(n).mean().to_numpy(),
    "ema": lambda x, n: mean(x, span(n)),
    "wma": weighted_mean,
    "dema": lambda x, n: 2 * (e := mean(x, span(n))) - mean(e, span(n)),
    "tema": lambda x, n: 3 * (e := mean(x, span(n))) - 3 * (f := mean(e, span(n))) + mean(f, span(n)),
    "trima": lambda x, n: pd.Series(x).rolling((n + 1) // 2).mean().rolling(n // 2 + 1).mean().to_numpy(),
}


def average(kind: str | int) -> Callable[[np.ndarray, int], np.ndarray]:
    """ValueError for an unknown one."""
    name = list(AVERAGES)[kind] if isinstance(kind, int) and 0 <= kind < len(AVERAGES) else kind
    if name not in AVERAGES:
        raise ValueError(f"unknown average {kind}")
    return AVERAGES[name]


def macdext(fast: int = 12, fast_average: str | int = "sma", slow: int = 26, slow_average: str | int = "sma", signal: int = 9, signal_average: str | int = "sma") -> Kernel:
    """macd() with an average of its own for each of its lines."""
    by = average(fast_average), average(slow_average), average(signal_average)

    def f(b: pd.DataFrame) -> tuple[int, dict[str, np.ndarray]]:
        c = b["close"].to_numpy()
        m = by[0](c, fast) - by[1](c, slow)
        begun = int(np.flatnonzero(~np.isnan(m))[0]) if (~np.isnan(m)).any() else len(m)
        s = np.concatenate([m[:begun], by[2](m[begun:], signal)])
        return slow, {"macd": m, "signal": s, "histogram": m - s}

    return f


def compute(df: DataFrame, kernels: dict[str, Kernel], outputs: dict[str, list[str]], spec: BarSpec = BARS, keep: list[str] | None = None) -> DataFrame:
    """(symbol, ts, keep, name or name_output columns): all kernels in one pass over each symbol; a kernel's warm-up is null.

    The columns keep come through as they are.
    """
    keep = keep or []
    names = [n if o == "value" else f"{n}_{o}" for n in kernels for o in outputs[n]]
    types = dict(df.dtypes)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(spec.ts, kind="stable").reset_index(drop=True)
        out = {c: b[c] for c in (spec.symbol, spec.ts, *keep)}
        for n, kernel in kernels.items():
            skipped, values = kernel(b)
            for o in outputs[n]:
                v = np.array(values[o], float)
                v[:skipped] = np.nan
                out[n if o == "value" else f"{n}_{o}"] = pd.Series(v).replace({np.nan: None})
        return pd.DataFrame(out)

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in (spec.symbol, spec.ts, *keep)), *(f"`{n}` double" for n in names)])
    return df.groupBy(spec.symbol).applyInPandas(run, schema)


def indicator(df: DataFrame, kernel: Kernel, outputs: list[str], spec: BarSpec = BARS) -> DataFrame:
    """(symbol, ts, outputs) of one kernel, without its warm-up and rows in which an output is missing."""
    require(df, "high", "low", "close")
    out = compute(df, {"x": kernel}, {"x": outputs}, spec).withColumnsRenamed({"x": "value"} | {f"x_{o}": o for o in outputs if o != "value"})
    return out.dropna(subset=outputs)


def zigzag(df: DataFrame, pct: float = 0.01, price: str = "close", spec: BarSpec = BARS) -> DataFrame:
    """(symbol, ts, direction, pivot, price): the pivots of a zigzag, short at highs and long at lows.

    The first move of pct sets the direction without a pivot; a reversal of pct gives the last extreme as a pivot with its
    own time; the open one at the end is not given.
    """
    types = dict(df.dtypes)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(spec.ts, kind="stable")
        ts, x = b[spec.ts].tolist(), b[price].tolist()
        rows, way, at = [], 0, 0
        for i in range(1, len(x)):
            change = (x[i] - x[at]) / x[at] if x[at] else 0.0
            if way == 0:
                if abs(change) >= pct:
                    way, at = (1 if change > 0 else -1), i
            elif (x[i] > x[at]) if way > 0 else (x[i] < x[at]):
                at = i
            elif (change <= -pct) if way > 0 else (change >= pct):
                rows.append((b[spec.symbol].iloc[0], ts[at], "short" if way > 0 else "long", "high" if way > 0 else "low", x[at]))
                way, at = -way, i
        return pd.DataFrame(rows, columns=[spec.symbol, spec.ts, "direction", "pivot", "price"])

    return df.groupBy(spec.symbol).applyInPandas(run, f"{spec.symbol} {types[spec.symbol]}, {spec.ts} {types[spec.ts]}, direction string, pivot string, price double")
