"""Indicators by name, with their parameters and outputs."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlume.operators import recursive, windowed
from barlume.plans.spec import BARS, BarSpec, require


#: Other names under which parameters are known.
ALIASES = {
    "timeperiod": "period", "length": "period", "window": "period", "n": "period", "fastperiod": "fast", "fast_period": "fast", "slowperiod": "slow", "slow_period": "slow", "signalperiod": "signal",
    "signal_period": "signal", "nbdev": "deviations", "nbdevup": "std_dev", "fastk_period": "k_period", "fastd_period": "d_period", "slowk_period": "smooth_k", "slowd_period": "d_period", "acceleration": "step", "maximum": "most",
}


@dataclass(frozen=True)
class Indicator:
    """A named indicator. function (df, parameters, spec) gives its table; kernel, if there is one, makes its pass over a symbol's rows."""

    name: str
    function: Callable[..., DataFrame]
    outputs: list[str]
    parameters: dict = field(default_factory=dict)
    category: str = "other"
    inputs: tuple[str, ...] = ("close",)
    kernel: Callable[..., recursive.Kernel] | None = None

    def resolve(self, params: dict) -> dict:
        """All parameters: given ones under their own or another name, else defaults. fast and slow that are the wrong way round are swapped; ValueError for what the indicator does not know or a period below 1."""
        known = {}
        for k, v in params.items():
            k = k if k in self.parameters else ALIASES.get(k.lower(), k)
            if k not in self.parameters:
                raise ValueError(f"{self.name} has no parameter {k}")
            if ("period" in k and isinstance(v, int | float) or k in ("fast", "slow", "signal", "lookback")) and v < 1:
                raise ValueError(f"{self.name}: {k} is below 1")
            known[k] = v
        out = {**self.parameters, **known}
        if "fast" in out and "slow" in out and out["fast"] > out["slow"]:
            out["fast"], out["slow"] = out["slow"], out["fast"]
        return out

    def __call__(self, df: DataFrame, spec: BarSpec = BARS, inputs: dict[str, str] | None = None, **params) -> DataFrame:
        """The indicator's table. inputs names other columns of df to take for its own, such as close: midrange."""
        return self.function(mapped(df, inputs), **self.resolve(params), spec=spec)

    def metadata(self) -> dict:
        return {"name": self.name, "category": self.category, "inputs": list(self.inputs), "outputs": list(self.outputs), "parameters": dict(self.parameters), "recursive": self.kernel is not None}


def mapped(df: DataFrame, inputs: dict[str, str] | None) -> DataFrame:
    """df with other columns in the place of the named ones; ValueError if one is missing."""
    if not inputs:
        return df
    require(df, *inputs.values())
    return df.withColumns({k: F.col(v) for k, v in inputs.items()})


_known: dict[str, Indicator] = {}


def register(name: str, function: Callable[..., DataFrame], outputs: list[str] | None = None, category: str = "other", inputs: tuple[str, ...] = ("close",), kernel: Callable | None = None) -> None:
    """Adds an indicator: a function (df, parameters with defaults, spec) -> DataFrame."""
    parameters = {p.name: p.default for p in inspect.signature(kernel or function).parameters.values() if p.name not in ("df", "spec") and p.default is not p.empty}
    _known[name.lower()] = Indicator(name.lower(), function, outputs or ["value"], parameters, category, inputs, kernel)


def register_kernel(name: str, make: Callable[..., recursive.Kernel], outputs: list[str] | None = None, category: str = "trend", inputs: tuple[str, ...] = ("high", "low", "close")) -> None:
    """Adds an indicator that passes over all rows of a symbol."""
    outputs = outputs or ["value"]

    def f(df: DataFrame, spec: BarSpec = BARS, **params) -> DataFrame:
        return recursive.indicator(df, make(**params), outputs, spec)

    register(name, f, outputs, category, inputs, make)


def _one(f: Callable[..., DataFrame], output: str) -> Callable[..., DataFrame]:
    """One output of an indicator as value."""

    def g(df: DataFrame, spec: BarSpec = BARS, **params) -> DataFrame:
        out = f(df, **params, spec=spec)
        return out.withColumn("value", F.col(output)) if spec.keep else out.select(spec.symbol, spec.ts, F.col(output).alias("value"))

    g.__signature__ = inspect.signature(f)
    return g


HL, HLC, OHLC, CV, HLCV = ("high", "low"), ("high", "low", "close"), ("open", "high", "low", "close"), ("close", "volume"), ("high", "low", "close", "volume")
for _n in ("sma", "wma", "hma", "trima"):
    register(_n, getattr(windowed, _n), category="overlap")
register("midpoint", windowed.midpoint, category="overlap")
register("midprice", windowed.midprice, category="overlap", inputs=HL)
register("bbands", windowed.bbands, ["upper", "middle", "lower"], "overlap")
for _n in ("roc", "mom", "rocp", "rocr"):
    register(_n, getattr(windowed, _n), category="momentum")
register("rocr100", partial(windowed.rocr, factor=100.0), category="momentum")
for _n in ("willr", "cci", "ultosc"):
    register(_n, getattr(windowed, _n), category="momentum", inputs=HLC)
register("mfi", windowed.mfi, category="momentum", inputs=HLCV)
register("bop", windowed.bop, category="momentum", inputs=OHLC)
register("aroon", windowed.aroon, ["aroon_up", "aroon_down"], "momentum", HL)
for _n in ("stochastic", "stochslow"):
    register(_n, windowed.stochastic, ["stoch_k", "stoch_d"], "momentum", HLC)
register("stochastic_midrange", windowed.stochastic_midrange, ["stoch_k", "stoch_d"], "momentum", HL)
register("stochf", windowed.stoch_fast, ["fast_k", "fast_d"], "momentum", HLC)
register("obv", windowed.obv, category="volume", inputs=CV)
register("ad", windowed.ad, category="volume", inputs=HLCV)
for _n in ("abnormal_turnover", "normalized_volume"):
    register(_n, getattr(windowed, _n), category="volume", inputs=("volume",))
register("trange", windowed.trange, category="volatility", inputs=HLC)
for _n in ("roll_extreme_midrange", "roll_mean_midrange", "trailing_range_vol"):
    register(_n, getattr(windowed, _n), category="volatility", inputs=HL)
for _n in ("beta", "correl"):
    register(_n, getattr(windowed, _n), category="statistic", inputs=("high", "close"))
for _n in ("autocorr", "linearreg_slope", "stddev"):
    register(_n, getattr(windowed, _n), category="statistic")
register("var", windowed.variance, category="statistic")
register("sum", windowed.rolling_sum, category="math")
for _n, _o in (("linearreg", "value"), ("tsf", "forecast"), ("linearreg_intercept", "intercept"), ("linearreg_angle", "angle")):
    register(_n, _one(windowed.linear_regression, _o), category="statistic")
for _n, _top in (("min", False), ("max", True)):
    register(_n, windowed.extreme(_top), category="math")
    register(f"{_n}index", windowed.extreme_index(_top), category="math")
register("minmax", windowed.min_max, ["min", "max"], "math")
register("minmaxindex", windowed.min_max_index, ["min", "max", "min_ago", "max_ago"], "math")
for _n in ("medprice", "typprice", "wclprice", "avgprice"):
    register(_n, _one(windowed.price_transforms, _n), category="price", inputs=OHLC)
for _n in ("doji", "hammer", "engulfing"):
    register(f"cdl{_n}", partial(windowed.candle, pattern=_n), category="pattern", inputs=OHLC)
for _n in ("ema", "kama"):
    register_kernel(_n, getattr(recursive, _n), category="overlap", inputs=("close",))
register_kernel("dema", recursive.stacked(2), category="overlap", inputs=("close",))
register_kernel("tema", recursive.stacked(3), category="overlap", inputs=("close",))
register("mavp", windowed.mavp, category="overlap", inputs=("close", "periods"))
register_kernel("sar", recursive.sar, category="overlap", inputs=HL)
register_kernel("sarext", recursive.sarext, category="overlap", inputs=HL)
register_kernel("macdext", recursive.macdext, ["macd", "signal", "histogram"], "momentum", ("close",))
for _n in ("rsi", "ppo", "trix", "apo", "cmo"):
    register_kernel(_n, getattr(recursive, _n), category="momentum", inputs=("close",))
register_kernel("macd", recursive.macd, ["macd", "signal", "histogram"], "momentum", ("close",))
register_kernel("stochrsi", recursive.stochrsi, ["stoch_k", "stoch_d"], "momentum", ("close",))
register_kernel("adx", recursive.adx, ["adx", "plus_di", "minus_di"], "momentum")
register_kernel("adx_midrange", partial(recursive.adx, midrange=True), ["adx", "plus_di", "minus_di"], "momentum", HL)
for _i, _n in enumerate(("plus_di", "minus_di", "dx")):
    register_kernel(_n, recursive.direction(_i), category="momentum")
for _n in ("atr", "natr"):
    register_kernel(_n, getattr(recursive, _n), category="volatility")
register_kernel("atr_midrange", partial(recursive.atr, midrange=True), category="volatility", inputs=HL)
register_kernel("adosc", recursive.adosc, category="volume", inputs=HLCV)


def get(name: str) -> Indicator:
    """By name, whatever its case; ValueError for an unknown one."""
    if name.lower() not in _known:
        raise ValueError(f"unknown indicator {name}")
    return _known[name.lower()]


def names(category: str | None = None, inputs: tuple[str, ...] | None = None) -> list[str]:
    """All names, or those of a category, or those that take no other inputs than the given ones."""
    return sorted(n for n, i in _known.items() if category in (None, i.category) and (inputs is None or set(i.inputs) <= set(inputs)))
