"""Exponential means over series of any length, as a parallel scan.

A step of an exponential mean is an affine map of the one before it, and maps of consecutive rows compose to one of the same
kind. Rows are dealt by ranges of symbol and time, whatever the symbols' lengths; every task walks its rows once and leaves,
where it does not know what came before, a value and the factor of what it does not know. Each task's last map goes to the
driver, one row a task, where the carries are chained; a projection then adds them. So a single symbol takes as many tasks as
its rows ask for, where recursive indicators take one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlume.operators.recursive import span
from barlume.plans.spec import BARS, BarSpec, require
from barlume.plans.staging import staged


def placed(df: DataFrame, spec: BarSpec = BARS, parts: int | None = None) -> DataFrame:
    """df, staged, in ranges of symbol and time, sorted, with the number of its range as __part."""
    by = [spec.symbol, spec.ts]
    df = df.repartitionByRange(*([parts] if parts else []), *by).sortWithinPartitions(*by)
    return staged(df.withColumn("__part", F.spark_partition_id()))


def walk(x: np.ndarray, alpha: float, start: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(value, factor) of each place: the mean is value + factor * what came before, or value where start is known (NaN: nothing came before).

    Missing values leave the mean as it is.
    """
    there = ~np.isnan(x)
    own, count = x[there], np.cumsum(there)
    if start is not None and np.isnan(start):
        y = pd.Series(own).ewm(alpha=alpha, adjust=False).mean().to_numpy()
        return np.append(np.nan, y)[count], np.zeros(len(x))
    y = pd.Series(np.append(0.0 if start is None else start, own)).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    return y[count], np.zeros(len(x)) if start is not None else (1 - alpha) ** count


def scanned(rows: DataFrame, means: dict[str, tuple[str, float]], spec: BarSpec = BARS, previous: dict[str, str] | None = None) -> DataFrame:
    """Placed rows with __row (the row's number in its symbol, from 1), the means (column, alpha) by name, and the previous rows' values of columns by name.

    A mean starts with a symbol's first value; missing values leave it as it is, and it is null before the first one.
    """
    previous = previous or {}
    columns = list(dict.fromkeys([c for c, _ in means.values()] + list(previous.values())))
    number = {c: f"__c{i}" for i, c in enumerate(columns)}
    work = rows.withColumns({number[c]: F.col(c).cast("double") for c in columns})
    extra = [*(f"__{k}{i}" for i in range(len(means)) for k in ("y", "a")), *(f"__p{i}" for i in range(len(previous)))]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in work.dtypes), "__first boolean, __n bigint", *(f"{c} double" for c in extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, first, n, state, last = None, True, 0, {}, {}
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(spec.symbol).to_pandas()
            x = {c: b.column(number[c]).to_numpy(zero_copy_only=False).astype(float) for c in columns}
            out = {c: np.empty(b.num_rows) for c in extra}
            firsts, numbers = np.empty(b.num_rows, bool), np.empty(b.num_rows, np.int64)
            missing = key.isna()
            new = ((key != key.shift()) & ~(missing & missing.shift(fill_value=False))).to_numpy()
            new[0] = False
            cuts = [0, *np.flatnonzero(new), b.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                own = None if missing.iloc[s] else key.iloc[s]
                if symbol is None or own != symbol[0]:
                    first, n = symbol is None, 0
                    symbol = (own,)
                    state, last = {}, dict.fromkeys(columns, np.nan)
                firsts[s:e], numbers[s:e] = first, n + np.arange(1, e - s + 1)
                n += e - s
                for i, (c, alpha) in enumerate(means.values()):
                    y, a = walk(x[c][s:e], alpha, None if first else state.get(i, (np.nan, 0))[0])
                    if first and i in state:  # the range's first symbol goes on from the batch before
                        a0 = state[i][1]
                        y, a = y + a * state[i][0], a * a0
                    out[f"__y{i}"][s:e], out[f"__a{i}"][s:e] = y, a
                    state[i] = (y[-1], a[-1])
                for i, c in enumerate(previous.values()):
                    out[f"__p{i}"][s:e] = np.append(last[c], x[c][s : e - 1])
                last = {c: x[c][e - 1] for c in columns}
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(firsts), pa.array(numbers), *(pa.array(v, from_pandas=True) for v in out.values())], [*b.schema.names, "__first", "__n", *out])

    local = work.mapInArrow(run, schema)
    ends = F.struct(spec.symbol, "__first", "__n", *extra, *number.values())
    ranges = local.groupBy("__part").agg(
        F.max_by(ends, F.struct(spec.symbol, spec.ts)).alias("last"), F.max_by(ends, F.when(F.col("__first"), F.col(spec.ts))).alias("head"),
        *[F.min_by(number[c], F.when(F.col("__first") & F.col(number[c]).isNotNull() & ~F.isnan(number[c]), F.col(spec.ts))).alias(f"start{i}") for i, (c, _) in enumerate(means.values())],
    ).orderBy("__part").collect()

    def joined(r, i: int, carry: float | None) -> float | None:  # noqa: ANN001
        """The mean at the end of a run of rows whose value and factor are r's."""
        y, a = r[f"__y{i}"], r[f"__a{i}"]
        return y if not a else None if carry is None else (y or 0.0) + a * carry

    carries, before = [], None
    for r in ranges:
        head, last = r["head"], r["last"]
        goes_on = before is not None and before["symbol"] == head[spec.symbol]
        past = [before["means"][i] if goes_on else None for i in range(len(means))]
        mine = [r[f"start{i}"] if p is None else p for i, p in enumerate(past)]
        carries.append((r["__part"], before["n"] if goes_on else 0, *mine, *(p is None for p in past), *(before["last"][c] if goes_on else None for c in previous.values())))
        n = last["__n"] + (carries[-1][1] if last["__first"] else 0)
        before = {"symbol": last[spec.symbol], "n": n, "means": [joined(last, i, mine[i]) for i in range(len(means))], "last": {c: last[number[c]] for c in columns}}
    names = ["__part", "__before", *(f"__m{i}" for i in range(len(means))), *(f"__o{i}" for i in range(len(means))), *(f"__l{i}" for i in range(len(previous)))]
    kinds = ["int", "bigint", *["double"] * len(means), *["boolean"] * len(means), *["double"] * len(previous)]
    small = rows.sparkSession.createDataFrame(carries, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    out = local.join(F.broadcast(small), "__part")  # a row a range
    clean = lambda c: F.when(~F.isnan(c), c)
    columns_out = {"__row": F.col("__n") + F.when(F.col("__first"), F.col("__before")).otherwise(0)}
    for i, m in enumerate(means):
        none_yet = F.col(f"__o{i}") & (F.col(f"__a{i}") == 1)  # a factor of 1: no value so far, here or before
        columns_out[m] = clean(F.when(F.col(f"__a{i}") == 0, F.col(f"__y{i}")).when(~none_yet, F.col(f"__y{i}") + F.col(f"__a{i}") * F.col(f"__m{i}")))
    for i, p in enumerate(previous):
        columns_out[p] = clean(F.when(F.col("__first") & (F.col("__n") == 1), F.col(f"__l{i}")).otherwise(F.col(f"__p{i}")))
    return out.withColumns(columns_out).select(*rows.columns, *columns_out)


def finished(df: DataFrame, warm_up: int, outputs: list[str], spec: BarSpec) -> DataFrame:
    return df.filter(F.col("__row") > warm_up).select(spec.symbol, spec.ts, *outputs).dropna(subset=outputs)


def ema(df: DataFrame, period: int = 20, column: str = "close", spec: BarSpec = BARS, parts: int | None = None) -> DataFrame:
    """recursive.ema() over symbols of any length."""
    require(df, column)
    rows = placed(df.select(spec.symbol, spec.ts, column), spec, parts)
    return finished(scanned(rows, {"value": (column, span(period))}, spec), period, ["value"], spec)


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, spec: BarSpec = BARS, parts: int | None = None) -> DataFrame:
    """recursive.macd() over symbols of any length: two scans over rows that are dealt once."""
    require(df, "close")
    rows = placed(df.select(spec.symbol, spec.ts, "close"), spec, parts)
    both = scanned(rows, {"__f": ("close", span(fast)), "__s": ("close", span(slow))}, spec).withColumn("macd", F.col("__f") - F.col("__s"))
    both = staged(both.select(spec.symbol, spec.ts, "__part", "macd"))
    out = scanned(both, {"signal": ("macd", span(signal))}, spec).withColumn("histogram", F.col("macd") - F.col("signal"))
    return finished(out, slow, ["macd", "signal", "histogram"], spec)


def rsi(df: DataFrame, period: int = 14, spec: BarSpec = BARS, parts: int | None = None) -> DataFrame:
    """recursive.rsi() over symbols of any length."""
    require(df, "close")
    rows = placed(df.select(spec.symbol, spec.ts, "close"), spec, parts)
    moves = scanned(rows, {}, spec, {"__last": "close"}).withColumn("__d", F.col("close") - F.coalesce("__last", "close"))
    moves = staged(moves.select(spec.symbol, spec.ts, "__part", F.greatest("__d", F.lit(0.0)).alias("up"), F.greatest(-F.col("__d"), F.lit(0.0)).alias("down")))
    out = scanned(moves, {"__g": ("up", 1 / period), "__b": ("down", 1 / period)}, spec)
    out = out.withColumn("value", F.when(F.col("__b") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide("__g", "__b"))))
    return finished(out, period, ["value"], spec)


def atr(df: DataFrame, period: int = 14, spec: BarSpec = BARS, parts: int | None = None) -> DataFrame:
    """recursive.atr() over symbols of any length."""
    require(df, "high", "low", "close")
    rows = placed(df.select(spec.symbol, spec.ts, "high", "low", "close"), spec, parts)
    wide = scanned(rows, {}, spec, {"__last": "close"}).withColumn("__w", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("__last")), F.abs(F.col("low") - F.col("__last"))))
    out = scanned(staged(wide.select(spec.symbol, spec.ts, "__part", "__w")), {"value": ("__w", 1 / period)}, spec)
    return finished(out, period, ["value"], spec)
