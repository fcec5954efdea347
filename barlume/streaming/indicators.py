"""Exponential means of a stream, with what they need of the past as state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barlume.operators.recursive import span
from barlume.plans.spec import BARS, BarSpec

EPOCH = pd.Timestamp(0)


def stream_exponential_means(bars: DataFrame, means: dict[str, tuple[str, int]], late: str = "1 hour", spec: BarSpec = BARS) -> DataFrame:
    """(symbol, ts, names of the means) of a stream of bars, in append mode: what recursive.ema() gives for the same rows.

    means has (column, period) by name; a mean is null for the first period rows of a symbol. Rows may come in any order: one
    is final, and given out, once the watermark, late behind the newest row, has passed it; until then it waits in the state.
    Rows that the watermark has passed, and those not after the last row given out, are dropped; of rows of one time the one
    that came first counts. The state is, for a symbol, the means, a counter, the last time and the rows that wait, so it grows
    with late and not with the stream. A stream that ends leaves its last rows waiting.
    """
    columns = list(dict.fromkeys(c for c, _ in means.values()))
    kind = dict(bars.dtypes)[spec.symbol]
    rows = bars.select(spec.symbol, F.col(spec.ts).cast("timestamp").alias(spec.ts), *[F.col(c).cast("double").alias(c) for c in columns]).withWatermark(spec.ts, late)
    schema = f"`{spec.symbol}` {kind}, `{spec.ts}` timestamp, " + ", ".join(f"`{n}` double" for n in means)
    micros = lambda ts: int((pd.Timestamp(ts).tz_localize(None) - EPOCH) // pd.Timedelta(1, "us"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, last, values, waiting = state.get if state.exists else (0, None, json.dumps([None] * len(means)), "{}")
        values, waiting = json.loads(values), {int(k): v for k, v in json.loads(waiting).items()}
        if not state.hasTimedOut:
            for b in frames:
                for ts, *own in b[[spec.ts, *columns]].itertuples(index=False):
                    if last is None or micros(ts) > last:
                        waiting.setdefault(micros(ts), [None if pd.isna(v) else float(v) for v in own])
        passed = state.getCurrentWatermarkMs() * 1000
        ready, out = sorted(t for t in waiting if t <= passed), []
        for t in ready:
            own, count, last = dict(zip(columns, waiting.pop(t), strict=True)), count + 1, t
            for i, (c, period) in enumerate(means.values()):
                if own[c] is not None:
                    alpha = span(period)
                    values[i] = own[c] if values[i] is None else alpha * own[c] + (1 - alpha) * values[i]
            out.append([key[0], EPOCH + pd.Timedelta(t, "us"), *(v if count > p else None for v, (_, p) in zip(values, means.values(), strict=True))])
        state.update((count, last, json.dumps(values), json.dumps(waiting)))
        if waiting:
            state.setTimeoutTimestamp(max(min(waiting) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[spec.symbol, spec.ts, *means])

    return rows.groupBy(spec.symbol).applyInPandasWithState(step, schema, "count bigint, last bigint, means string, waiting string", "append", GroupStateTimeout.EventTimeTimeout)
