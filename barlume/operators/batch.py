"""Many indicators of the registry at once: all bounded ones over one window sort, all recursive ones in one pass after it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlume.operators import recursive, registry
from barlume.plans.spec import BARS, BarSpec


def compute_indicators(df: DataFrame, indicators: dict[str, tuple[str, dict]], spec: BarSpec = BARS, inputs: dict[str, str] | None = None) -> DataFrame:
    """(symbol, ts, one column for each output), every bar kept, null in the warm-up.

    indicators has (registered name, parameters) by the name that its column gets; with several outputs these are
    name_output. Bounded indicators add columns over windows of one partitioning and order, so the table is shuffled and
    sorted once for all of them. Recursive ones share one pass over each symbol's rows, which takes the others' columns along.
    """
    found = {name: (registry.get(kind), params) for name, (kind, params) in indicators.items()}
    out, columns = registry.mapped(df, inputs), []
    bars = out.columns
    for name, (i, params) in found.items():
        if i.kernel is not None:
            continue
        wide = i.function(out, **i.resolve(params), spec=replace(spec, keep=True))
        own = {o: name if o == "value" else f"{name}_{o}" for o in i.outputs}
        columns += own.values()
        out = wide.select(*[F.col(c) for c in dict.fromkeys([*bars, *columns]) if c not in own.values()], *[F.col(o).alias(c) for o, c in own.items()])
    kernels = {n: i.kernel(**i.resolve(params)) for n, (i, params) in found.items() if i.kernel is not None}
    if kernels:
        outputs = {n: found[n][0].outputs for n in kernels}
        out = recursive.compute(out, kernels, outputs, spec, keep=columns)
    order = [c for n, (i, _) in found.items() for c in (n if o == "value" else f"{n}_{o}" for o in i.outputs)]
    return out.select(spec.symbol, spec.ts, *order)
