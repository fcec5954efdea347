"""Sweeps: many parameter sets of registered indicators over the same bars, in one job."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from barlume.operators import batch, grids, registry
from barlume.plans.spec import BARS, BarSpec

#: Categories whose outputs are no features of a price's movement unless asked for.
EXCLUDED = ("pattern", "price")


@dataclass(frozen=True)
class IndicatorSpec:
    """An indicator with parameters. Equal whatever the order of the parameters."""

    name: str
    params: tuple[tuple[str, object], ...] = ()

    @classmethod
    def of(cls, name: str, params: dict) -> IndicatorSpec:
        return cls(name, tuple(sorted(params.items())))

    @property
    def key(self) -> str:
        """rsi_period5; the name alone without parameters."""
        return "_".join([self.name, *(f"{k}{v}" for k, v in self.params)])


def specs(chosen: dict[str, dict[str, list]] | None = None, indicators: list[str] | None = None, include_defaults: bool = True) -> list[IndicatorSpec]:
    """Every combination of the grids (the default ones), each once, in order; then each swept indicator's own defaults.

    Combinations whose fast value is not below the slow one are left out. Names that are not registered have no defaults.
    """
    out: dict[IndicatorSpec, None] = {}
    for name, grid in (grids.GRIDS if chosen is None else chosen).items():
        if indicators is not None and name not in indicators:
            continue
        out |= dict.fromkeys(IndicatorSpec.of(name, p) for p in grids.expand(grid))
        if include_defaults and grid and name in registry.names():
            out[IndicatorSpec.of(name, registry.get(name).parameters)] = None
    return list(out)


def single_price() -> list[str]:
    """The registered indicators of one price, which can be taken of another column than close."""
    return [n for n in registry.names() if tuple(registry.get(n).inputs) == ("close",)]


def registry_grids(
    width: str = "default", only: list[str] | None = None, exclude: tuple[str, ...] = (), exclude_categories: tuple[str, ...] = EXCLUDED, timeframe: str | None = None, bars: DataFrame | None = None
) -> dict[str, dict[str, list]]:
    """A grid for each registered indicator: the default one if there is one (unless width is coarse), else one by its parameters.

    With a timeframe or bars no period is longer than a 20th of their number.
    """
    fit = grids.periods_for_timeframe(timeframe or "", bars) if timeframe or bars is not None else None
    most = None if fit is None else max(fit, default=0)
    out = {}
    for name in registry.names():
        i = registry.get(name)
        if i.category in exclude_categories or name in exclude or (only and name not in only):
            continue
        if name in grids.GRIDS and width != "coarse":
            out[name] = {k: [v for v in vs if most is None or "period" not in k or v <= most] for k, vs in grids.GRIDS[name].items()}
        else:
            out[name] = grids.auto_grid(i.parameters, width, most)
    return out


def compute(df: DataFrame, wanted: list[IndicatorSpec], spec: BarSpec = BARS, inputs: dict[str, str] | None = None) -> DataFrame:
    """(symbol, ts, one column for each output of each spec): all in one job, see batch.compute_indicators. Dots and signs in keys become _."""
    return batch.compute_indicators(df, {re.sub(r"\W", "_", s.key): (s.name, dict(s.params)) for s in wanted}, spec, inputs)
