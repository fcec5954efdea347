"""Backward as-of alignment: the latest feature row at or before each base row, in one shuffle and one sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlume.plans.spec import BARS, BarSpec


def align_feature_frame(base: DataFrame, features: DataFrame, shift: int = 0, prefix: str = "", spec: BarSpec = BARS) -> DataFrame:
    """base with the columns of the latest feature row at or before its time, of its symbol; nulls where there is none.

    shift moves the features that many rows later within their symbol first, prefix goes before their names. Of feature
    rows with equal time any one may be taken. Base rows are kept as they are, repeated ones too.
    """
    return align_feature_frames(base, {prefix: features}, shift, spec, sep="")


def align_feature_frames(base: DataFrame, frames: dict[str, DataFrame], shift: int = 0, spec: BarSpec = BARS, sep: str = "_") -> DataFrame:
    """The same for several named feature frames at once: all sides are united and read off in a single window pass."""
    sides, names = [], []
    keys = [spec.symbol, spec.ts]
    own = base.select(*keys, F.struct(*base.columns).alias("__base"), F.lit(1).alias("__side"))
    for i, (name, frame) in enumerate(frames.items()):
        columns = [c for c in frame.columns if c not in keys]
        row = F.struct(*[F.col(c).alias(f"{name}{sep if name else ''}{c}") for c in columns])
        row = F.lag(row, shift).over(Window.partitionBy(spec.symbol).orderBy(spec.ts)) if shift else row
        sides.append(frame.select(*keys, row.alias(f"__f{i}"), F.lit(0).alias("__side")))
        names.append(f"__f{i}")
    united = own
    for side in sides:
        united = united.unionByName(side, allowMissingColumns=True)
    seen = Window.partitionBy(spec.symbol).orderBy(spec.ts, "__side").rowsBetween(Window.unboundedPreceding, 0)
    united = united.select("__base", "__side", *[F.last(n, ignorenulls=True).over(seen).alias(n) for n in names])
    return united.filter("__side = 1").select("__base.*", *[f"{n}.*" for n in names])


def align_higher_timeframe(base: DataFrame, higher: DataFrame, spec: BarSpec = BARS) -> DataFrame:
    """base with the columns of the latest higher-timeframe bar that has started; clashing names get _higher."""
    clash = {c: f"{c}_higher" for c in higher.columns if c in base.columns and c not in (spec.symbol, spec.ts)}
    return align_feature_frame(base, higher.withColumnsRenamed(clash), spec=spec)
