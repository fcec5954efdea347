"""Trade bars of a stream: the batch aggregation under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlume.operators import microstructure
from barlume.plans.spec import BARS, BarSpec


def stream_trade_bars(trades: DataFrame, every: str = "1 hour", late: str = "1 hour", spec: BarSpec = BARS) -> DataFrame:
    """Trade bars that are final once the watermark has passed them; trades later than late are dropped by Spark."""
    timed = trades.withColumn(spec.ts, F.col(spec.ts).cast("timestamp")).withWatermark(spec.ts, late)
    return microstructure.trade_bars(timed, every, spec)
