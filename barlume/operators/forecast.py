"""Targets, features and contracts of a volatility forecast."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlume.plans.spec import BARS, BarSpec, ratio, require


def target_rv_total(bars: DataFrame, ca_window: int = 2, spec: BarSpec = BARS) -> DataFrame:
    """(symbol, session, target_rv_total, overnight_gap_var, intraday_bar_rv, start, end, prices, promotion_eligible, reason_codes) by session.

    The gap runs from the last close before the session to its open, the intraday part from there by bar. Sessions without
    an earlier close have no target and are left out. A session within ca_window days of a corporate action (column
    corporate_action_effective_ts) is not eligible for promotion.
    """
    require(bars, "open", "close")
    x = bars.withColumns({"session": F.to_date(spec.ts), "__p": spec.lag("close")})
    first = F.row_number().over(Window.partitionBy(spec.symbol, "session").orderBy(spec.ts)) == 1
    step = F.ln(ratio(F.col("close"), F.when(first, F.col("open")).otherwise(F.col("__p"))))
    x = x.withColumns({"__r": step, "__before": F.when(first, F.col("__p"))})
    near = F.lit(False)
    if "corporate_action_effective_ts" in bars.columns:
        near = F.coalesce(F.max(F.abs(F.datediff("session", F.to_date("corporate_action_effective_ts"))) <= ca_window), F.lit(False))
    out = x.groupBy(spec.symbol, "session").agg(
        F.max("__before").alias("__before"), F.min(spec.ts).alias("target_start_ts"), F.max(spec.ts).alias("target_end_ts"), F.min_by("open", spec.ts).alias("raw_price_start"),
        F.max_by("close", spec.ts).alias("raw_price_end"), F.sum(F.col("__r") * F.col("__r")).alias("intraday_bar_rv"), near.alias("__near"),
    )
    gap = F.ln(ratio(F.col("raw_price_start"), F.col("__before")))
    out = out.filter(F.col("__before").isNotNull()).withColumn("overnight_gap_var", gap * gap)
    return out.select(
        spec.symbol, "session", (F.col("overnight_gap_var") + F.col("intraday_bar_rv")).alias("target_rv_total"), "overnight_gap_var", "intraday_bar_rv", "target_start_ts", "target_end_ts",
        "raw_price_start", "raw_price_end", (~F.col("__near")).alias("promotion_eligible"), F.when(F.col("__near"), F.array(F.lit("CA_ADJACENT"))).otherwise(F.array().cast("array<string>")).alias("reason_codes"),
    )


def intraday_reversal_target(signals: DataFrame, horizon: str = "1 hour") -> DataFrame:
    """Adds target_start_ts (the fill) and target_end_ts (the horizon's end or the next close, what comes first). ValueError if a fill is before its signal or not before the next close."""
    if signals.filter((F.col("fill_ts") < F.col("signal_ts")) | (F.col("next_close_ts") <= F.col("fill_ts"))).limit(1).count():
        raise ValueError("a fill must lie between its signal and the next close")
    return signals.withColumns({"target_start_ts": F.col("fill_ts"), "target_end_ts": F.least(F.col("fill_ts") + F.expr(f"INTERVAL {horizon}"), F.col("next_close_ts")), "path_dependent": F.lit(False)})


def multiscale_features(df: DataFrame, value: str, weekly: int = 5, monthly: int = 22, floor: float = 1e-12, spec: BarSpec = BARS) -> DataFrame:
    """(symbol, ts, daily, weekly and monthly means, slopes, coverage), as of every row from it and those before it.

    Means are null with too few rows or if not positive; slopes run over up to monthly rows. Non-finite values are left out.
    """
    if weekly <= 0 or monthly <= 0:
        raise ValueError("windows must be positive")
    x = df.select(spec.symbol, spec.ts, F.col(value).alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf")))
    x = x.withColumns({"n": F.row_number().over(spec.order), "lv": F.ln(F.greatest(F.col("v"), F.lit(floor)))})
    positive = lambda c: F.when(c > 0, c)
    slope = lambda c: F.regr_slope(F.col(c), F.col("n").cast("double")).over(spec.last(monthly))
    return x.select(
        spec.symbol, spec.ts, positive(F.col("v")).alias("daily_var"), positive(spec.roll(F.avg, "v", weekly)).alias("weekly_avg_var"), positive(spec.roll(F.avg, "v", monthly)).alias("monthly_avg_var"),
        slope("v").alias("var_slope"), F.col("lv").alias("log_daily_var"), slope("lv").alias("log_var_slope"), F.col("n").cast("bigint").alias("observed_count"),
        (F.col("n") >= weekly).alias("has_full_weekly_window"), (F.col("n") >= monthly).alias("has_full_monthly_window"),
    )


def semivariance(df: DataFrame, r: str, window: int, spec: BarSpec = BARS) -> DataFrame:
    """(symbol, ts, downside_rv, upside_rv, bar_rv, coverage) over the last window returns."""
    x, frame = F.col(r), spec.last(window)
    down, up = F.least(x, F.lit(0.0)), F.greatest(x, F.lit(0.0))
    return df.select(
        spec.symbol, spec.ts, F.sum(down * down).over(frame).alias("downside_rv"), F.sum(up * up).over(frame).alias("upside_rv"), F.sum(x * x).over(frame).alias("bar_rv"),
        (F.count(x).over(frame) / window).alias("coverage"),
    )


def asymmetry_regression(df: DataFrame, r: str, spec: BarSpec = BARS) -> DataFrame:
    """(symbol, b0, b1, b2, b3, observations): least squares of r squared on the previous return, its sign and their product.

    One aggregation gives each symbol's moments, a 4 by 4 solve of least norm the coefficients; those near 0 are 0.
    """
    import numpy as np
    import pandas as pd

    p = spec.lag(r)
    x = df.select(spec.symbol, F.array(F.lit(1.0), p, F.when(p < 0, 1.0).otherwise(0.0), F.when(p < 0, p).otherwise(0.0)).alias("x"), (F.col(r) * F.col(r)).alias("y"), p.alias("p")).filter("p IS NOT NULL AND y IS NOT NULL")
    moments = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"m{i}{j}") for i in range(4) for j in range(i, 4)] + [F.sum(F.col("x")[i] * F.col("y")).alias(f"v{i}") for i in range(4)]
    m = x.groupBy(spec.symbol).agg(*moments, F.count("*").alias("observations"))
    kind = dict(m.dtypes)[spec.symbol]

    def solve(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows = []
            for _, s in b.iterrows():
                a = np.array([[s[f"m{min(i, j)}{max(i, j)}"] for j in range(4)] for i in range(4)])
                w = np.linalg.pinv(a, rcond=1e-12) @ np.array([s[f"v{i}"] for i in range(4)])
                rows.append((s[spec.symbol], *np.where(np.abs(w) < 1e-12, 0.0, w).tolist(), int(s["observations"])))
            yield pd.DataFrame(rows, columns=[spec.symbol, "b0", "b1", "b2", "b3", "observations"])

    return m.mapInPandas(solve, f"{spec.symbol} {kind}, b0 double, b1 double, b2 double, b3 double, observations bigint")


def gap_jump_labels(df: DataFrame, threshold_gap: float = 0.6, threshold_range: float = 0.4, threshold_jump: float = 0.1) -> DataFrame:
    """Adds labels (sorted array) from overnight_gap_var, intraday_range_var, jump_var, total_var and, if there, jump_flag."""
    for t in (threshold_gap, threshold_range, threshold_jump):
        if not 0 <= t <= 1:
            raise ValueError("thresholds must lie in [0, 1]")
    total = F.greatest(F.col("total_var"), F.lit(1e-12))
    share = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)) / total
    jump = share("jump_var") >= threshold_jump
    if "jump_flag" in df.columns:
        jump = jump | F.coalesce(F.col("jump_flag"), F.lit(False))
    labels = F.array_compact(F.array(F.when(share("overnight_gap_var") >= threshold_gap, "GAP_DOMINATED_VOL"), F.when(share("intraday_range_var") >= threshold_range, "INTRADAY_RANGE_DOMINATED_VOL"), F.when(jump, "JUMP_DAY")))
    return df.withColumn("labels", labels)


def resolve_labels(labels: Column, scores: dict[str, float]) -> Column:
    """The labels with the greatest score; null if one has none."""
    score = F.create_map(*[F.lit(x) for pair in scores.items() for x in pair])
    values = F.transform(labels, lambda x: F.try_element_at(score, x))
    return F.when(~F.exists(values, lambda v: v.isNull()), F.filter(labels, lambda x: F.try_element_at(score, x) == F.array_max(values)))


def universe_membership(eligibility: DataFrame) -> DataFrame:
    """(symbol, universe) from rows (symbol, baseline, eligible, sessions_available)."""
    garch = F.lower("baseline").isin("garch", "garch_rv")
    x = eligibility.groupBy("symbol").agg(F.bool_and("eligible").alias("a"), F.bool_or(F.col("sessions_available") >= 22).alias("h"), F.coalesce(F.bool_or(garch & ~F.col("eligible")), F.lit(False)).alias("g"))
    return x.select("symbol", F.when(F.col("a"), "common-eligible").when(F.col("g") & F.col("h"), "limited-history").when(F.col("h"), "production-coverage").otherwise("limited-history").alias("universe"))


#: The order that the times of a feature, a forecast, a size and an order must keep.
CLOCKS = {
    "feature_forecast": "availability_ts <= forecast_origin_ts",
    "no_straddle": "observation_end_ts <= forecast_origin_ts",
    "forecast_target": "forecast_origin_ts < target_start_ts AND target_start_ts <= target_end_ts AND forecast_generated_ts <= forecast_available_ts",
    "forecast_size": "forecast_available_ts <= sizing_decision_ts AND source_valid_from <= sizing_decision_ts AND source_valid_from <= source_valid_until",
    "sizing_order": "source_valid_from <= order_decision_ts AND order_decision_ts < source_valid_until",
}


def clock_violations(df: DataFrame) -> DataFrame:
    """(clock, violations) over rows that join the times of all parties; a missing time violates."""
    bad = [F.sum((~F.coalesce(F.expr(c), F.lit(False))).cast("bigint")).alias(k) for k, c in CLOCKS.items()]
    totals = df.agg(*[F.coalesce(b, F.lit(0)).alias(k) for b, k in zip(bad, CLOCKS, strict=True)])
    return totals.unpivot([], list(CLOCKS), "clock", "violations")


def dictionary_signature(identifier: str, version: str, entries: dict[str, dict]) -> str:
    """SHA-256 of a feature dictionary's canonical JSON, by which a pipeline notices that its definitions have changed."""
    payload = {"feature_dictionary_id": identifier, "feature_dictionary_version": version, "entries": entries}
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def dictionary_of(df: DataFrame, identifier: str, version: str) -> str:
    """The signature of a table's own dictionary: the type of every column, whether it may be null, and its metadata."""
    return dictionary_signature(identifier, version, {f.name: {"type": f.dataType.simpleString(), "nullable": f.nullable, **f.metadata} for f in df.schema.fields})
