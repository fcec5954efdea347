"""Exponential means of a stream against the batch, out of order and over a restart."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barlume.operators import recursive
from barlume.streaming.indicators import stream_exponential_means

SCHEMA = "symbol string, ts timestamp, close double, volume double"


def write(spark, folder, number, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/batch={number}")


def run(spark, folder, out, checkpoint):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    means = stream_exponential_means(stream, {"fast": ("close", 3), "slow": ("close", 8), "size": ("volume", 3)}, "2 hours")
    q = means.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    assert q.awaitTermination(120)


def test_stream_equals_batch_and_goes_on_after_a_restart(spark, tmp_path):
    rng = np.random.default_rng(2)
    base = pd.Timestamp("2024-01-01")
    rows = [(s, (base + pd.Timedelta(hours=int(h))).to_pydatetime(), float(rng.normal() + 50), float(h)) for s in ("a", "b") for h in range(40)]
    by_time = sorted(rows, key=lambda r: r[1])
    batches = [by_time[i : i + 12] for i in range(0, 80, 12)]
    batches[1], batches[2] = batches[1][:-2] + batches[2][:2], batches[1][-2:] + batches[2][2:]  # rows an hour late
    for b in batches:
        rng.shuffle(b)
    late = ("a", (base + pd.Timedelta(hours=1)).to_pydatetime(), 1e6, 1e6)  # a row that the watermark has long passed
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for i, b in enumerate(batches[:3]):
            write(spark, folder, i, [(r[0], pd.Timestamp(r[1]).to_pydatetime(), float(r[2]), float(r[3])) for r in b])
        run(spark, folder, out, checkpoint)
        part = spark.read.parquet(out).count()
        for i, b in enumerate(batches[3:], 3):
            write(spark, folder, i, [(r[0], pd.Timestamp(r[1]).to_pydatetime(), float(r[2]), float(r[3])) for r in [*b, *([late] if i == 5 else [])]])
        run(spark, folder, out, checkpoint)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = {(r["symbol"], r["ts"]): r for r in spark.read.parquet(out).collect()}
    assert 0 < part < len(got) == 2 * 38  # the last two hours wait for the watermark
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"high": F.col("close"), "low": F.col("close")})
    for name, kernel, skipped in (("fast", recursive.ema(3), 3), ("slow", recursive.ema(8), 8), ("size", recursive.ema(3, "volume"), 3)):
        want = {(r["symbol"], r["ts"]): r["value"] for r in recursive.indicator(df, kernel, ["value"]).collect()}
        for k, r in got.items():
            if k in want:
                assert abs(r[name] - want[k]) < 1e-9
            else:
                assert r[name] is None
        assert sum(r[name] is None for r in got.values()) == 2 * skipped
