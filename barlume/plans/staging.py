"""Intermediate tables in the shared folder, order over all tasks, and sums of arrays over all rows."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def staged(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder that the session names: the lineage ends there. A local folder only where all runs in one machine."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="barlume-"))
    return df.checkpoint()


def in_order(df: DataFrame, *order: Column, name: str = "__rank") -> DataFrame:
    """df, staged, with the row's place from 0 in an order that should leave no ties. Spark deals ranges of the order over its tasks; one count a task goes round."""
    placed = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__pos", F.monotonically_increasing_id()))
    ranges = placed.groupBy(F.shiftright("__pos", 33).alias("__range")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("__range", F.shiftright("__pos", 33)).join(F.broadcast(ranges.select("__range", before.alias("__before"))), "__range")
    return placed.withColumn(name, F.col("__before") + F.col("__pos") % (1 << 33)).drop("__range", "__before", "__pos")


def matrix(column: pa.ListArray) -> np.ndarray:
    """The rows of a column of arrays of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def summed(df: DataFrame, f: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of f over all batches of rows, an array of the given shape. A task adds up its own and gives one row for each of its numbers."""
    size = int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += f(b).ravel()
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["i", "x"])

    out = np.zeros(size)
    total = df.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    out[total.column("i").to_numpy()] = total.column("x").to_numpy()
    return out.reshape(shape)
