"""Small helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local one of our own only where the session names none and all runs in one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    kept = spark.sparkContext.getCheckpointDir()
    if kept is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="barlume-"))
        kept = spark.sparkContext.getCheckpointDir()
    return kept


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there, and a lost executor costs nothing but its own tasks.

    The files are deleted when the application ends, as a result may be read until then.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    out = written(df, path)
    at_the_end(df.sparkSession, path)
    return out


def at_the_end(spark: SparkSession, path: str) -> None:
    """Has a folder deleted when the application ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


class Scratch:
    """Staged tables that are deleted when the block ends, for what the result does not read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        return written(df, f"{self.folder}/{name}-{self.n}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. Texts without other letters than ASCII take the short way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row: a lambda over an array of one binds it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of a text column; one pass that reads that column alone."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("n")).first()["n"])


def ranked(rows: DataFrame, order: list[Column], scratch: Scratch) -> DataFrame:
    """rows with a rank from 0 in the given order, which should leave no ties.

    Spark deals ranges of the order over its tasks and sorts each; a row's rank is its place in its range plus the number
    of rows in the ranges before, of which there is one count a task.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    placed = scratch.stage(placed, "placed")
    ranges = placed.groupBy(F.shiftright("pos", 33).alias("range")).agg(F.count("*").alias("n"))
    ranges = ranges.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.withColumn("range", F.shiftright("pos", 33)).join(F.broadcast(ranges), "range").withColumn("rank", F.col("before") + F.col("pos") % (1 << 33)).drop("range", "before", "pos")
