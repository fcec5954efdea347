"""Market tables: readers for Parquet datasets and the tables that stand in for them in the sample data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlume.plans.spec import logarithm, quotient


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet dataset of bars; ValueError for another kind of file."""
    if not path.rstrip("/").endswith((".parquet", ".pq")):
        raise ValueError(f"{path} is not a Parquet dataset")
    return spark.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    """OHLCV bars of the events: a symbol for each event type, value as price, the number of events as volume."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), bucket(F.col("ts"), unit).alias("bar"), "ts", "value")
    made = e.groupBy("symbol", "bar").agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"), F.count("*").cast("double").alias("volume"),
    )
    return made.withColumnRenamed("bar", "ts")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of the line items: price, quantity and side by return flag as symbol."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"), F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of the bars: low and high as bid and ask."""
    return bars(spark, sf_dir).select("symbol", "ts", F.col("low").alias("bid"), F.col("high").alias("ask"), F.col("volume").alias("bid_size"), (1 + F.floor("open")).cast("double").alias("ask_size"))


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-book levels of the line items."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").alias("ts"), F.when(F.col("l_linestatus") == "O", "bid").otherwise("ask").alias("side"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"), (F.col("l_linenumber") - 1).alias("level"),
    )


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return b.select("symbol", "ts", ((F.col("close") - F.col("open")) / 10000).alias("funding_rate"), F.col("close").alias("mark_price"))


def open_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return b.select("symbol", "ts", F.col("volume").alias("open_interest"), (F.col("volume") * F.col("close")).alias("open_interest_value"), F.lit(10000.0).alias("circulating_supply"))


def event_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log returns between consecutive events of a symbol within a day: (symbol, bar, seq, r); to and from a value of 0 they are infinite, between two NaN."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", "value", bucket(F.col("ts"), "day").alias("bar"))
    order = Window.partitionBy("symbol", "bar").orderBy("ts")
    x = e.select("symbol", "bar", (F.row_number().over(order) - 1).alias("seq"), "value", F.lag("value").over(order).alias("before"))
    return x.select("symbol", "bar", "seq", logarithm(quotient(F.col("value"), F.col("before"))).alias("r")).filter("r IS NOT NULL")
