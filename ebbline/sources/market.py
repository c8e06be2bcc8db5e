"""Price panels from the order and event tables; all are lazy scans with the columns that they need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.functions.frames import last_known, series

#: Power that turns the synthetic prices' changes into market-like ones, for rules with percent limits.
DAMPING = 0.02


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily volume-weighted price per return flag: asset, date, price, volume."""
    lines = table(spark, sf_dir, "lineitem")
    out = lines.groupBy(F.col("l_returnflag").alias("asset"), F.to_date("l_shipdate").alias("date"))
    return out.agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"), F.sum("l_quantity").alias("volume"))


def damped_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bars with price 100 * (price / first price) ** DAMPING."""
    first = F.first("price").over(series())
    return bars(spark, sf_dir).withColumn("price", 100 * F.pow(F.col("price") / first, F.lit(DAMPING)))


def ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of ticks: asset, date, open, high, low, close, volume."""
    lines = table(spark, sf_dir, "lineitem").withColumn("tick", F.col("l_extendedprice") / F.col("l_quantity"))
    order = F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return lines.groupBy(F.col("l_returnflag").alias("asset"), F.to_date("l_shipdate").alias("date")).agg(
        F.min_by("tick", order).alias("open"), F.max("tick").alias("high"), F.min("tick").alias("low"), F.max_by("tick", order).alias("close"), F.sum("l_quantity").alias("volume")
    )


def damped_ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ohlcv with each price p as 100 * (p / first close) ** DAMPING."""
    first = F.first("close").over(series())
    scaled = {c: 100 * F.pow(F.col(c) / F.col("__first"), F.lit(DAMPING)) for c in ("open", "high", "low", "close")}
    return ohlcv(spark, sf_dir).withColumn("__first", first).withColumns(scaled).drop("__first")


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly series per event type: asset, ts, price (mean value and 1), volume (events)."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("asset"), F.date_trunc("hour", "ts").alias("ts")).agg((F.avg("value") + 1).alias("price"), F.count("*").alias("volume"))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order price per priority and day: asset, date, price."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("asset"), F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("price"))


def read_bars(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """asset, date, price from parquet, orc, csv (with a header) or json lines; all-null prices go, gaps are filled forward."""
    schema = "asset string, date date, price double"
    reader = spark.read.schema(schema)
    rows = reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)
    return rows.withColumn("price", last_known(series(), F.col("price"))).dropna(subset=["price"])
