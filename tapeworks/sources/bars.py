"""Candles from ticks and trades, and the index that later operators use.

Bars: symbol, timeframe, ts (without zone), open, high, low, close, volume, i; ``i`` counts a series' bars from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SERIES = ["symbol", "timeframe"]


def midnight(ts: Column) -> Column:
    """The start of the day of a time without zone, whatever the session's zone (``date_trunc`` gives a time of that zone)."""
    return F.to_date(ts).cast("timestamp_ntz")


def floored(ts: Column, minutes: int) -> Column:
    """The start of the interval of so many minutes, counted from midnight, that a time without zone is in."""
    past = F.hour(ts) * 60 + F.minute(ts)
    return midnight(ts) + F.make_dt_interval(F.lit(0), F.lit(0), past - past % minutes)


def seconds(ts: Column) -> Column:
    """Whole seconds of a time without zone since 1970, so that differences know no summer time."""
    return F.unix_date(F.to_date(ts)).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def as_utc(ts: Column) -> Column:
    """A time without zone as an instant, read as UTC: streams take no other event times."""
    return F.concat(ts.cast("string"), F.lit("Z")).cast("timestamp")


def of_utc(ts: Column) -> Column:
    """An instant as a time without zone, in UTC, to the second."""
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.unix_seconds(ts))


def minute_text(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm`` of a time without zone (``date_format`` would take it for one of the session's zone)."""
    return F.substring(ts.cast("string"), 1, 16)


def indexed(bars: DataFrame) -> DataFrame:
    """``bars`` with ``i``, the place of each in its series by time."""
    return bars.withColumn("i", F.row_number().over(Window.partitionBy(*SERIES).orderBy("ts")) - 1)


def from_ticks(ticks: DataFrame, timeframe: str, symbol: Column, bucket: Column, price: Column, volume: Column, order: list[str]) -> DataFrame:
    """Candles of ``ticks``: the first and last price follow ``order``, which must be total, so that they don't depend on partitions."""
    rows = ticks.select(symbol.alias("symbol"), bucket.alias("ts"), price.alias("price"), volume.alias("v"), F.struct(*order).alias("at"))
    bars = rows.where("price is not null").groupBy("symbol", "ts").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.sum("v").alias("volume")
    )
    return indexed(bars.withColumn("timeframe", F.lit(timeframe)))


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles of the events' values, one series for each type; the volume is the number of events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return from_ticks(events, "1h", F.col("event_type"), floored(F.col("ts").cast("timestamp_ntz"), 60), F.col("value"), F.lit(1.0), ["ts", "event_id"])


def daily_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily candles of the unit prices in lineitem, one series for each return flag; the volume is the quantity."""
    trades = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return from_ticks(trades, "1d", F.col("l_returnflag"), midnight(F.col("l_shipdate")), price, F.col("l_quantity"), order)


def line_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily candles of the unit prices in lineitem, one series for each return flag and line number."""
    trades = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return from_ticks(trades, "1d", F.concat_ws(" ", "l_returnflag", "l_linenumber"), midnight(F.col("l_shipdate")), price, F.col("l_quantity"), order)


def five_minute_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute candles of the events' values."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return from_ticks(events, "5m", F.col("event_type"), floored(F.col("ts").cast("timestamp_ntz"), 5), F.col("value"), F.lit(1.0), ["ts", "event_id"])
