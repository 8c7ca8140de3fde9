"""Bars of a stream of ticks, and rules evaluated on them as they close."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapeworks.session import shared_folder
from tapeworks.sources.bars import as_utc, of_utc


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of (symbol, ts, price, seq)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # as a pattern the path may be a file or a folder of part files; without one a stream takes folders only
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return stream.select(F.col("event_type").alias("symbol"), as_utc(F.col("ts").cast("timestamp_ntz")).alias("ts"), F.col("value").alias("price"), F.col("event_id").alias("seq"))


def closed_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Candles of ``ticks`` (symbol, ts, price, seq), each once it is ``late`` behind the newest tick; later ticks are dropped."""
    at = F.struct("ts", "seq")
    bars = ticks.where("price is not null").withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w"))
    found = bars.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").cast("double").alias("volume"))
    return found.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write what is there now of a stream to Parquet; files that were written before stay as they are."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def alert_stream(bars: DataFrame, rule: Column, deliver: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 minute") -> StreamingQuery:
    """Bars that meet ``rule`` handed to ``deliver`` once for each symbol and bar, even if a batch is run again."""
    hits = bars.where(rule).withWatermark("ts", "0 seconds").dropDuplicatesWithinWatermark(["symbol", "ts"])
    return hits.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def streamed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly bars that a stream of all events closes, read back from the shared folder."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    run_to_end(closed_bars(event_ticks(spark, sf_dir)), f"{base}/bars", f"{base}/state")
    return spark.read.parquet(f"{base}/bars").withColumn("ts", of_utc(F.col("ts")))
