"""Coarser bars from finer ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.sources.bars import floored, indexed, midnight

#: Minutes of the timeframes from fine to coarse.
MINUTES = {"5m": 5, "15m": 15, "1h": 60, "1d": 1440, "1w": 10080, "1M": 43200}


def can_resample(source: str, target: str) -> bool:
    """Only to a coarser timeframe: of an hour at most if the minutes divide; not from weeks to months, which don't nest."""
    a, b = MINUTES[source], MINUTES[target]
    if a >= b or source == "1w":
        return False
    return b % a == 0 if b <= 60 else True


def bucket(target: str) -> Column:
    """The start, for weeks (to Friday) and months the last day, of the period that ``ts`` is in."""
    ts = F.col("ts")
    if target == "1d":
        return midnight(ts)
    if target == "1w":
        return F.next_day(F.date_sub(F.to_date(ts), 1), "FRI").cast("timestamp_ntz")
    if target == "1M":
        return F.last_day(F.to_date(ts)).cast("timestamp_ntz")
    return floored(ts, MINUTES[target])


def resample(bars: DataFrame, source: str, target: str) -> DataFrame:
    """Bars of ``target``: first open, last close, extremes, summed volume (null if none is known), under their first bar's time.

    Weeks and months are put to midnight. Periods without bars have none.
    """
    if not can_resample(source, target):
        raise ValueError(f"{source} bars can't be made {target} bars")
    grouped = bars.where(F.col("timeframe") == source).withColumn("_b", bucket(target)).groupBy("symbol", "_b")
    out = grouped.agg(F.min("ts").alias("ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    ts = midnight(F.col("ts")) if target in ("1w", "1M") else F.col("ts")
    return indexed(out.drop("_b").withColumns({"ts": ts, "timeframe": F.lit(target)}))
