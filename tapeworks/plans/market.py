"""Queries of bars, resampling and market structure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.operators import levels, structure
from tapeworks.operators.recursive import recursive, zigzag
from tapeworks.operators.resample import resample
from tapeworks.plans.indicators import Query, shown
from tapeworks.sources.bars import daily_trades, five_minute_events, hourly_events, minute_text
from tapeworks.streaming.bars import streamed_bars


def candles(bars: DataFrame) -> DataFrame:
    """Eight decimals, which no quotient of a price in cents and a quantity of up to 50 has half of."""
    at = minute_text(F.col("ts")).alias("at")
    return bars.select("symbol", "i", at, *(F.round(c, 8).alias(c) for c in ("open", "high", "low", "close", "volume")))


def of_structure(find: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    return lambda spark, d: shown(find(recursive(hourly_events(spark, d), "scale")), *columns, keys=("symbol",))


QUERIES: dict[str, Query] = {
    "src_hourly_bars": lambda spark, d: candles(hourly_events(spark, d)),
    "src_daily_bars": lambda spark, d: candles(daily_trades(spark, d)),
    "rsm03_five_to_fifteen_minutes": lambda spark, d: candles(resample(five_minute_events(spark, d), "5m", "15m")),
    "rsm03_hours_to_days": lambda spark, d: candles(resample(hourly_events(spark, d), "1h", "1d")),
    "rsm05_days_to_weeks": lambda spark, d: candles(resample(daily_trades(spark, d), "1d", "1w")),
    "rsm06_days_to_months": lambda spark, d: candles(resample(daily_trades(spark, d), "1d", "1M")),
    "str01_breaks": of_structure(lambda b: structure.breaks(b, zigzag(b)), "type", "direction", "i", "level", "broken_idx"),
    "str02_value_gaps": of_structure(structure.value_gaps, "direction", "i", "low", "high", "status"),
    "str03_order_blocks": of_structure(lambda b: structure.order_blocks(b, structure.breaks(b, zigzag(b))), "direction", "break_i", "i", "low", "high", "status"),
    "str04_bases": of_structure(structure.bases, "type", "i", "low", "high"),
    "str05_range_traps": of_structure(structure.range_traps, "type", "i", "low", "high"),
    "lvl08_auxiliary": lambda spark, d: shown(levels.auxiliary(hourly_events(spark, d)), "kind", "price", keys=("symbol",)),
    "lvl09_volume_at_price": lambda spark, d: shown(levels.volume_at_price(hourly_events(spark, d)), "price", "volume", keys=("symbol",)),
    "src_streamed_bars": lambda spark, d: streamed_bars(spark, d).select("symbol", minute_text(F.col("ts")).alias("at"), *(F.round(c, 8).alias(c) for c in ("open", "high", "low", "close", "volume"))),
}
