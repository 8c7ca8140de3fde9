"""Queries of swings and candlestick formations over hourly bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.operators import blocked, candles, harmonics, levels, patterns, swings
from tapeworks.operators.recursive import recursive, zigzag
from tapeworks.plans.indicators import BLOCK, Query, shown
from tapeworks.sources.bars import line_trades, daily_trades, hourly_events

PATTERN = ("pattern_id", "direction", "stage", "start_idx", "end_idx", "confirmation_idx", "target_reached", "level", "inval", "target", "quality", "volume_confirmation", "category", "current")


def of_pattern(*detectors: str, daily: bool = False) -> Query:
    def run(spark, sf_dir) -> DataFrame:
        bars = patterns.context(recursive((line_trades if daily else hourly_events)(spark, sf_dir), "scale"))
        found = patterns.detect(bars, zigzag(bars), tuple(i for d in detectors for i in patterns.IDS[d]))
        return shown(patterns.current(found), *PATTERN, keys=("symbol",))

    return run


def formations(spark, sf_dir) -> DataFrame:
    bars = recursive(hourly_events(spark, sf_dir), "scale")
    return shown(candles.detect(bars, levels.zones(bars, zigzag(bars))), "i", "pattern_id", "candles", "direction", "kind", "trend_scales", "confirmation", "score", keys=("symbol",))


def zones(spark, sf_dir) -> DataFrame:
    bars = recursive(line_trades(spark, sf_dir), "scale")
    found = levels.zones(bars, zigzag(bars)).withColumn("sources", F.array_join("sources", ","))
    return shown(found, "place", "low", "high", "mid", "kind", "touches", "first_idx", "last_idx", "strength", "role_reversals", "crossings", "sources", "distance", "immediate", "major", keys=("symbol",))


def harmonic(load: Callable, tolerance: float) -> Query:
    """All of a series' history. The little that is added keeps halves of the last decimal from being rounded either way.

    Trades of random prices hold few close ratios: the lines of the table are enough for the operator's own tolerance, the
    fewer series of return flags are asked for ratios that may be a quarter off.
    """

    def run(spark, sf_dir) -> DataFrame:
        bars = patterns.context(recursive(load(spark, sf_dir), "scale"))
        found = harmonics.candidates(patterns.pivots(zigzag(bars), bars), tolerance=tolerance)
        rows = patterns.distinct(harmonics.resolved(found, bars, age=1 << 30)).withColumns({c: F.round(F.col(c) + 1e-7, 4) for c in ("level", "inval", "target")})
        return shown(rows, "pattern_id", "stage", "start_idx", "end_idx", "confirmation_idx", "level", "inval", "target", "quality", keys=("symbol",))

    return run


def impulse(spark, sf_dir) -> DataFrame:
    """All of a series' history; prices are rounded as in ``harmonic``."""
    bars = patterns.context(recursive(daily_trades(spark, sf_dir), "scale"))
    found = harmonics.impulses(patterns.pivots(zigzag(bars), bars), recent=1 << 30)
    rows = found.withColumns({c: F.round(F.col(c) + 1e-7, 4) for c in ("level", "inval", "target")})
    return shown(rows, "pattern_id", "start_idx", "end_idx", "level", "inval", "target", "quality", keys=("symbol",))


QUERIES: dict[str, Query] = {
    "swg01_zigzag": lambda spark, d: shown(zigzag(hourly_events(spark, d)), "k", "idx", "price", "kind", "confirmed_idx", "provisional", keys=("symbol",)),
    "swg01_blocked_zigzag": lambda spark, d: shown(blocked.zigzag(blocked.scale(hourly_events(spark, d), block=BLOCK), block=BLOCK), "k", "idx", "price", "kind", "confirmed_idx", "provisional", keys=("symbol",)),
    "swg02_fractals": lambda spark, d: shown(swings.fractals(hourly_events(spark, d)), "idx", "price", "kind", "confirmed_idx", keys=("symbol",)),
    "swg03_peaks": lambda spark, d: shown(swings.detect(recursive(hourly_events(spark, d), "scale"), "peaks"), "idx", "price", "kind", keys=("symbol",)),
    "swg07_labels": lambda spark, d: swings.labelled(swings.fractals(hourly_events(spark, d))).select("symbol", "idx", "kind", "label"),
    "swg08_trend": lambda spark, d: swings.trend(swings.fractals(hourly_events(spark, d))).select("symbol", "trend"),
    "cdl01_35_formations": formations,
    "lvl01_07_zones": zones,
    "cht02_doubles": of_pattern("double"),
    "cht03_triples": of_pattern("triple"),
    "cht12_measured_moves": of_pattern("measured_move"),
    "cht01_head_and_shoulders": of_pattern("head_and_shoulders", daily=True),
    "cht04_adam_and_eve": of_pattern("adam_eve", daily=True),
    "cht06_flags": of_pattern("flag", daily=True),
    "cht07_08_roundings": of_pattern("rounding", daily=True),
    "cht05_two_lines": of_pattern("two_line", daily=True),
    "cht09_diamonds": of_pattern("diamond", daily=True),
    "cht10_v_reversals": of_pattern("v_reversal", daily=True),
    "cht11_traps": of_pattern("trap", daily=True),
    "cht13_compressions": of_pattern("compression", daily=True),
    "cht14_contractions": of_pattern("vcp", daily=True),
    "cht15_17_harmonics": harmonic(daily_trades, 0.25),
    "cht15_17_close_harmonics": harmonic(line_trades, harmonics.TOLERANCE),
    "cht18_impulses": impulse,
}
