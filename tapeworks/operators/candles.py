"""Candlestick formations as expressions over a bar and the four before it; no grouping beyond the series' own window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.rolling import before, over, series
from tapeworks.operators.levels import ZONE_NEAR, near_zone
from tapeworks.sources.bars import SERIES

# The formations with their bars, direction, kind and the trend that should stand before them (-1 down, 1 up, 0 any).
FORMATIONS: dict[str, tuple[int, str, str, int]] = {
    "doji": (1, "neutral", "indecision", 0),
    "dragonfly_doji": (1, "bullish", "reversal", -1),
    "gravestone_doji": (1, "bearish", "reversal", 1),
    "long_legged_doji": (1, "neutral", "indecision", 0),
    "hammer": (1, "bullish", "reversal", -1),
    "hanging_man": (1, "bearish", "reversal", 1),
    "inverted_hammer": (1, "bullish", "reversal", -1),
    "shooting_star": (1, "bearish", "reversal", 1),
    "spinning_top": (1, "neutral", "indecision", 0),
    "bullish_marubozu": (1, "bullish", "continuation", 0),
    "bearish_marubozu": (1, "bearish", "continuation", 0),
    "bullish_engulfing": (2, "bullish", "reversal", -1),
    "bearish_engulfing": (2, "bearish", "reversal", 1),
    "bullish_harami": (2, "bullish", "reversal", -1),
    "bearish_harami": (2, "bearish", "reversal", 1),
    "piercing": (2, "bullish", "reversal", -1),
    "dark_cloud_cover": (2, "bearish", "reversal", 1),
    "tweezer_bottom": (2, "bullish", "reversal", -1),
    "tweezer_top": (2, "bearish", "reversal", 1),
    "matching_low": (2, "bullish", "reversal", -1),
    "bullish_kicking": (2, "bullish", "reversal", 0),
    "bearish_kicking": (2, "bearish", "reversal", 0),
    "morning_star": (3, "bullish", "reversal", -1),
    "evening_star": (3, "bearish", "reversal", 1),
    "morning_doji_star": (3, "bullish", "reversal", -1),
    "evening_doji_star": (3, "bearish", "reversal", 1),
    "three_white_soldiers": (3, "bullish", "reversal", -1),
    "three_black_crows": (3, "bearish", "reversal", 1),
    "three_inside_up": (3, "bullish", "reversal", -1),
    "three_inside_down": (3, "bearish", "reversal", 1),
    "three_outside_up": (3, "bullish", "reversal", -1),
    "three_outside_down": (3, "bearish", "reversal", 1),
    "rising_three_methods": (5, "bullish", "continuation", 1),
    "falling_three_methods": (5, "bearish", "continuation", -1),
}
AVERAGED, TREND_BARS, TREND_SCALES, DOJI = 10, 10, 2.0, 0.1


class Bar:
    """The candle ``back`` bars ago, as columns of a frame prepared by ``_prepared``."""

    def __init__(self, back: int):
        self.o, self.h, self.l, self.c = (F.col(f"_{x}{back}") for x in ("open", "high", "low", "close"))
        self.range, self.body, self.top, self.bottom, self.upper, self.lower = (F.col(f"_{x}{back}") for x in ("range", "body", "top", "bottom", "upper", "lower"))
        self.bull, self.bear, self.doji = self.c > self.o, self.c < self.o, F.col(f"_doji{back}")
        self.middle = (self.o + self.c) / 2

    def long(self, typical: Column) -> Column:
        return (self.body >= typical) & (self.range > 0) & (self.body >= 0.5 * self.range)

    def full(self, typical: Column) -> Column:
        return (self.body >= 0.9 * self.range) & (self.body >= typical)


def _all(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _inside(inner: Bar, outer: Bar) -> Column:
    return _all(inner.top <= outer.top, inner.bottom >= outer.bottom, inner.body < 0.6 * outer.body)


def _engulfs(new: Bar, old: Bar) -> Column:
    return _all(new.top >= old.top, new.bottom <= old.bottom, new.body > old.body)


def shapes() -> dict[str, Column]:
    """Where each formation ends, whatever the trend before it."""
    x, p, a, _, f = (Bar(k) for k in range(5))
    ab = F.col("_typical")
    tolerance = 0.05 * ab + 0.002 * x.c
    r, plain = x.range, ~x.doji
    dragonfly = x.doji & (x.upper <= 0.1 * r) & (x.lower >= 0.6 * r)
    gravestone = x.doji & ~dragonfly & (x.lower <= 0.1 * r) & (x.upper >= 0.6 * r)
    legged = x.doji & ~dragonfly & ~gravestone & (x.upper >= 0.3 * r) & (x.lower >= 0.3 * r) & (r >= 1.5 * ab)
    hammer = _all(plain, x.lower >= 2 * x.body, x.upper <= 0.1 * r)
    inverted = _all(plain, x.upper >= 2 * x.body, x.lower <= 0.1 * r)
    marubozu = _all(plain, x.body >= 0.9 * r, x.body >= 1.2 * ab)
    star_up = _all(a.long(ab), a.bear, p.body <= 0.5 * ab, p.top <= a.c + 0.1 * ab, x.bull, x.c > a.middle)
    star_down = _all(a.long(ab), a.bull, p.body <= 0.5 * ab, p.bottom >= a.c - 0.1 * ab, x.bear, x.c < a.middle)
    held = _all(*(c for k in (1, 2, 3) for c in (Bar(k).body <= 0.5 * ab, Bar(k).h <= f.h, Bar(k).l >= f.l)))
    three = (a, p, x)
    found = {
        "doji": x.doji & ~dragonfly & ~gravestone & ~legged,
        "dragonfly_doji": dragonfly,
        "gravestone_doji": gravestone,
        "long_legged_doji": legged,
        "hammer": hammer,
        "hanging_man": hammer,
        "inverted_hammer": inverted,
        "shooting_star": inverted,
        "spinning_top": _all(plain, x.body <= 0.3 * r, x.upper >= x.body, x.lower >= x.body),
        "bullish_marubozu": marubozu & x.bull,
        "bearish_marubozu": marubozu & ~x.bull,
        "bullish_engulfing": _all(p.bear, x.bull, _engulfs(x, p)),
        "bearish_engulfing": _all(p.bull, x.bear, _engulfs(x, p)),
        "bullish_harami": _all(p.long(ab), p.bear, _inside(x, p)),
        "bearish_harami": _all(p.long(ab), p.bull, _inside(x, p)),
        "piercing": _all(p.long(ab), p.bear, x.bull, x.o < p.c, x.c > p.middle, x.c < p.o),
        "dark_cloud_cover": _all(p.long(ab), p.bull, x.bear, x.o > p.c, x.c < p.middle, x.c > p.o),
        "tweezer_bottom": _all(F.abs(x.l - p.l) <= tolerance, p.bear, x.bull),
        "tweezer_top": _all(F.abs(x.h - p.h) <= tolerance, p.bull, x.bear),
        "matching_low": _all(p.bear, x.bear, F.abs(x.c - p.c) <= tolerance, p.long(ab)),
        "bullish_kicking": _all(p.full(ab), x.full(ab), p.bear, x.bull, x.o > p.o),
        "bearish_kicking": _all(p.full(ab), x.full(ab), p.bull, x.bear, x.o < p.o),
        "morning_star": star_up & ~p.doji,
        "evening_star": star_down & ~p.doji,
        "morning_doji_star": star_up & p.doji,
        "evening_doji_star": star_down & p.doji,
        "three_white_soldiers": _all(*(c for b in three for c in (b.bull, b.body >= 0.8 * ab, b.upper <= 0.35 * b.body)), a.c < p.c, p.c < x.c, a.o < p.o, p.o <= a.c, p.o < x.o, x.o <= p.c),
        "three_black_crows": _all(*(c for b in three for c in (b.bear, b.body >= 0.8 * ab, b.lower <= 0.35 * b.body)), a.c > p.c, p.c > x.c, a.o > p.o, p.o >= a.c, p.o > x.o, x.o >= p.c),
        "three_inside_up": _all(a.long(ab), a.bear, _inside(p, a), p.bull, x.c > a.o),
        "three_inside_down": _all(a.long(ab), a.bull, _inside(p, a), p.bear, x.c < a.o),
        "three_outside_up": _all(a.bear, p.bull, _engulfs(p, a), x.c > p.c),
        "three_outside_down": _all(a.bull, p.bear, _engulfs(p, a), x.c < p.c),
        "rising_three_methods": _all(f.long(ab), f.bull, x.long(ab), x.bull, x.c > f.c, held, p.c < Bar(3).c + 0.5 * ab),
        "falling_three_methods": _all(f.long(ab), f.bear, x.long(ab), x.bear, x.c < f.c, held, p.c > Bar(3).c - 0.5 * ab),
    }
    return {name: F.coalesce((x.range > 0) & condition, F.lit(False)) for name, condition in found.items()}


def _prepared(bars: DataFrame) -> DataFrame:
    w = series()
    body, whole = F.abs(F.col("close") - F.col("open")), F.col("high") - F.col("low")
    bars = bars.withColumns({"_range": whole, "_body": body, "_top": F.greatest("open", "close"), "_bottom": F.least("open", "close"), "_doji": (whole > 0) & (body <= DOJI * whole)})
    bars = bars.withColumns({"_upper": F.col("high") - F.col("_top"), "_lower": F.col("_bottom") - F.col("low"), **{f"_{x}": F.col(x) for x in ("open", "high", "low", "close")}})
    parts = ("_open", "_high", "_low", "_close", "_range", "_body", "_top", "_bottom", "_upper", "_lower", "_doji")
    bars = bars.withColumns({f"{x}{k}": before(F.col(x), k) if k else F.col(x) for x in parts for k in range(5)})
    past, near = w.rowsBetween(-AVERAGED, -1), w.rowsBetween(-AVERAGED, 0)
    mean = F.when(F.count("_body").over(past) >= 3, F.avg("_body").over(past))
    return bars.withColumn("_typical", F.coalesce(F.when(mean > 0, mean), F.nullif(F.avg("_body").over(near), F.lit(0.0)), F.lit(1e-9)))


def _move(bars: int) -> Column:
    """The close before a formation of ``bars`` bars, less that TREND_BARS earlier (or the first), in scales of the bar before it."""
    start = F.coalesce(before(F.col("close"), bars + TREND_BARS), F.first("close").over(series()))
    return (before(F.col("close"), bars) - start) / F.greatest(before(F.col("scale"), bars), F.lit(1e-9))


def detect(bars: DataFrame, zones: DataFrame | None = None, all_bars: bool = True, scanned: int = 60) -> DataFrame:
    """The formations of ``bars`` with column ``scale``: a row for each that ends at a bar.

    (symbol, timeframe, i, pattern_id, candles, direction, kind, trend_scales, confirmation, score). The trend is taken
    before the longest formation that ends at the bar. ``score`` weighs the trend (3), size (1), relative volume (1, if
    known), the next close (2, if there is one) and whether its extreme lies at one of the series' ``zones`` (2, if it has
    any), the last two if the formation has a direction. Series of fewer than 15 bars, the first 10 bars, a last bar
    that is not ``complete`` (if there is such a column) and, unless ``all_bars``, all but the last ``scanned`` have none.
    """
    bars = _prepared(bars).withColumn("_n", F.count("*").over(Window.partitionBy(*SERIES)))
    bars = bars.withColumns({f"_move{k}": _move(k) for k in (1, 2, 3, 5)}).withColumn("_next", F.lead("close").over(series()))
    spans = {k: series().rowsBetween(1 - k, 0) for k in (1, 2, 3, 5)}
    bars = bars.withColumns({f"_least{k}": F.min("low").over(w) for k, w in spans.items()} | {f"_most{k}": F.max("high").over(w) for k, w in spans.items()})
    bars = bars.withColumns({f"_span{k}": F.max("high").over(series().rowsBetween(1 - k, 0)) - F.min("low").over(series().rowsBetween(1 - k, 0)) for k in (1, 2, 3, 5)})
    mean = F.when(F.count("volume").over(series().rowsBetween(-20, -1)) >= 20, F.avg("volume").over(series().rowsBetween(-20, -1)))
    bars = bars.withColumn("_volume", over(F.col("volume"), mean)).where((F.col("_n") >= AVERAGED + 5) & (F.col("i") >= AVERAGED))
    if "complete" in bars.columns:
        bars = bars.where((F.col("i") < F.col("_n") - 1) | F.coalesce("complete", F.lit(True)))
    if not all_bars:
        bars = bars.where(F.col("i") >= F.col("_n") - scanned)
    found = shapes()
    bars = bars.withColumns({f"_is_{name}": condition for name, condition in found.items()})
    bars = bars.withColumn("_hits", F.array_compact(F.array(*(F.when(F.col(f"_is_{name}"), name) for name in found))))
    length = F.create_map(*(F.lit(x) for name, (n, *_) in FORMATIONS.items() for x in (name, n)))
    bars = bars.where(F.size("_hits") > 0).withColumn("_longest", F.array_max(F.transform("_hits", lambda x: length[x])))
    pick = lambda form: reduce(lambda rest, k: F.when(F.col("_longest") == k, F.col(form.format(k))).otherwise(rest), (1, 2, 3, 5), F.lit(None))
    known = bars.withColumn("_moved", pick("_move{}")).withColumns({"_span": pick("_span{}"), "_least": pick("_least{}"), "_most": pick("_most{}")})
    known = known.withColumn("_trend", F.when(F.col("_moved") >= TREND_SCALES, 1).when(F.col("_moved") <= -TREND_SCALES, -1).otherwise(0))
    about = bars.sparkSession.createDataFrame([(name, *x) for name, x in FORMATIONS.items()], "_id string, _candles int, _direction string, _kind string, _need int")
    rows = known.withColumn("_id", F.explode("_hits")).join(F.broadcast(about), "_id")  # a row for each formation there is
    rows = rows.where(~(F.col("_id").isin("hammer", "inverted_hammer") & (F.col("_trend") > 0)) & ~(F.col("_id").isin("hanging_man", "shooting_star") & (F.col("_trend") < 0)))
    need, direction = F.col("_need"), F.col("_direction")
    trend = F.when(need == 0, 0.6).when(need == F.col("_trend"), F.least(F.lit(1.0), F.abs(F.col("_moved")) / (2 * TREND_SCALES))).otherwise(0.1)
    size = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_span") / (1.2 * F.col("scale"))))
    volume = F.when(F.col("_volume").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_volume") / 1.5)))
    follows = F.when(direction == "bullish", F.col("_next") > F.col("close")).when(direction == "bearish", F.col("_next") < F.col("close"))
    confirmation = F.when(direction == "neutral", "n/a").when(F.col("_next").isNull(), "pending").when(follows, "confirmed").otherwise("not_confirmed")
    counted = F.when(follows.isNotNull(), 2).otherwise(0)
    located = F.lit(None).cast("double")
    if zones is not None:
        rows = near_zone(rows.withColumns({"_at": F.when(direction == "bullish", F.col("_least")).otherwise(F.col("_most")), "_reach": ZONE_NEAR * F.col("scale")}), zones, "_at", "_reach")
        located = F.when((F.col("zones") > 0) & (direction != "neutral"), F.when(F.col("zone").isNotNull(), 1.0).otherwise(0.3))
    weighed = 3 * trend + size + F.coalesce(volume, F.lit(0.0)) + F.when(follows, 2).otherwise(0) + F.coalesce(2 * located, F.lit(0.0))
    weights = 4 + F.when(located.isNotNull(), 2).otherwise(0) + F.when(volume.isNotNull(), 1).otherwise(0) + counted
    return rows.select(*SERIES, "i", F.col("_id").alias("pattern_id"), F.col("_candles").alias("candles"), direction.alias("direction"), F.col("_kind").alias("kind"), F.col("_moved").alias("trend_scales"), confirmation.alias("confirmation"), (100 * weighed / weights).alias("score"))
