"""Market structure: breaks of swings, gaps, order blocks, bases and range traps. Bars come with column ``scale``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.rolling import before, series
from tapeworks.sources.bars import SERIES

RECENT = 200


def _sized(bars: DataFrame) -> DataFrame:
    return bars.withColumn("n", F.count("*").over(Window.partitionBy(*SERIES)))


def breaks(bars: DataFrame, swings: DataFrame, recent: int = RECENT) -> DataFrame:
    """Breaks of structure: (symbol, timeframe, type, direction, i, level, broken_idx), those of the last ``recent`` bars.

    A swing can be broken from its confirmation until the next of its kind is confirmed, once, by the first close
    beyond it. A break with the direction of the last one, or the first of all, is a BOS, else a CHoCH; of two on a bar
    the bullish one comes first. A close is joined with the swing in force only: each bar meets one of each kind.
    """
    later = Window.partitionBy(*SERIES, "kind").orderBy("idx")
    known = swings.where("not provisional").withColumn("until", F.lead("confirmed_idx").over(later))
    known = known.where("until is null or until > confirmed_idx").select(*SERIES, "kind", "idx", "price", F.col("confirmed_idx").alias("i"))
    closes = _sized(bars).select(*SERIES, "i", "close", "n")
    sides = closes.crossJoin(F.broadcast(bars.sparkSession.createDataFrame([("H",), ("L",)], "kind string")))  # two rows
    in_force = Window.partitionBy(*SERIES, "kind").orderBy("i")
    at = sides.join(known, [*SERIES, "kind", "i"], "left").withColumns({c: F.last(c, ignorenulls=True).over(in_force) for c in ("idx", "price")})
    beyond = F.when(F.col("kind") == "H", F.col("close") > F.col("price")).otherwise(F.col("close") < F.col("price"))
    first = at.where(beyond).groupBy(*SERIES, "kind", "idx").agg(F.min("i").alias("i"), F.first("price").alias("level"), F.first("n").alias("n"))
    order = Window.partitionBy(*SERIES).orderBy("i", "kind")
    same = F.coalesce(F.lag("kind").over(order) == F.col("kind"), F.lit(True))
    events = first.withColumn("type", F.when(same, "BOS").otherwise("CHoCH")).where(F.col("i") >= F.col("n") - recent)
    return events.select(*SERIES, "type", F.when(F.col("kind") == "H", "bullish").otherwise("bearish").alias("direction"), "i", "level", F.col("idx").alias("broken_idx"))


def value_gaps(bars: DataFrame, recent: int = RECENT, most: int = 10) -> DataFrame:
    """Gaps over three bars of more than a tenth of the scale: (symbol, timeframe, direction, i, low, high, status).

    Of those of the last ``recent`` bars that later bars have not filled, the latest ``most``.
    """
    w = series()
    future = w.rowsBetween(1, Window.unboundedFollowing)
    b = _sized(bars).withColumns({"h2": before(F.col("high"), 2), "l2": before(F.col("low"), 2), "fl": F.min("low").over(future), "fh": F.max("high").over(future)})
    b = b.where((F.col("i") >= F.greatest(F.lit(2), F.col("n") - recent)))
    up = F.struct(F.lit("bullish").alias("direction"), F.col("h2").alias("lo"), F.col("low").alias("hi"))
    down = F.struct(F.lit("bearish").alias("direction"), F.col("high").alias("lo"), F.col("l2").alias("hi"))
    g = b.select(*SERIES, "i", "scale", "fl", "fh", F.explode(F.array(up, down)).alias("x")).select("*", "x.*").where(F.col("hi") - F.col("lo") > 0.1 * F.col("scale"))
    bull = F.col("direction") == "bullish"
    filled = F.coalesce(F.when(bull, F.col("fl") <= F.col("lo")).otherwise(F.col("fh") >= F.col("hi")), F.lit(False))
    partly = F.coalesce(F.when(bull, F.col("fl") < F.col("hi")).otherwise(F.col("fh") > F.col("lo")), F.lit(False))
    g = g.where(~filled).withColumn("place", F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("i"), F.asc("direction"))))
    return g.where(F.col("place") <= most).select(*SERIES, "direction", (F.col("i") - 1).alias("i"), F.col("lo").alias("low"), F.col("hi").alias("high"), F.when(partly, "partially_filled").otherwise("open").alias("status"))


def bases(bars: DataFrame, recent: int = RECENT, most: int = 6) -> DataFrame:
    """Supply and demand: three small bodies before a move of 2.5 scales in three bars. They look ahead, so they only label the past."""
    base = series().rowsBetween(-2, 0)
    b = _sized(bars).withColumns({"body": F.max(F.abs(F.col("close") - F.col("open"))).over(base), "lo": F.min("low").over(base), "hi": F.max("high").over(base), "move": F.lead("close", 3).over(series()) - F.col("close")})
    b = b.where((F.col("i") >= F.greatest(F.lit(3), F.col("n") - recent)) & (F.col("body") <= 0.6 * F.col("scale")) & (F.abs("move") >= 2.5 * F.col("scale")))
    b = b.withColumn("place", F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("i")))).where(F.col("place") <= most)
    return b.select(*SERIES, F.when(F.col("move") > 0, "demand").otherwise("supply").alias("type"), "i", F.col("lo").alias("low"), F.col("hi").alias("high"))


def range_traps(bars: DataFrame, recent: int = RECENT, window: int = 40, most: int = 6) -> DataFrame:
    """Springs and upthrusts: pokes out of a range of at most eight scales that close back inside."""
    past = series().rowsBetween(-window, -1)
    b = _sized(bars).withColumns({"top": F.max("high").over(past), "bottom": F.min("low").over(past)})
    b = b.where((F.col("i") >= F.greatest(F.lit(window), F.col("n") - recent)) & (F.col("top") - F.col("bottom") <= 8 * F.col("scale")))
    spring = (F.col("low") < F.col("bottom") - 0.2 * F.col("scale")) & (F.col("close") > F.col("bottom"))
    thrust = (F.col("high") > F.col("top") + 0.2 * F.col("scale")) & (F.col("close") < F.col("top"))
    kinds = F.array_compact(F.array(F.when(spring, F.struct(F.lit("spring").alias("type"), F.col("low").alias("lo"), F.col("bottom").alias("hi"))), F.when(thrust, F.struct(F.lit("upthrust").alias("type"), F.col("top").alias("lo"), F.col("high").alias("hi")))))
    found = b.select(*SERIES, "i", F.explode(kinds).alias("x")).select("*", "x.*")
    found = found.withColumn("place", F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("i"), F.desc("type"))))
    return found.where(F.col("place") <= most).select(*SERIES, "type", "i", F.col("lo").alias("low"), F.col("hi").alias("high"))


def order_blocks(bars: DataFrame, events: DataFrame, most: int = 6) -> DataFrame:
    """The last candle against the direction of each break, from 30 bars before the broken swing: (..., direction, i, low, high, status)."""
    future = series().rowsBetween(1, Window.unboundedFollowing)
    b = bars.withColumns({"fl": F.min("low").over(future), "fh": F.max("high").over(future)})
    after = b.select(*SERIES, F.col("i").alias("at"), "fl", "fh")
    against = b.select(*SERIES, F.col("i").alias("j"), "low", "high", F.when(F.col("close") < F.col("open"), "bullish").when(F.col("close") > F.col("open"), "bearish").alias("direction"))
    e = events.withColumnRenamed("i", "at")
    near = e.join(against, [*SERIES, "direction"]).where((F.col("j") < F.col("at")) & (F.col("j") > F.greatest(F.lit(0), F.col("broken_idx") - 30)))
    found = near.groupBy(*SERIES, "direction", "at").agg(F.max("j").alias("i"), F.max_by("low", "j").alias("low"), F.max_by("high", "j").alias("high")).join(after, [*SERIES, "at"])
    touched = F.coalesce(F.when(F.col("direction") == "bullish", F.col("fl") <= F.col("high")).otherwise(F.col("fh") >= F.col("low")), F.lit(False))
    found = found.withColumn("place", F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("at"), F.asc("direction")))).where(F.col("place") <= most)
    return found.select(*SERIES, "direction", F.col("at").alias("break_i"), "i", "low", "high", F.when(touched, "mitigated").otherwise("open").alias("status"))
