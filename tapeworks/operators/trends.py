"""The trend of each timeframe from its newest bar, and of a symbol from its timeframes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.rolling import before, mean
from tapeworks.operators import swings
from tapeworks.operators.recursive import recursive, zigzag
from tapeworks.sources.bars import SERIES

# The weight of each part of a timeframe's score, and of each timeframe.
PARTS = {"price": 2.0, "stack": 2.0, "slope": 1.5, "structure": 2.0, "macd_part": 1.0, "rsi_part": 1.0}
TIMEFRAMES = {"1M": 1.5, "1w": 2.0, "1d": 2.0, "1h": 1.0, "15m": 0.5}


def _sign(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(-1.0)


def assess(bars: DataFrame) -> DataFrame:
    """(symbol, timeframe, bars, score, trend, strength, structure): a row for each series of 20 bars at least.

    The averages are of 50 and 200 bars, of 20 and 50 under 220 bars, of 10 and 20 under 60. A weak ADX dampens the
    score, from -100 to 100; 30 is a trend, 65 a strong one.
    """
    c = F.col
    b = recursive(bars, "rsi", "macd", "macd_signal", "adx").withColumn("n", F.count("*").over(Window.partitionBy(*SERIES)))
    b = b.withColumns({f"_s{p}": mean(c("close"), p) for p in (10, 20, 50, 200)}).withColumns({f"_b{p}": before(c(f"_s{p}"), 5) for p in (20, 50, 200)})
    b = b.where((c("i") == c("n") - 1) & (c("n") >= 20))
    pick = lambda long, middle, short: F.when(c("n") >= 220, c(long)).when(c("n") >= 60, c(middle)).otherwise(c(short))
    b = b.withColumns({"fast": pick("_s50", "_s20", "_s10"), "slow": pick("_s200", "_s50", "_s20"), "past": pick("_b200", "_b50", "_b20")})
    enough = c("n") - F.when(c("n") >= 220, 200).when(c("n") >= 60, 50).otherwise(20) + 1 > 6
    labels = swings.trend(zigzag(bars).where("not provisional")).withColumnRenamed("trend", "structure_of")
    b = b.join(labels, SERIES, "left").withColumn("structure_of", F.coalesce("structure_of", F.lit("undetermined")))
    known = c("slow").isNotNull()
    clip = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    b = b.withColumns({
        "price": F.when(known, _sign(c("close") > c("slow"))),
        "stack": F.when(known, _sign(c("fast") > c("slow"))),
        "slope": F.when(known, F.when(enough, clip((c("slow") - c("past")) / c("past") * 100)).otherwise(0.0)),
        "structure": F.when(c("structure_of") == "uptrend", 1.0).when(c("structure_of") == "downtrend", -1.0).otherwise(0.0),
        "macd_part": F.when(c("macd").isNotNull(), 0.5 * _sign(F.coalesce(c("macd") > c("macd_signal"), F.lit(False))) + 0.5 * _sign(c("macd") > 0)),
        "rsi_part": F.when(c("rsi").isNotNull(), clip((c("rsi") - 50) / 20)),
    })
    add = lambda terms: reduce(lambda x, y: x + y, terms)
    raw = add(F.coalesce(c(p) * w, F.lit(0.0)) for p, w in PARTS.items()) / add(F.when(c(p).isNotNull(), w).otherwise(0.0) for p, w in PARTS.items())
    damp = F.when(c("adx").isNotNull(), 0.7 + 0.3 * F.least(F.lit(1.0), c("adx") / 25)).otherwise(1.0)
    b = b.withColumn("score", F.round(100 * raw * damp, 1))
    trend = F.when(c("score") >= 30, "bullish").when(c("score") <= -30, "bearish").otherwise("neutral")
    strength = F.when(F.abs("score") >= 65, "strong").when(F.abs("score") >= 30, "moderate").otherwise("weak")
    return b.select(*SERIES, c("n").alias("bars"), "score", trend.alias("trend"), strength.alias("strength"), c("structure_of").alias("structure"))


def combine(trends: DataFrame) -> DataFrame:
    """(symbol, alignment, alignment_score) from the timeframes of ``assess``: months, weeks and days decide how strong it can be."""
    weight = F.create_map(*(F.lit(x) for pair in TIMEFRAMES.items() for x in pair))
    rows = trends.withColumn("w", F.try_element_at(weight, "timeframe")).where("w is not null")
    high = F.col("timeframe").isin("1M", "1w", "1d")
    each = rows.groupBy("symbol").agg(
        (F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("s"), F.count_if(high).alias("n"),
        F.count_if(high & (F.col("trend") == "bullish")).alias("up"), F.count_if(high & (F.col("trend") == "bearish")).alias("down"),
    )
    s, n, up, down = (F.col(x) for x in ("s", "n", "up", "down"))
    align = F.when((s >= 55) & (n > 0) & (up == n), "strong_bullish").when((s >= 20) & (down == 0), "moderate_bullish").when((s <= -55) & (n > 0) & (down == n), "strong_bearish").when((s <= -20) & (up == 0), "moderate_bearish").otherwise("mixed")
    return each.select("symbol", align.alias("alignment"), F.round("s", 1).alias("alignment_score"))
