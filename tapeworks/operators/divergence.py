"""Divergences of price and indicators between neighbouring swings of a kind, and Fibonacci levels of the largest leg."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.rolling import last, so_far
from tapeworks.sources.bars import SERIES

RETRACEMENTS, EXTENSIONS = (0.236, 0.382, 0.5, 0.618, 0.786), (1.272, 1.618, 2.0, 2.618)


def divergences(bars: DataFrame, swings: DataFrame, indicators: tuple[str, ...], recent: int = 120) -> DataFrame:
    """(symbol, timeframe, indicator, type, idx1, idx2, ind1, ind2, signal_i, strength), from columns of ``bars``.

    Two swings of a kind, 5 to 80 bars apart, are compared by price, in scales, and by the indicator's extreme within
    three bars of each but not after it is confirmed, in deviations of its last 100 values (20 at least, else of all so
    far). Opposite moves of 0.25 scales and 0.15 deviations count. Each swing meets seven bars at most.
    """
    named = {x: F.struct(F.lit(x).alias("indicator"), F.col(x).alias("v"), F.coalesce(F.nullif(F.when(F.count(x).over(last(100)) >= 20, F.stddev_samp(x).over(last(100))), F.lit(0.0)), F.stddev_pop(x).over(so_far())).alias("d")) for x in indicators}
    sized = bars.withColumns({f"_{x}": s for x, s in named.items()}).withColumn("n", F.count("*").over(Window.partitionBy(*SERIES)))
    long = sized.select(*SERIES, "i", "n", "scale", F.explode(F.array(*(f"_{x}" for x in indicators))).alias("x")).select(*SERIES, "i", "n", "scale", "x.*")
    known = swings.where("not provisional").select(*SERIES, "kind", "idx", "price", "confirmed_idx")
    near = known.withColumn("i", F.explode(F.sequence(F.greatest(F.lit(0), F.col("idx") - 3), F.least(F.col("idx") + 3, F.col("confirmed_idx")))))
    met = near.join(long, [*SERIES, "i"]).groupBy(*SERIES, "indicator", "kind", "idx", "price", "confirmed_idx").agg(
        F.when(F.first("kind") == "L", F.min("v")).otherwise(F.max("v")).alias("v"), F.max(F.when(F.col("i") == F.col("idx"), F.col("d"))).alias("d"), F.max(F.when(F.col("i") == F.col("idx"), F.col("scale"))).alias("scale"), F.max("n").alias("n")
    )
    w = Window.partitionBy(*SERIES, "indicator", "kind").orderBy("idx")
    pairs = met.withColumns({"idx1": F.lag("idx").over(w), "v1": F.lag("v").over(w), "price1": F.lag("price").over(w)})
    pairs = pairs.withColumns({"dp": (F.col("price") - F.col("price1")) / F.col("scale"), "di": (F.col("v") - F.col("v1")) / F.nullif(F.col("d"), F.lit(0.0)), "gap": F.col("idx") - F.col("idx1")})
    pairs = pairs.where(F.col("gap").between(5, 80) & (F.col("confirmed_idx") >= F.col("n") - 1 - recent) & (F.abs("dp") >= 0.25) & (F.abs("di") >= 0.15) & (F.col("dp") * F.col("di") < 0))
    falls = F.col("dp") < 0
    kind = F.when(F.col("kind") == "L", F.when(falls, "regular_bullish").otherwise("hidden_bullish")).otherwise(F.when(falls, "hidden_bearish").otherwise("regular_bearish"))
    strength = 25 * F.least(F.abs("di"), F.lit(2.0)) + 50 * F.least(F.abs("dp"), F.lit(3.0)) / 3
    return pairs.select(*SERIES, "indicator", kind.alias("type"), "idx1", F.col("idx").alias("idx2"), F.col("v1").alias("ind1"), F.col("v").alias("ind2"), F.col("confirmed_idx").alias("signal_i"), strength.alias("strength"))


def fibonacci(bars: DataFrame, swings: DataFrame, recent: int = 8) -> DataFrame:
    """The levels of the largest move between neighbours among the last ``recent`` swings and the running one: a row for each.

    (symbol, timeframe, kind, ratio, price, start_idx, end_idx, nearest); of equal moves the first counts.
    """
    w = Window.partitionBy(*SERIES)
    place = F.count_if(~F.col("provisional")).over(w) - F.count_if(~F.col("provisional")).over(w.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    few = swings.withColumn("place", place).where(F.col("provisional") | (F.col("place") < recent))
    legs = few.withColumns({c: F.lead(f, 1).over(w.orderBy("k")) for c, f in (("end_idx", "idx"), ("end", "price"))}).where("end is not null")
    size = F.struct(F.abs(F.col("end") - F.col("price")), -F.col("k"))
    leg = legs.groupBy(*SERIES).agg(*(F.max_by(c, size).alias(n) for c, n in (("idx", "start_idx"), ("end_idx", "end_idx"), ("price", "a"), ("end", "b"))))
    table = [("retracement", r) for r in RETRACEMENTS] + [("extension", r) for r in EXTENSIONS]
    ratios = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(r).alias("ratio"), F.lit(j).alias("j")) for j, (k, r) in enumerate(table))))
    levels = leg.withColumn("x", ratios).select("*", "x.*")
    levels = levels.withColumn("price", F.when(F.col("kind") == "retracement", F.col("b") - F.col("ratio") * (F.col("b") - F.col("a"))).otherwise(F.col("a") + F.col("ratio") * (F.col("b") - F.col("a"))))
    close = bars.groupBy(*SERIES).agg(F.max_by("close", "i").alias("close"))
    ranked = levels.join(close, SERIES).withColumn("place", F.row_number().over(w.orderBy(F.abs(F.round("price", 4) - F.col("close")), "j")))
    return ranked.select(*SERIES, "kind", "ratio", "price", "start_idx", "end_idx", (F.col("place") == 1).alias("nearest"))
