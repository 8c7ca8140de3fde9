"""Alert rules over the newest bar of each series, and hits that are reported once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.rolling import before, mean, over
from tapeworks.operators import levels
from tapeworks.operators.recursive import recursive, zigzag
from tapeworks.sources.bars import SERIES

#: A rule: its condition, the level or factor it needs, and the averages that it compares.
RULE = "rule_id long, symbol string, condition string, level double, factor double, fast int, slow int"
#: Conditions that ``signals`` answers.
BY_ANALYSIS = ("break_resistance", "break_support", "pattern_confirmed", "pattern_invalidated", "bullish_rsi_divergence", "bearish_macd_divergence", "breakout_retest", "bullish_reversal", "bearish_reversal")


def newest(bars: DataFrame, averages: tuple[int, ...] = (50, 200)) -> DataFrame:
    """A row for each series: its last bar, the close before, and averages now and then."""
    smas = {f"sma_{p}": mean(F.col("close"), p) for p in averages}
    b = bars.withColumns({**smas, "rel_volume": over(F.col("volume"), mean(F.col("volume"), 20, skip=1)), "prev": before(F.col("close"))})
    b = b.withColumns({f"prev_sma_{p}": before(F.col(f"sma_{p}")) for p in averages})
    return b.withColumn("n", F.count("*").over(Window.partitionBy(*SERIES))).where("i = n - 1")


def broken_zones(bars: DataFrame) -> DataFrame:
    """(symbol, timeframe, condition, pattern_id, price) where the last two closes are on both sides of the nearest zone of the bars before the last."""
    c = F.col
    past = bars.withColumn("n", F.count("*").over(Window.partitionBy(*SERIES))).where("i < n - 1").select(*SERIES, "i", "open", "high", "low", "close", "volume")
    past = recursive(past, "scale")
    zones = levels.zones(past, zigzag(past)).where("immediate").groupBy(*SERIES).agg(F.max(F.when(c("kind") == "resistance", c("high"))).alias("top"), F.max(F.when(c("kind") == "support", c("low"))).alias("bottom"))
    now = bars.withColumns({"n": F.count("*").over(Window.partitionBy(*SERIES)), "prev": before(c("close"))}).where("i = n - 1").join(zones, SERIES)
    kinds = F.array_compact(F.array(F.when((c("close") > c("top")) & (c("prev") <= c("top")), "break_resistance"), F.when((c("close") < c("bottom")) & (c("prev") >= c("bottom")), "break_support")))
    return now.select(*SERIES, F.explode(kinds).alias("condition"), F.lit(None).cast("string").alias("pattern_id"), c("close").alias("price"))


def fired_patterns(found: DataFrame) -> DataFrame:
    """(symbol, timeframe, condition, pattern_id, price) of patterns, with ``current``, that confirm or end at the newest bar, or are retested."""
    c = F.col
    fresh, turned = c("confirmation_idx") == c("last"), c("category") == "reversal"
    kinds = {
        "pattern_confirmed": (fresh, c("level")), "bullish_reversal": (fresh & turned & (c("direction") == "bullish"), c("level")), "bearish_reversal": (fresh & turned & (c("direction") == "bearish"), c("level")),
        "pattern_invalidated": (c("current") & c("stage").isin("failed", "invalidated") & (c("end_idx") == c("last")), c("inval")), "breakout_retest": (c("current") & (c("stage") == "retesting"), c("level")),
    }
    entries = F.array_compact(F.array(*(F.when(x, F.struct(F.lit(name).alias("condition"), price.alias("price"))) for name, (x, price) in kinds.items())))
    return found.select(*SERIES, "pattern_id", F.explode(entries).alias("x")).select(*SERIES, "x.condition", "pattern_id", "x.price")


def fired_divergences(bars: DataFrame, diverged: DataFrame) -> DataFrame:
    """(symbol, timeframe, condition, pattern_id, price) of regular divergences that are known at the newest bar."""
    c = F.col
    newest_bar = bars.groupBy(*SERIES).agg(F.max("i").alias("signal_i"), F.max_by("close", "i").alias("price"))
    kind = F.when((c("indicator") == "rsi") & (c("type") == "regular_bullish"), "bullish_rsi_divergence").when((c("indicator") == "macd") & (c("type") == "regular_bearish"), "bearish_macd_divergence")
    return diverged.join(newest_bar, [*SERIES, "signal_i"]).select(*SERIES, kind.alias("condition"), F.lit(None).cast("string").alias("pattern_id"), "price").where("condition is not null")


def signals(bars: DataFrame, found: DataFrame, diverged: DataFrame) -> DataFrame:
    """What the newest bar of each series triggers among BY_ANALYSIS: (symbol, timeframe, condition, pattern_id, price)."""
    return broken_zones(bars).unionByName(fired_patterns(found)).unionByName(fired_divergences(bars, diverged))


def evaluate_signals(bars: DataFrame, rules: DataFrame, fired: DataFrame, state: DataFrame | None = None, least_bars: int = 30) -> DataFrame:
    """``evaluate`` for rules of BY_ANALYSIS, which may name a ``pattern_id``: (rule_id, symbol, timeframe, i, condition, status, price).

    ``state(symbol, timeframe, stale, synthetic)``, if given, makes series stale that are old and not synthetic.
    """
    c = F.col
    now = bars.groupBy(*SERIES).agg(F.max("i").alias("i"))
    rows = rules.where(c("condition").isin(*BY_ANALYSIS)).join(now, "symbol", "left")
    ours = fired.select(*SERIES, "condition", c("pattern_id").alias("_pattern"), "price")
    met = rows.join(ours, [*SERIES, "condition"]).where(c("pattern_id").isNull() | (c("condition") != "pattern_confirmed") | (c("pattern_id") == c("_pattern")))
    hits = met.groupBy("rule_id", *SERIES).agg(F.min("price").alias("price"), F.lit(True).alias("hit"))
    rows = rows.join(hits, ["rule_id", *SERIES], "left")
    stale = F.lit(False)
    if state is not None:
        rows = rows.join(state.select(*SERIES, "stale", "synthetic"), SERIES, "left")
        stale = F.coalesce(c("stale") & ~F.coalesce("synthetic", F.lit(False)), F.lit(False))
    status = F.when(c("i").isNull(), "no_data").when(stale, "stale").when(c("i") + 1 < least_bars, "short_history").when(c("hit"), "hit").otherwise("no_hit")
    return rows.select("rule_id", "symbol", "timeframe", "i", "condition", status.alias("status"), "price")


def completed(bars: DataFrame) -> DataFrame:
    """``bars`` without a last one that is not ``complete``."""
    return bars.where(F.coalesce("complete", F.lit(True))) if "complete" in bars.columns else bars


def met() -> Column:
    """Whether a rule's condition holds, over rows with the columns of RULE and of ``newest``; null where it can't be told.

    A price has to cross its level between the last two closes; an average is crossed if the difference changes its sign.
    """
    c = F.col
    value = lambda which, form: reduce(lambda rest, p: F.when(c(which) == p, c(form.format(p))).otherwise(rest), (50, 200), F.lit(None))
    crossed = lambda f, s, pf, ps: F.coalesce((f - s) * (pf - ps) < 0, F.lit(False))
    return (
        F.when(c("condition") == "price_above", (c("close") > c("level")) & (c("prev") <= c("level")))
        .when(c("condition") == "price_below", (c("close") < c("level")) & (c("prev") >= c("level")))
        .when(c("condition") == "cross_sma50", crossed(c("close"), c("sma_50"), c("prev"), c("prev_sma_50")))
        .when(c("condition") == "cross_sma200", crossed(c("close"), c("sma_200"), c("prev"), c("prev_sma_200")))
        .when(c("condition") == "ma_crossover", crossed(value("fast", "sma_{}"), value("slow", "sma_{}"), value("fast", "prev_sma_{}"), value("slow", "prev_sma_{}")))
        .when(c("condition") == "unusual_volume", c("rel_volume") >= F.coalesce("factor", F.lit(2.0)))
    )


def evaluate(bars: DataFrame, rules: DataFrame, least_bars: int = 30, state: DataFrame | None = None) -> DataFrame:
    """(rule_id, symbol, timeframe, i, condition, status, price): a row for each rule and series of its symbol.

    ``status``: ``no_data``, ``stale`` (by ``state``, see ``evaluate_signals``), ``short_history`` (fewer than
    ``least_bars``), ``hit`` or ``no_hit``, see ``met``. A last bar that is not ``complete``, if there is such a column, is left out.
    """
    c = F.col
    now = newest(completed(bars))
    rows = rules.join(now, "symbol", "left")
    hit = met()
    stale = F.lit(False)
    if state is not None:
        rows = rows.join(state.select(*SERIES, "stale", "synthetic"), SERIES, "left")
        stale = F.coalesce(c("stale") & ~F.coalesce("synthetic", F.lit(False)), F.lit(False))
    status = F.when(c("n").isNull(), "no_data").when(stale, "stale").when(c("n") < least_bars, "short_history").when(hit, "hit").otherwise("no_hit")
    return rows.select("rule_id", "symbol", "timeframe", "i", "condition", status.alias("status"), c("close").alias("price"))


def unreported(hits: DataFrame, reported: DataFrame) -> DataFrame:
    """Hits whose (rule_id, condition, symbol, i) is not among ``reported``, each once."""
    key = ["rule_id", "condition", "symbol", "timeframe", "i"]
    return hits.where("status = 'hit'").dropDuplicates(key).join(reported.select(*key).distinct(), key, "left_anti")
