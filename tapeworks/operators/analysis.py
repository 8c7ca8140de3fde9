"""The report on a series: indicators of its newest bar, setups, a score of how its signs agree, and flags to scan for.

Every function takes tables of all series and returns one row (or a few) for each, so that a universe is one job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.rolling import before, series
from tapeworks.operators import candles, divergence, indicators, levels, patterns, trends
from tapeworks.operators.recursive import recursive, zigzag
from tapeworks.session import stored, stored_together
from tapeworks.sources.bars import SERIES

SMAS, EMAS = (10, 20, 50, 100, 200), (9, 20, 50, 100, 200)
VOLUME_COLUMNS = ("vol_sma", "rel_volume", "obv", "ad", "cmf", "mfi", "vol_dry_up", "vol_price_div")
INTRADAY = ("5m", "15m", "1h")
# Weights of the score's parts and of timeframes in it, factors of stages in score and setups, cuts of the rating.
WEIGHTS = {"htf_trend": 20, "pattern": 20, "momentum": 15, "volume": 15, "sr_alignment": 15, "risk_reward": 15}
HIGHER = {"1M": 1.0, "1w": 1.5, "1d": 1.0}
STAGE_FACTOR = {"confirmed": 1.0, "retesting": 1.0, "approaching_confirmation": 0.6, "forming": 0.3, "failed": -0.5, "invalidated": 0.0}
STAGE_WEIGHT = {"confirmed": 1.0, "retesting": 1.0, "approaching_confirmation": 0.8, "forming": 0.55}
LEAST_RATIO, STOP_BUFFER, STOP_SCALES, EXTENDED, WIDE_STOP, DAILY_LIMIT = 2.0, 0.2, 2.0, 2.0, 6.0, 7.5


def _mapped(table: dict, key: Column) -> Column:
    return F.coalesce(*(F.when(key == k, F.lit(v)) for k, v in table.items()))


def _add(terms) -> Column:
    return reduce(lambda x, y: x + y, terms)


def _clip(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def indicator_frame(bars: DataFrame) -> DataFrame:
    """``bars`` with the columns of all indicators; those that need volume are null for series without any, ``vwap`` for days and longer."""
    b = recursive(bars, *(f"ema_{p}" for p in EMAS), "rsi", "macd", "macd_signal", "macd_hist", "atr", "scale", "kc_mid", "kc_upper", "kc_lower", "adx", "plus_di", "minus_di", "supertrend", "supertrend_dir", "psar")
    steps = (
        indicators.stochastic, indicators.stochastic_rsi, indicators.rate_of_change, indicators.momentum, indicators.commodity_channel, indicators.williams_r, indicators.bollinger, indicators.bollinger_squeeze, indicators.donchian,
        indicators.historical_volatility, indicators.ichimoku, indicators.linear_regression, indicators.volume_averages, indicators.on_balance_volume, indicators.accumulation, indicators.money_flow, indicators.money_flow_index,
        indicators.volume_dry_up, indicators.volume_price_divergence, indicators.session_vwap,
    )
    b = reduce(lambda df, f: f(df), steps, indicators.sma(b, SMAS))
    traded = F.coalesce(F.sum("volume").over(Window.partitionBy(*SERIES)) > 0, F.lit(False))
    b = b.withColumn("has_volume", traded)
    return b.withColumns({c: F.when(F.col("has_volume"), F.col(c)) for c in VOLUME_COLUMNS} | {"vwap": F.when(F.col("has_volume") & F.col("timeframe").isin(*INTRADAY), F.col("vwap"))})


def availability(bars: DataFrame) -> DataFrame:
    """(symbol, timeframe, column, reason): averages that a series is too short for, and what it has no volume or no intraday bars for."""
    c = F.col
    n = bars.groupBy(*SERIES).agg(F.count("*").alias("n"), F.coalesce(F.sum("volume") > 0, F.lit(False)).alias("has_volume"))
    entry = lambda name, reason: F.struct(F.lit(name).alias("column"), reason.alias("reason"))
    short = [F.when(c("n") < p, entry(f"{kind}_{p}", F.format_string("needs %d bars, has %d", F.lit(p), c("n")))) for kind, periods in (("sma", SMAS), ("ema", EMAS)) for p in periods]
    silent = [F.when(~c("has_volume"), entry(x, F.lit("no volume"))) for x in ("vol_sma", "rel_volume", "obv", "ad", "cmf", "mfi", "vwap")]
    daily = F.when(c("has_volume") & ~c("timeframe").isin(*INTRADAY), entry("vwap", F.lit("needs intraday bars")))
    return n.select(*SERIES, F.explode(F.array_compact(F.array(*short, *silent, daily))).alias("x")).select(*SERIES, "x.*")


def snapshot(frame: DataFrame) -> DataFrame:
    """A row for each series: what the indicators of its newest bar say. ``frame`` is an ``indicator_frame``."""
    c = F.col

    def direction(name: str, bars: int) -> Column:
        d = c(name) - before(c(name), bars)
        return F.when(d > 0, "rising").when(d < 0, "falling").when(d.isNotNull(), "flat")

    d50 = c("sma_50") - c("sma_200")
    b = frame.withColumns({
        "n": F.count("*").over(Window.partitionBy(*SERIES)), "prev": before(c("close")), "rsi_direction": direction("rsi", 3), "obv_direction": direction("obv", 10), "hist_before": before(c("macd_hist")), "hist_direction": direction("macd_hist", 1),
        "cross_now": d50, "cross_then": before(d50, 5), "rsi_least": F.min("rsi").over(series().rowsBetween(-5, -1)), "rsi_known": F.count("rsi").over(series().rowsBetween(-5, 0)),
    }).where("i = n - 1")
    known = c("macd").isNotNull() & c("macd_signal").isNotNull()
    return b.select(
        *SERIES, "n", "close", (100 * (c("close") / c("prev") - 1)).alias("change_pct"), "scale", "atr", (100 * c("atr") / c("close")).alias("atr_pct"), "hv", "has_volume",
        *(F.when(c(x).isNotNull(), c("close") > c(x)).alias(f"above_{x}") for x in ("sma_20", "sma_50", "sma_100", "sma_200", "ema_20", "ema_50", "ema_100", "ema_200")),
        "rsi", "rsi_direction", F.when(c("rsi") >= 70, "overbought").when(c("rsi") <= 30, "oversold").when(c("rsi").isNotNull(), "neutral").alias("rsi_zone"),
        "macd", "macd_signal", "macd_hist", F.when(known, F.when(c("macd") > c("macd_signal"), "above_signal").otherwise("below_signal")).alias("macd_state"), F.when(known, F.when(c("macd") > 0, "above").otherwise("below")).alias("macd_zero"),
        F.when((c("macd_hist") > 0) & (c("hist_before") <= 0), "bullish_cross_this_bar").when((c("macd_hist") < 0) & (c("hist_before") >= 0), "bearish_cross_this_bar").alias("macd_cross"), "hist_direction",
        "bb_upper", "bb_lower", "bb_mid", "bb_pct_b", "bb_squeeze", F.when(c("close") > c("bb_upper"), "above_upper").when(c("close") < c("bb_lower"), "below_lower").when(c("bb_pct_b") >= 0.5, "upper_half").when(c("bb_upper").isNotNull(), "lower_half").alias("bb_position"),
        "rel_volume", "obv_direction", "cmf", "adx", "plus_di", "minus_di", F.when(c("adx") >= 25, "strong").when(c("adx") >= 20, "developing").when(c("adx").isNotNull(), "weak").alias("adx_strength"),
        ((c("cross_now") > 0) & (c("cross_then") <= 0) & (c("n") > 205)).alias("golden_cross"), ((c("cross_now") < 0) & (c("cross_then") >= 0) & (c("n") > 205)).alias("death_cross"), ((c("rsi_known") == 6) & (c("rsi_least") < 30) & (c("rsi") >= 30)).alias("oversold_recovery"),
    )


def reward_risk(sgn: Column, entry: Column, stop: Column, target: Column) -> Column:
    """Reward over risk to two decimals; null unless both are positive."""
    risk, reward = sgn * (entry - stop), sgn * (target - entry)
    return F.when((risk > 0) & (reward > 0), F.round(reward / risk, 2))


def setups(now: DataFrame, found: DataFrame, zones: DataFrame, fib: DataFrame) -> DataFrame:
    """A long and a short setup for each series of ``now`` (a ``snapshot`` or ``newest``): entry, stop, targets, ratio, confidence.

    The best open pattern of the side's direction among the ``current`` of ``found`` gives entry and stop, else the
    zones on both sides of the price. Targets are up to two zones ahead, the measured move and the first Fibonacci level,
    at least half a scale from the entry and from each other. Without pattern and zones, or with a stop on the wrong
    side of the entry, a setup is not ``valid``.
    """
    c, s = F.col, F.col("sgn")
    sides = now.select(*SERIES, "n", "close", "scale", F.explode(F.array(F.struct(F.lit("long").alias("side"), F.lit(1.0).alias("sgn")), F.struct(F.lit("short").alias("side"), F.lit(-1.0).alias("sgn")))).alias("x")).select(*SERIES, "n", "close", "scale", "x.*")
    open_ = found.where(c("current") & c("stage").isin(*patterns.ACTIVE) & c("level").isNotNull() & c("inval").isNotNull() & c("target").isNotNull() & ~c("target_reached") & c("direction").isin("bullish", "bearish") & (c("confirmation_idx").isNull() | (c("last") - c("confirmation_idx") <= 30)))
    open_ = open_.withColumn("sgn", F.when(c("direction") == "bullish", 1.0).otherwise(-1.0)).join(now.select(*SERIES, "close", "scale"), SERIES)
    tired = c("confirmation_idx").isNotNull() & (s * (c("close") - c("level")) > EXTENDED * c("scale"))
    worth = c("quality") * _mapped(STAGE_WEIGHT, c("stage")) * F.when(c("experimental"), 0.8).otherwise(1.0) * F.when(tired, 0.6).otherwise(1.0)
    best = F.max_by(F.struct("pattern_id", "stage", "level", "inval", "target", "quality", "confirmation_idx"), F.struct(worth, c("quality"), -c("end_idx"), -c("start_idx")))
    picked = open_.groupBy(*SERIES, "sgn").agg(best.alias("p"))
    listed = zones.groupBy(*SERIES).agg(F.sort_array(F.collect_list(F.struct("mid", "low", "high"))).alias("zones"))  # a dozen at most
    lines = fib.groupBy(*SERIES).agg(F.sort_array(F.collect_list("price")).alias("fib"))  # nine
    rows = sides.join(picked, [*SERIES, "sgn"], "left").join(listed, SERIES, "left").join(lines, SERIES, "left")
    rows = rows.withColumns({"zones": F.coalesce("zones", F.expr("cast(array() as array<struct<mid:double,low:double,high:double>>)")), "fib": F.coalesce("fib", F.array().cast("array<double>"))})
    long, above, below = s > 0, F.filter("zones", lambda z: z["mid"] > c("close")), F.reverse(F.filter("zones", lambda z: z["mid"] < c("close")))
    rows = rows.withColumns({"ahead": F.when(long, above).otherwise(below), "behind": F.when(long, below).otherwise(above), "fib": F.when(long, c("fib")).otherwise(F.reverse("fib"))})
    has, first, rear = c("p").isNotNull(), F.try_element_at("ahead", F.lit(1)), F.try_element_at("behind", F.lit(1))
    sure = c("p.stage").isin("confirmed", "retesting")
    rows = rows.withColumns({"trigger": F.when(has, c("p.level")).otherwise(F.when(long, first["high"]).otherwise(first["low"])), "beyond": F.when(has, c("p.inval")).otherwise(F.when(long, rear["low"]).otherwise(rear["high"]))})
    far = s * (c("close") - c("trigger")) > EXTENDED * c("scale")
    step = lambda share: c("trigger") + s * share * c("scale")
    entry = F.when(has & sure, F.when(far, step(0.25)).otherwise(c("close"))).otherwise(step(0.1))
    rows = rows.withColumns({"entry": entry, "stop": c("beyond") - s * STOP_BUFFER * c("scale"), "status": F.when(has & sure, F.when(far, "extended").otherwise("actionable")).otherwise("watch"), "structured": has | (first.isNotNull() & rear.isNotNull())})
    rows = rows.withColumn("valid", c("structured") & F.coalesce(s * (c("entry") - c("stop")) > 0, F.lit(False)))

    half, away = 0.5 * c("scale"), lambda x: s * (x - c("entry"))
    target = lambda price, source: F.struct((s * price).alias("order"), price.alias("price"), F.lit(source).alias("source"))
    front = F.transform(F.slice("ahead", 1, 2), lambda z: F.when(long, z["low"]).otherwise(z["high"]))
    zone_targets = F.transform(F.filter(front, lambda x: away(x) > half), lambda x: target(x, "zone"))
    measured = F.array_compact(F.array(F.when(has & (away(c("p.target")) > 0), target(c("p.target"), "measured"))))
    line = F.try_element_at(F.filter("fib", lambda x: (s * (x - c("close")) > 0) & (away(x) > 0)), F.lit(1))
    fib_target = F.array_compact(F.array(F.when(line.isNotNull(), target(line, "fib"))))
    all_targets = F.sort_array(F.concat(zone_targets, measured, fib_target))
    apart = lambda acc, x: F.when((away(x["price"]) < half) | (F.size(acc) >= 3) | F.exists(acc, lambda y: F.abs(x["price"] - y["price"]) < half), acc).otherwise(F.array_append(acc, x))
    rows = rows.withColumn("chosen", F.aggregate(all_targets, F.filter(all_targets, lambda x: F.lit(False)), apart))
    moved = F.try_element_at(F.filter("chosen", lambda t: t["source"] == "measured"), F.lit(1))
    rows = rows.withColumn("primary", F.coalesce(moved, F.try_element_at("chosen", F.lit(-1))))
    rows = rows.withColumns({"status": F.when(~c("valid"), "invalid").when(has & (s * (c("close") - c("p.target")) >= 0), "target_reached").otherwise(c("status")), "primary_rr": F.when(c("valid"), reward_risk(s, c("entry"), c("stop"), c("primary.price")))})
    meets = F.coalesce(c("primary_rr") >= LEAST_RATIO, F.lit(False))
    confidence = F.when(has, c("p.quality") * _mapped(STAGE_WEIGHT, c("p.stage"))).otherwise(35.0) * F.when(meets, 1.0).otherwise(0.8)
    of = lambda x: F.when(c("valid"), x)
    away_stop = F.abs(c("entry") - c("stop"))
    risks = F.array_compact(F.array(
        F.when(away_stop / c("scale") > WIDE_STOP, "wide_stop"), F.when(away_stop / c("entry") * 100 > DAILY_LIMIT, "stop_beyond_daily_limit"),
        F.when((F.size("chosen") > 0) & (s * (first["mid"] - c("entry")) < s * (F.try_element_at("chosen", F.lit(1))["price"] - c("entry"))), "zone_before_first_target"), F.lit("thin_liquidity"),
    ))
    return rows.select(
        *SERIES, "side", "valid", "status", F.when(has, c("p.pattern_id")).otherwise("structure").alias("basis"), c("p.stage").alias("pattern_stage"), F.when(c("structured"), c("entry")).alias("entry"), F.when(c("structured"), c("stop")).alias("stop"),
        of(F.least(c("trigger"), step(0.5))).alias("entry_low"), of(F.greatest(c("trigger"), step(0.5))).alias("entry_high"), of(c("entry") - s * STOP_SCALES * c("scale")).alias("scale_stop"),
        of(F.transform("chosen", lambda t: F.struct(t["price"].alias("price"), reward_risk(s, c("entry"), c("stop"), t["price"]).alias("ratio"), t["source"].alias("source")))).alias("targets"),
        "primary_rr", (c("valid") & meets).alias("meets_least_ratio"), F.when(c("valid"), F.round(confidence, 1)).otherwise(0.0).alias("confidence"), of(risks).alias("risks"), of(c("trigger")).alias("trigger"),
    )


def score(now: DataFrame, found: DataFrame, zones: DataFrame, made: DataFrame, diverged: DataFrame, assessed: DataFrame) -> DataFrame:
    """(symbol, timeframe, score, rating, coverage, and each part from -1 to 1, null where unknown) of each series of ``now``.

    ``assessed`` are the symbols' timeframes (``trends.assess``), ``made`` the setups, ``diverged`` the divergences.
    Without a recent directional pattern that part is 0, not unknown.
    """
    c = F.col
    higher = assessed.where(c("timeframe").isin(*HIGHER)).withColumn("w", _mapped(HIGHER, c("timeframe")))
    higher = higher.groupBy("symbol").agg((F.sum(c("w") * c("score") / 100) / F.sum("w")).alias("htf_trend"))

    recent = found.where(c("current") & (c("end_idx") >= c("last") - 40) & (c("direction") != "neutral"))
    recent = recent.withColumn("sgn", F.when(c("direction") == "bullish", 1.0).otherwise(-1.0))
    order = [F.desc("active"), F.desc("quality"), F.asc("end_idx"), F.asc("pattern_id"), F.asc("start_idx")]
    recent = recent.withColumn("active", c("stage").isin(*patterns.ACTIVE).cast("int"))
    w = Window.partitionBy(*SERIES)
    sure = c("confirmation_idx").isNotNull() & c("volume_confirmation").isNotNull()
    recent = recent.withColumns({"place": F.row_number().over(w.orderBy(F.desc("quality"), *order)), "sure_place": F.when(sure, F.row_number().over(Window.partitionBy(*SERIES, sure).orderBy(*order)))})
    factor = _mapped(STAGE_FACTOR, c("stage")) * F.when(c("experimental"), 0.6).otherwise(1.0) * F.when(c("target_reached"), 0.3).otherwise(1.0)
    shaped = recent.groupBy(*SERIES).agg(
        _clip(F.sum(F.when(c("place") <= 5, c("sgn") * factor * c("quality") / 100))).alias("pattern"),
        F.sum(F.when(c("sure_place") <= 2, c("sgn") * F.when(c("volume_confirmation"), 0.8).otherwise(-0.2))).alias("sure_sum"), F.count_if(c("sure_place") <= 2).alias("sure_n"),
    )
    late = diverged.where(c("type").startswith("regular")).join(now.select(*SERIES, "n"), SERIES).where(c("signal_i") >= c("n") - 16)
    late = late.withColumn("place", F.row_number().over(w.orderBy(F.desc("signal_i"), F.desc("indicator"), F.desc("idx2")))).where("place <= 2")
    apart = late.groupBy(*SERIES).agg(F.sum(F.when(c("type") == "regular_bullish", 0.8).otherwise(-0.8)).alias("div_sum"), F.count("*").alias("div_n"))
    near = zones.where("immediate").groupBy(*SERIES).agg(F.max(F.when(c("kind") == "support", c("high"))).alias("support"), F.min(F.when(c("kind") == "resistance", c("low"))).alias("resistance"))
    ratios = made.where("valid").groupBy(*SERIES).agg(F.max(F.when(c("side") == "long", c("primary_rr"))).alias("long_rr"), F.max(F.when(c("side") == "short", c("primary_rr"))).alias("short_rr"))
    rows = now
    for table, key in ((higher, ["symbol"]), (shaped, SERIES), (apart, SERIES), (near, SERIES), (ratios, SERIES)):
        rows = rows.join(table, key, "left")

    def average(parts: list[Column], more_sum: Column, more_n: Column) -> Column:
        n = _add([F.when(p.isNotNull(), 1).otherwise(0) for p in parts]) + F.coalesce(more_n, F.lit(0))
        return F.when(n > 0, _clip((_add([F.coalesce(p, F.lit(0.0)) for p in parts]) + F.coalesce(more_sum, F.lit(0.0))) / n))

    rsi = _clip((c("rsi") - 50) / 20) * F.when((c("rsi") >= 75) | (c("rsi") <= 25), 0.5).otherwise(1.0)
    macd = F.when(c("macd_state").isNotNull(), F.when(c("macd_state") == "above_signal", 0.5).otherwise(-0.5) + F.when(c("macd_zero") == "above", 0.5).otherwise(-0.5))
    obv = F.when(c("obv_direction").isNotNull(), _mapped({"rising": 0.6, "falling": -0.6, "flat": 0.0}, c("obv_direction")))
    below, over = (c("close") - c("support")) / c("scale"), (c("resistance") - c("close")) / c("scale")
    level = F.when(below.isNotNull() & over.isNotNull(), _clip((over - below) / F.greatest(over + below, F.lit(1e-9)))).when(below.isNotNull(), 0.5).when(over.isNotNull(), -0.5)
    ratio = _clip((F.coalesce("long_rr", F.lit(0.0)) - F.coalesce("short_rr", F.lit(0.0))) / 3) * F.when(F.round("atr_pct", 2) > 5, 0.6).otherwise(1.0)
    rows = rows.withColumns({
        "htf_trend": F.round("htf_trend", 3), "pattern": F.round(F.coalesce("pattern", F.lit(0.0)), 3), "momentum": F.round(average([rsi, macd], c("div_sum"), c("div_n")), 3),
        "volume": F.when(c("has_volume") & c("rel_volume").isNotNull(), F.round(average([obv, _clip(4 * F.round("cmf", 3))], c("sure_sum"), c("sure_n")), 3)),
        "sr_alignment": F.round(level, 3), "risk_reward": F.when(c("long_rr").isNotNull() | c("short_rr").isNotNull(), F.round(ratio, 3)),
    })
    weight = _add(F.when(c(x).isNotNull(), k).otherwise(0) for x, k in WEIGHTS.items())
    total = _add(F.coalesce(c(x) * k, F.lit(0.0)) for x, k in WEIGHTS.items())
    rows = rows.withColumns({"score": F.round(50 + 50 * total / weight, 1), "coverage": F.round(weight / sum(WEIGHTS.values()), 2)})
    rating = F.when(weight / sum(WEIGHTS.values()) < 0.5, "Neutral").when(c("score") >= 75, "Strong Bullish").when(c("score") >= 60, "Bullish").when(c("score") <= 25, "Strong Bearish").when(c("score") <= 40, "Bearish").otherwise("Neutral")
    return rows.select(*SERIES, "score", rating.alias("rating"), "coverage", *WEIGHTS)


def flags(now: DataFrame, found: DataFrame, zones: DataFrame, diverged: DataFrame, bars: DataFrame, experimental: bool = False, unusual: float = 2.0, near: float = 1.0) -> DataFrame:
    """(symbol, timeframe, flags): the sorted names of what stands out in each series of ``now``."""
    c = F.col
    seen = found.where(c("current") & (F.lit(experimental) | ~c("experimental")))
    moves = bars.withColumn("moved", c("close") - F.first("close").over(series().rowsBetween(-40, 0))).select(*SERIES, c("i").alias("start_idx"), "moved")
    seen = seen.join(moves, [*SERIES, "start_idx"], "left").join(now.select(*SERIES, "atr"), SERIES)
    done, fresh = c("stage").isin("confirmed", "retesting"), (c("stage") == "confirmed") & (c("last") - c("confirmation_idx") <= 5)
    turned = done & (c("category") == "reversal")
    before_it = c("moved") / F.coalesce(F.nullif(F.round("atr", 4), F.lit(0.0)), F.lit(1.0))
    of_pattern = {
        "emerging_pattern": c("stage").isin("forming", "approaching_confirmation"), "confirmed_breakout": fresh & (c("direction") == "bullish"), "confirmed_breakdown": fresh & (c("direction") == "bearish"), "breakout_retest": c("stage") == "retesting",
        "bullish_reversal_after_downtrend": turned & (c("direction") == "bullish") & (before_it <= -3), "bearish_reversal_after_advance": turned & (c("direction") == "bearish") & (before_it >= 3),
    }
    shaped = seen.select(*SERIES, F.explode(F.array_compact(F.array(*(F.when(x, name) for name, x in of_pattern.items())))).alias("flag"))
    major = zones.where("major").join(now, SERIES).where(F.abs(c("mid") - c("close")) <= near * c("atr")).select(*SERIES, F.lit("near_major_level").alias("flag"))
    late = diverged.where(c("type").startswith("regular") & c("indicator").isin("rsi", "macd")).join(now.select(*SERIES, "n"), SERIES).where(c("signal_i") >= c("n") - 10).select(*SERIES, F.concat("indicator", F.lit("_divergence")).alias("flag"))
    of_bar = {"unusual_volume": F.round("rel_volume", 2) >= unusual, "golden_cross": c("golden_cross"), "death_cross": c("death_cross"), "oversold_recovery": c("oversold_recovery")}
    newest = now.select(*SERIES, F.explode(F.array_compact(F.array(*(F.when(x, name) for name, x in of_bar.items())))).alias("flag"))
    every = reduce(DataFrame.unionByName, (shaped, major, late, newest))
    found_flags = every.groupBy(*SERIES).agg(F.array_sort(F.collect_set("flag")).alias("flags"))
    return now.select(*SERIES).join(found_flags, SERIES, "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))


def newest(bars: DataFrame) -> DataFrame:
    """(symbol, timeframe, n, close, scale): the last of each series of ``bars`` with column ``scale``, and how many it has."""
    return bars.withColumn("n", F.count("*").over(Window.partitionBy(*SERIES))).where("i = n - 1").select(*SERIES, "n", "close", "scale")


def _shapes(plain: DataFrame, context: DataFrame, swings: DataFrame, **more: DataFrame) -> dict[str, DataFrame]:
    """Zones, patterns and Fibonacci levels, stored, and ``more`` frames beside them.

    Each detector's candidates are a table and a job of their own: the life of patterns reads candidates twice, and in one
    union of all detectors adaptive execution gives each a single task, whatever its number of series.
    """
    proposed = patterns.proposed(context, swings)
    seen = stored_together(zones=levels.zones(plain, swings), fibonacci=divergence.fibonacci(plain, swings), **more, **proposed)
    found = {d: seen.pop(d) for d in proposed}
    return {**seen, "patterns": stored(patterns.current(patterns.settled(found, context)), "patterns")}


def setups_of(bars: DataFrame) -> DataFrame:
    """The setups of ``bars``, as ``parts_of`` gives them, without what only scores and flags read: indicators, timeframes, divergences.

    ``bars`` are computed once; all else reads the stored ones.
    """
    plain = stored(recursive(bars, "scale"), "plain")
    base = stored_together(context=patterns.context(plain), swings=zigzag(plain))
    seen = _shapes(plain, base["context"], base["swings"])
    return setups(newest(plain), seen["patterns"], seen["zones"], seen["fibonacci"])


def parts_of(bars: DataFrame, timeframes: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables that a report joins, each of all series: frame, now, swings, patterns, zones, divergences, fibonacci, candles, assessed, setups, score, flags.

    Those that several others read are stored tables, so that each is computed once and plans stay small; those that don't
    read one another are written side by side. ``bars`` and ``timeframes`` are read several times: give stored ones.
    """
    first = stored_together(frame=indicator_frame(bars), assessed=trends.assess(timeframes if timeframes is not None else bars))
    frame, assessed = first["frame"], first["assessed"]
    plain = frame.select(*bars.columns, "scale")
    base = stored_together(context=patterns.context(plain), swings=zigzag(plain), now=snapshot(frame))
    context, swings, now = base["context"], base["swings"], base["now"]
    sized = frame.select(*SERIES, "i", "scale", "rsi", "macd", "obv", "mfi")
    seen = _shapes(plain, context, swings, divergences=divergence.divergences(sized, swings, ("rsi", "macd", "obv", "mfi")))
    zones, found, diverged = seen["zones"], seen["patterns"], seen["divergences"]
    made = stored(setups(now, found, zones, seen["fibonacci"]), "setups")
    last = stored_together(score=score(now, found, zones, made, diverged, assessed), flags=flags(now, found, zones, diverged, plain))
    return {"frame": frame, "now": now, "swings": swings, **seen, "candles": candles.detect(plain, zones, all_bars=False), "assessed": assessed, "setups": made, **last}


def best_patterns(found: DataFrame) -> DataFrame:
    """The first of each series' current patterns that are not experimental: active ones before others, then by quality."""
    order = [F.desc(F.col("stage").isin(*patterns.ACTIVE).cast("int")), F.desc("quality"), F.asc("end_idx"), F.asc("pattern_id"), F.asc("start_idx")]
    place = F.row_number().over(Window.partitionBy(*SERIES).orderBy(*order))
    return found.withColumn("place", place).where("place = 1").drop("place")


def scan(
    parts: dict[str, DataFrame], symbols: DataFrame | None = None, pattern_ids: tuple[str, ...] = (), stages: tuple[str, ...] = (), least_score: float | None = None, most_score: float | None = None,
    directions: tuple[str, ...] = (), any_flags: tuple[str, ...] = (), least_ratio: float | None = None, least_bars: int = patterns.LEAST_BARS,
) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): the series of ``parts`` that keep the rules, those with the strongest scores first, and the symbols without an answer.

    ``symbols(symbol)``, each once, limits the scan; those without bars or with fewer than ``least_bars`` are errors, not
    failures.
    """
    c = F.col
    pats = parts["patterns"].where("current and not experimental")
    pats = pats.where(c("pattern_id").isin(*pattern_ids)) if pattern_ids else pats
    pats = pats.where(c("stage").isin(*stages)) if stages else pats
    top = best_patterns(pats).select(*SERIES, "pattern_id", c("stage").alias("pattern_stage"), c("direction").alias("pattern_direction"), c("level").alias("breakout_level"), "volume_confirmation")
    now = parts["now"].select(*SERIES, "n", "close", "rsi", "macd_state")
    wanted = symbols.select("symbol").distinct() if symbols is not None else now.select("symbol").distinct()
    all_rows = wanted.join(now, "symbol", "left")
    errors = all_rows.where(c("n").isNull() | (c("n") < least_bars)).select("symbol", "timeframe", F.when(c("n").isNull(), "no data").otherwise(F.format_string("only %d bars", "n")).alias("error"))
    ratio = parts["setups"].where("valid").select(*SERIES, c("basis").alias("pattern_id"), "primary_rr").groupBy(*SERIES, "pattern_id").agg(F.max("primary_rr").alias("risk_reward"))
    trend = parts["assessed"].select(*SERIES, "trend")
    rows = all_rows.where(c("n") >= least_bars).join(top, SERIES, "left").join(ratio, [*SERIES, "pattern_id"], "left").join(trend, SERIES, "left").join(parts["score"].select(*SERIES, "score", "rating"), SERIES).join(parts["flags"], SERIES)
    rows = rows.withColumn("direction", F.coalesce("pattern_direction", F.when(c("score") >= 60, "bullish").when(c("score") <= 40, "bearish").otherwise("neutral")))
    if pattern_ids or stages:
        rows = rows.where(c("pattern_id").isNotNull())
    for rule, keep in ((least_score, lambda x: c("score") >= x), (most_score, lambda x: c("score") <= x), (least_ratio, lambda x: c("risk_reward") >= x)):
        rows = rows.where(keep(rule)) if rule is not None else rows
    rows = rows.where(c("direction").isin(*directions)) if directions else rows
    rows = rows.where(F.arrays_overlap("flags", F.array(*(F.lit(f) for f in any_flags)))) if any_flags else rows
    rows = rows.select(*SERIES, c("close").alias("price"), F.coalesce("trend", F.lit("n/a")).alias("trend"), "pattern_id", "pattern_stage", "breakout_level", "volume_confirmation", "rsi", c("macd_state").alias("macd"), "direction", "score", "rating", "risk_reward", "flags")
    return rows.orderBy(F.desc(F.abs(c("score") - 50)), "symbol"), errors


def reports(parts: dict[str, DataFrame]) -> DataFrame:
    """One row for each series: price, score, setups, nearest levels, triggers, commentary, and its evidence as JSON.

    A trigger is the level of the best active pattern without a break, else the far side of the nearest zone.
    """
    c = F.col
    waiting = parts["patterns"].where(c("current") & c("confirmation_idx").isNull() & c("stage").isin(*patterns.ACTIVE) & c("direction").isin("bullish", "bearish"))
    trigger = waiting.groupBy(*SERIES).agg(*(F.max_by("level", F.when(c("direction") == d, F.struct("quality", -c("end_idx")))).alias(f"{d}_level") for d in ("bullish", "bearish")))
    near = parts["zones"].where("immediate or major").groupBy(*SERIES).agg(*(F.first(F.when(c(rank) & (c("kind") == kind), F.struct("low", "high", "touches", "strength")), ignorenulls=True).alias(f"{rank}_{kind}") for rank in ("immediate", "major") for kind in ("support", "resistance")))
    side = parts["setups"].groupBy(*SERIES).agg(*(F.first(F.when(c("side") == x, F.struct("valid", "status", "basis", "entry", "stop", "targets", "primary_rr", "meets_least_ratio", "confidence", "trigger", "entry_low", "entry_high")), ignorenulls=True).alias(x) for x in ("long", "short")))
    listed = parts["patterns"].where("current").groupBy(*SERIES).agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct(c("stage").isin(*patterns.ACTIVE).alias("active"), "quality", "pattern_id", "stage", "direction", "level", "target", "inval")))), 1, 8).alias("patterns"))
    aligned = trends.combine(parts["assessed"])
    rows = parts["now"].join(parts["score"].withColumnRenamed("volume", "volume_part"), SERIES).join(parts["flags"], SERIES)
    for table in (trigger, near, side, listed):
        rows = rows.join(table, SERIES, "left")
    rows = rows.join(aligned, "symbol", "left")
    rows = rows.withColumns({"breakout_trigger": F.coalesce("bullish_level", "immediate_resistance.high"), "breakdown_trigger": F.coalesce("bearish_level", "immediate_support.low"), "patterns": F.coalesce("patterns", F.expr("cast(array() as array<struct<active:boolean,quality:double,pattern_id:string,stage:string,direction:string,level:double,target:double,inval:double>>)"))})
    return commented(rows)


def _shown(x: Column) -> Column:
    return F.format_string("%.4g", x.cast("double"))


def commented(rows: DataFrame) -> DataFrame:
    """Report rows with ``summary``, ``conflicts``, ``changes``, ``stay_neutral``, ``conclusion``, all from templates, and ``evidence``."""
    c = F.col
    names = {"htf_trend": "htf_trend", "pattern": "pattern", "momentum": "momentum", "volume": "volume_part", "sr_alignment": "sr_alignment", "risk_reward": "risk_reward"}
    leaning = lambda keep: F.array_join(F.array_compact(F.array(*(F.when(keep(c(x)), name) for name, x in names.items()))), ", ")
    rows = rows.withColumns({"_up": leaning(lambda v: v >= 0.2), "_down": leaning(lambda v: v <= -0.2), "_missing": leaning(lambda v: v.isNull()), "_top": F.try_element_at("patterns", F.lit(1))})
    of = lambda direction: F.try_element_at(F.filter("patterns", lambda p: (p["direction"] == direction) & p["active"]), F.lit(1))
    word = lambda x: F.replace(x, F.lit("_"), F.lit(" "))
    conflicts = F.array_compact(F.array(
        F.when((c("_up") != "") & (c("_down") != ""), F.format_string("Bullish factors (%s) conflict with bearish factors (%s).", "_up", "_down")),
        F.when(of("bullish").isNotNull() & of("bearish").isNotNull(), F.format_string("Competing pattern readings: %s (%s) vs %s (%s).", word(of("bullish")["pattern_id"]), word(of("bullish")["stage"]), word(of("bearish")["pattern_id"]), word(of("bearish")["stage"]))),
        F.when(c("_missing") != "", F.format_string("Unavailable factors (excluded, not assumed favourable): %s.", "_missing")),
    ))
    conflicts = F.concat(conflicts, F.transform(F.slice(F.filter("patterns", lambda p: p["stage"] == "failed"), 1, 2), lambda p: F.format_string("%s failed after confirmation, which counts against its direction.", word(p["pattern_id"]))))
    changes = F.array_compact(F.array(
        F.when(c("breakout_trigger").isNotNull(), F.format_string("A completed close above %s would strengthen the bullish case.", _shown(c("breakout_trigger")))),
        F.when(c("breakdown_trigger").isNotNull(), F.format_string("A completed close below %s would strengthen the bearish case.", _shown(c("breakdown_trigger")))),
    ))
    fits = lambda side: F.coalesce(c(f"{side}.valid") & c(f"{side}.status").isin("actionable", "watch") & c(f"{side}.meets_least_ratio"), F.lit(False))
    pick = F.when(fits("long") & (~fits("short") | (c("long.confidence") >= c("short.confidence"))), "long").when(fits("short"), "short")
    rows = rows.withColumn("_pick", pick).withColumn("preferred", F.when((c("_pick") == "long") & (c("score") >= 55), "long").when((c("_pick") == "short") & (c("score") <= 45), "short"))
    chosen = lambda field: F.when(c("preferred") == "long", c(f"long.{field}")).otherwise(c(f"short.{field}"))
    neutral = c("preferred").isNull() | (c("coverage") < 0.5) | (c("rating") == "Neutral")
    summary = F.concat(
        F.format_string("%s (%s) last %s.", "symbol", "timeframe", _shown(c("close"))), F.when(c("alignment").isNotNull(), F.format_string(" Timeframes: %s.", word(c("alignment")))).otherwise(""),
        F.when(c("_top").isNotNull(), F.format_string(" Most relevant pattern: %s, %s.", word(c("_top.pattern_id")), word(c("_top.stage")))).otherwise(" No current chart pattern."), F.format_string(" Score %.0f of 100 (%s, coverage %.0f%%).", "score", "rating", c("coverage") * 100),
    )
    conclusion = F.when(neutral, "Neutral: no trade, awaiting confirmation.").otherwise(F.format_string("Conditional %s bias: %s (%s), stop %s, reward to risk %.2f.", F.lower("rating"), "preferred", chosen("basis"), _shown(chosen("stop")), chosen("primary_rr")))
    rows = rows.withColumns({"summary": summary, "conflicts": conflicts, "changes": changes, "stay_neutral": neutral, "conclusion": conclusion})
    shown = ["symbol", "timeframe", "close", "change_pct", "rsi", "macd_state", "adx", "atr_pct", "patterns", "immediate_support", "immediate_resistance", "major_support", "major_resistance", "breakout_trigger", "breakdown_trigger", "long", "short", "score", "rating", "coverage", "alignment", "flags"]
    rows = rows.withColumn("evidence", F.to_json(F.struct(*shown)))
    return rows.select(*SERIES, "n", "close", "change_pct", "score", "rating", "coverage", "alignment", "flags", "patterns", "immediate_support", "immediate_resistance", "major_support", "major_resistance", "breakout_trigger", "breakdown_trigger", "long", "short", "summary", "conflicts", "changes", "stay_neutral", "conclusion", "evidence")


#: Numbers that need no evidence, which are usual periods of indicators.
PERIODS = (9, 12, 14, 20, 26, 50, 100, 200)
NUMBER = r"(?<![A-Za-z])[-+]?[0-9][0-9,]*\.?[0-9]*"


def checked(comments: DataFrame, text: str = "text", evidence: str = "evidence") -> DataFrame:
    """``comments`` with ``unsupported``, the numbers of ``text`` that the JSON of ``evidence`` does not hold, ``unknown_patterns`` that it names without evidence, and ``passed``.

    A number is held if one in the evidence is within 0.6 % or 0.011; whole numbers up to 10 and usual periods need none.
    """
    numbers = lambda column: F.array_compact(F.transform(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(f"({NUMBER})"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")))
    free = lambda v: ((F.abs(v) <= 10) & (v == F.floor(v))) | v.isin(*map(float, PERIODS))
    held = lambda v: F.exists("_known", lambda a: F.abs(v - a) <= F.greatest(0.006 * F.abs(a), F.lit(0.011)))
    rows = comments.withColumn("_known", numbers(F.col(evidence)))
    unsupported = F.array_sort(F.array_distinct(F.filter(numbers(F.col(text)), lambda v: ~free(v) & ~held(v))))
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    names = [i for ids in patterns.IDS.values() for i in ids if i not in ("rectangle", "measured_move_up", "measured_move_down")]
    unknown = F.array_compact(F.array(*(F.when(F.contains(lower, F.lit(i.replace("_", " "))) & ~F.contains(F.coalesce(F.col(evidence), F.lit("")), F.lit(i)), i) for i in names)))
    rows = rows.withColumns({"unsupported": unsupported, "unknown_patterns": unknown})
    return rows.withColumn("passed", (F.size("unsupported") == 0) & (F.size("unknown_patterns") == 0)).drop("_known")
