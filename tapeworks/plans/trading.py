"""Queries of divergences, Fibonacci levels, validation, alerts and backtests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.operators import alerts, analysis, backtest, divergence, indicators, patterns, trends, validation
from tapeworks.operators.recursive import recursive, zigzag
from tapeworks.operators.resample import resample
from tapeworks.plans.indicators import Query, shown
from tapeworks.session import shared_folder, stored
from tapeworks.sources.bars import daily_trades, floored, hourly_events, line_trades, minute_text
from tapeworks.streaming import alerts as watched
from tapeworks.streaming.bars import closed_bars, event_ticks

STRATEGIES = [{"kind": "sma_cross", "allow_short": True}, {"kind": "rsi_recovery", "allow_short": True}, {"kind": "macd_cross", "allow_short": True, "trend_filter": True}]

#: Rules of each symbol: condition, level, factor, averages.
KINDS = [("price_above", 40.0, None, None, None), ("price_below", 40.0, None, None, None), ("cross_sma50", None, None, None, None), ("cross_sma200", None, None, None, None), ("ma_crossover", None, None, 50, 200), ("unusual_volume", None, 1.2, None, None)]


def _measured(spark, sf_dir) -> DataFrame:
    return indicators.money_flow_index(indicators.on_balance_volume(recursive(hourly_events(spark, sf_dir), "scale", "rsi", "macd")))


def div01(spark, sf_dir) -> DataFrame:
    bars = _measured(spark, sf_dir)
    return shown(divergence.divergences(bars, zigzag(bars), ("rsi", "macd", "obv", "mfi")), "indicator", "type", "idx1", "idx2", "ind1", "ind2", "signal_i", "strength", keys=("symbol",))


def fib01(spark, sf_dir) -> DataFrame:
    bars = hourly_events(spark, sf_dir)
    return shown(divergence.fibonacci(bars, zigzag(bars)), "kind", "ratio", "price", "start_idx", "end_idx", "nearest", keys=("symbol",))


def raw_candles(spark, sf_dir) -> DataFrame:
    """Each event as a candle of its hour, so that most hours have several, and later ones of a user stand below zero."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = floored(F.col("ts").cast("timestamp_ntz"), 60).cast("string")
    price = F.col("value") - F.when(F.col("user_id") % 10 == 0, 100.0).otherwise(0.0)
    return e.select(F.col("event_type").alias("symbol"), F.lit("1h").alias("timeframe"), F.when(F.col("event_id") % 50 == 0, "soon").otherwise(hour).alias("Date"), price.alias("O"), (price + 1).alias("High "), (price - 1).alias("low"), price.alias("Price"), F.lit(1.0).alias("Vol"), F.col("event_id").alias("position"))


def val14(spark, sf_dir) -> DataFrame:
    return shown(validation.report(validation.named(raw_candles(spark, sf_dir))), "rows_in", "bad_timestamps", "duplicates", "invalid_rows", "rows_out", "zero_volume_bars", "illiquid", "jumps", "missing_candles", "score", "rating", keys=("symbol",))


def val07(spark, sf_dir) -> DataFrame:
    bars = validation.clean(validation.named(raw_candles(spark, sf_dir)))
    return shown(bars.withColumn("at", minute_text(F.col("ts"))), "at", "open", "high", "low", "close", "volume")


def alr(spark, sf_dir) -> DataFrame:
    bars = hourly_events(spark, sf_dir)
    symbols = bars.select("symbol").distinct().unionByName(spark.createDataFrame([("absent",)], "symbol string"))
    table = spark.createDataFrame([(k, *x) for k, x in enumerate(KINDS)], "rule_id long, condition string, level double, factor double, fast int, slow int")
    rules = symbols.crossJoin(F.broadcast(table))  # six rows
    return shown(alerts.evaluate(bars, rules), "rule_id", "i", "condition", "status", "price", keys=("symbol",))


def alr19(spark, sf_dir) -> DataFrame:
    """What the rules of ``alr`` report of a stream of all events, bar by bar."""
    symbols = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol")).distinct()
    table = spark.createDataFrame([(k, *x) for k, x in enumerate(KINDS)], "rule_id long, condition string, level double, factor double, fast int, slow int")
    rules = symbols.crossJoin(F.broadcast(table))  # six rows
    folder = f"{shared_folder(spark)}/alerts-{uuid.uuid4().hex}"
    watched.start(watched.follow(closed_bars(event_ticks(spark, sf_dir))), rules, folder).awaitTermination()
    return shown(watched.read(spark, folder, "hits", watched.HITS), "rule_id", "i", "condition", "price", keys=("symbol",))


def _signalled(bars: DataFrame) -> DataFrame:
    bars = recursive(bars, "scale", "rsi", "macd_hist")
    return backtest.signals(bars, backtest.specs(bars.sparkSession, STRATEGIES))


def bkt01(spark, sf_dir) -> DataFrame:
    return shown(_signalled(hourly_events(spark, sf_dir)).where("side is not null"), "i", "spec_id", "side", "stop", "target", keys=("symbol",))


def bkt06(spark, sf_dir) -> DataFrame:
    return backtest.trades(backtest.ledger(_signalled(daily_trades(spark, sf_dir)))).drop("timeframe")


def bkt08(spark, sf_dir) -> DataFrame:
    return shown(backtest.metrics(backtest.ledger(_signalled(daily_trades(spark, sf_dir)))), "spec_id", "trades", "bars", "win_rate", "avg_win_pct", "avg_loss_pct", "max_drawdown_pct", "expectancy_r", "expectancy_pct", "avg_holding_bars", "skipped", "final_equity", "sharpe", "profit_factor", "signals_per_100_bars", keys=("symbol",))


def bkt09(spark, sf_dir) -> DataFrame:
    bars = recursive(daily_trades(spark, sf_dir), "scale", "rsi", "macd_hist")
    return shown(backtest.walk_forward(bars, STRATEGIES[0]), "fold", "start", "stop_i", *backtest.GRID, "train_expectancy_r", "trades", "win_rate", "expectancy_r", "profit_factor", keys=("symbol",))


def bkt10(spark, sf_dir) -> DataFrame:
    bars = recursive(daily_trades(spark, sf_dir), "scale", "rsi", "macd_hist")
    return shown(backtest.split(bars, STRATEGIES[0]), "part", "split_i", "trades", "win_rate", "expectancy_r", "profit_factor", "final_equity", keys=("symbol",))


def bkt04(spark, sf_dir) -> DataFrame:
    found = backtest.pattern_signals(hourly_events(spark, sf_dir), ("double_top", "double_bottom"), lookback=150, allow_short=True)
    return shown(found.where("side is not null"), "i", "side", "stop", "target", keys=("symbol",))


def timeframes(spark, sf_dir) -> DataFrame:
    """Days, and the weeks and months made from them: one frame, one job."""
    days = daily_trades(spark, sf_dir)
    return days.unionByName(resample(days, "1d", "1w")).unionByName(resample(days, "1d", "1M"))


def _ruled(spark, bars, fired, *conditions: str) -> DataFrame:
    table = spark.createDataFrame([(k, x, None) for k, x in enumerate(conditions)], "rule_id long, condition string, pattern_id string")
    rules = bars.select("symbol").distinct().crossJoin(F.broadcast(table))  # a few conditions
    return shown(alerts.evaluate_signals(bars, rules, fired), "rule_id", "i", "condition", "status", "price", keys=("symbol",))


def alr01(spark, sf_dir) -> DataFrame:
    bars = line_trades(spark, sf_dir)
    return _ruled(spark, bars, alerts.broken_zones(bars), "break_resistance", "break_support")


def alr05(spark, sf_dir) -> DataFrame:
    bars = patterns.context(recursive(line_trades(spark, sf_dir), "scale"))
    found = patterns.current(patterns.detect(bars, zigzag(bars), ("v_bottom", "inverted_v_top")))
    return _ruled(spark, bars, alerts.fired_patterns(found), "pattern_confirmed", "pattern_invalidated", "breakout_retest", "bullish_reversal", "bearish_reversal")


def val12(spark, sf_dir) -> DataFrame:
    """Seen at noon of a Friday a week after the last trades; the events begin long after it."""
    bars = timeframes(spark, sf_dir).unionByName(hourly_events(spark, sf_dir))
    return validation.freshness(bars, "2001-11-09 12:00:00", 5).select("symbol", "timeframe", minute_text(F.col("last_ts")).alias("last"), "last_complete", "staleness_days", "stale")


def _parts(spark, sf_dir) -> dict[str, DataFrame]:
    days = stored(line_trades(spark, sf_dir), "days")
    return analysis.parts_of(days, days.unionByName(resample(days, "1d", "1w")).unionByName(resample(days, "1d", "1M")))


def ind37(spark, sf_dir) -> DataFrame:
    frame = analysis.indicator_frame(hourly_events(spark, sf_dir))
    names = [c for c in frame.columns if c not in ("symbol", "timeframe", "ts", "i", "open", "high", "low", "close", "volume", "scale", "has_volume")]
    return frame.groupBy("symbol").agg(*(F.count(c).alias(c) for c in names))


def ind38(spark, sf_dir) -> DataFrame:
    now = analysis.snapshot(analysis.indicator_frame(line_trades(spark, sf_dir)))
    return shown(now, *(c for c in now.columns if c not in ("symbol", "timeframe", "scale")), keys=("symbol",))


def set03(spark, sf_dir) -> DataFrame:
    made = analysis.setups_of(line_trades(spark, sf_dir)).withColumns({"targets": F.array_join(F.transform("targets", lambda t: F.concat_ws(":", F.format_string("%.4f", t["price"]), t["ratio"], t["source"])), ","), "risks": F.array_join("risks", ",")})
    return shown(made, *(c for c in made.columns if c not in ("symbol", "timeframe")), keys=("symbol",))


def sco07(spark, sf_dir) -> DataFrame:
    found = _parts(spark, sf_dir)["score"]
    return shown(found, *(c for c in found.columns if c not in ("symbol", "timeframe")), keys=("symbol",))


def scn05(spark, sf_dir) -> DataFrame:
    rows, _ = analysis.scan(_parts(spark, sf_dir))
    rows = rows.withColumn("flags", F.array_join("flags", ","))
    return shown(rows, *(c for c in rows.columns if c not in ("symbol", "timeframe")), keys=("symbol",))


def rpt01(spark, sf_dir) -> DataFrame:
    rows = analysis.reports(_parts(spark, sf_dir))
    return analysis.checked(rows.withColumn("text", F.concat_ws(" ", "summary", "conclusion", F.array_join("changes", " ")))).select("symbol", "summary", "conclusion", "stay_neutral", "passed")


QUERIES: dict[str, Query] = {
    "alr01_02_breaks": alr01,
    "alr05_15_patterns": alr05,
    "alr19_streamed_alerts": alr19,
    "val12_13_freshness": val12,
    "ind37_frame": ind37,
    "ind38_snapshot": ind38,
    "rpt01_reports": rpt01,
    "scn05_scan": scn05,
    "sco07_scores": sco07,
    "set03_setups": set03,
    "div01_divergences": div01,
    "fib01_levels": fib01,
    "val07_clean_bars": val07,
    "val14_report": val14,
    "alr_conditions": alr,
    "bkt01_03_signals": bkt01,
    "bkt04_pattern_signals": bkt04,
    "bkt10_split": bkt10,
    "bkt06_trades": bkt06,
    "bkt08_metrics": bkt08,
    "bkt09_walk_forward": bkt09,
    "mtf01_assess": lambda spark, d: trends.assess(timeframes(spark, d)),
    "mtf02_combine": lambda spark, d: trends.combine(trends.assess(timeframes(spark, d))),
}
