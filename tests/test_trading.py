import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import alerts, backtest, validation

FREE = backtest.Costs(0, 0, 0, 0, 0, 0, 0)


def flat(n=60, price=100.0, side=10, hold=30.0, **changed):
    b = pd.DataFrame({"symbol": "A", "timeframe": "1d", "spec_id": 0, "i": range(n), "open": price, "high": price + 0.5, "low": price - 0.5, "close": price, "volume": 1e6, "side": np.nan, "stop": price - 5, "target": price + 5, "max_hold": hold})
    b.loc[side, "side"] = 1
    for at, values in changed.items():
        for column, x in values.items():
            b.loc[int(at[1:]), column] = x
    return b


def run(b, costs=FREE):
    out = backtest.simulated(b, costs)
    trade = out.dropna(subset=["reason"])
    return (None if trade.empty else trade.iloc[0]), out


def test_time_exit_without_costs_earns_nothing():
    trade, out = run(flat())
    assert (trade.entry_i, trade.i, trade.reason, trade.pnl, trade.shares) == (11, 41, "time", 0, 2000) and out.equity.iloc[-1] == 1_000_000


def test_skips():
    for changed, why in (({"b11": {"open": 90.0, "low": 89.0}}, "gap_through_stop"), ({"b11": {"open": 106.0, "high": 107.0}}, "gap_through_target"), ({"b11": dict.fromkeys(("open", "high", "low", "close"), 107.5)}, "price_limit_locked"), ({"b11": {"volume": 0.0}}, "zero_volume"), ({"b11": {"volume": 5.0}}, "size_zero_liquidity")):
        trade, out = run(flat(**changed))
        assert trade is None and out.skipped.iloc[11] == why
    assert run(flat(b11={"volume": 100.0}))[0].shares == 10


def test_stop_comes_before_target_and_gaps_fill_at_the_open():
    assert run(flat(b13={"high": 110.0, "low": 90.0}))[0].reason == "stop"
    gap = run(flat(b13={"open": 92.0, "low": 90.0}))[0]
    assert (gap.reason, gap.exit) == ("stop", 92.0)
    assert run(flat(b13={"high": 106.0}))[0].exit == 105.0
    assert run(flat(n=20))[0].reason == "end_of_data"


def test_costs_lower_the_result():
    assert run(flat(), backtest.Costs())[0].pnl < 0
    assert backtest.Costs().fees(100, 10) == pytest.approx(1000 * 0.0015 * 1.15 + 1000 * 0.0002) and backtest.Costs().fees(1, 100) == pytest.approx(3 * 1.15 + 0.02)


def test_metrics(spark):
    rows = [("A", "1d", 0, k, e, None, None, None, None, None, None, r, h, p, x, m, None) for k, (e, r, h, p, x, m) in enumerate([(100.0, None, None, None, None, None), (110.0, "target", 3, 10.0, 10.0, 2.0), (99.0, "stop", 1, -11.0, -10.0, -1.0)])]
    schema = "symbol string, timeframe string, spec_id int, i int, equity double, side int, signal_i int, entry_i int, entry double, exit double, shares long, reason string, bars_held int, pnl double, return_pct double, r double, skipped string"
    m = backtest.metrics(spark.createDataFrame(rows, schema)).first()
    assert (m["trades"], m["win_rate"], m["profit_factor"], m["expectancy_r"], m["sharpe"]) == (2, 0.5, pytest.approx(10 / 11), 0.5, None) and m["max_drawdown_pct"] == pytest.approx(-10)


def test_walk_forward_tests_what_it_has_not_seen(spark, sf_dir):
    from tapeworks.operators.recursive import recursive
    from tapeworks.sources.bars import daily_trades

    bars = recursive(daily_trades(spark, sf_dir), "scale", "rsi", "macd_hist")
    rows = backtest.walk_forward(bars, {"kind": "sma_cross", "allow_short": True}).collect()
    assert rows and all(r["start"] < r["stop_i"] and r["stop_scales"] in backtest.GRID["stop_scales"] + [2.0] for r in rows)


RAW = [
    (1, "2024-01-02", "10", "11", "9", "10", 5), (2, "2024-01-03", "10", "9", "11", "10", 5), (3, "not a date", "10", "11", "9", "10", 5), (4, None, "10", "11", "9", "10", 5),
    (5, "2024-01-02", "12", "13", "11", "12", 5), (6, "2024-01-04", "-5", "11", "9", "10", 5), (7, "2024-01-05", "x", "11", "9", "10", 5), (8, "2024-01-08", "20", "21", "19", "20", None), (9, "2024-01-09", "20", "21", "19", "20", -1),
]


def test_validation(spark):
    raw = spark.createDataFrame([("A", "1d", *r) for r in RAW], "symbol string, timeframe string, position int, `Date ` string, OPEN string, h string, l string, Price string, vol int")
    named = validation.named(raw)
    assert {r["position"]: r["problem"] for r in validation.checked(named).collect()} == {1: "duplicate", 2: "invalid", 3: "bad_timestamp", 4: "bad_timestamp", 5: None, 6: "invalid", 7: "invalid", 8: None, 9: "invalid"}
    assert [(r["i"], r["open"], r["volume"]) for r in validation.clean(named).orderBy("i").collect()] == [(0, 12.0, 5.0), (1, 20.0, None)]
    r = validation.report(named).first()
    assert (r["rows_in"], r["rows_out"], r["bad_timestamps"], r["duplicates"], r["invalid_rows"], r["jumps"], r["missing_candles"]) == (9, 2, 2, 1, 4, 1, 3)
    assert r["score"] == pytest.approx(100 - 35 - 20 - 15 - 10) and r["rating"] == "insufficient"
    holidays = spark.createDataFrame([("2024-01-03",)], "date string")
    aged = [validation.report(named, as_of=at, most_days=30).first() for at in ("2100-01-01 00:00:00", "1900-01-01 00:00:00")]
    assert [x["stale"] for x in aged] == [True, False] and aged[0]["score"] == max(0.0, r["score"] - 20) and aged[1]["score"] == r["score"]
    assert validation.report(named, holidays=holidays).first()["missing_candles"] == 2
    with pytest.raises(ValueError):
        validation.named(raw.drop("Price"))
    without = validation.named(raw.drop("vol"))
    assert {r["volume"] for r in validation.clean(without).collect()} == {None} and validation.report(without).first()["rows_out"] == 3


def test_alerts_are_reported_once(spark):
    closes = [100.0] * 59 + [106.0]
    bars = spark.createDataFrame([("A", "1d", k, c, 100.0 if k < 59 else 300.0) for k, c in enumerate(closes)] + [("B", "1d", k, 1.0, 1.0) for k in range(5)], "symbol string, timeframe string, i int, close double, volume double")
    kinds = [("price_above", 105.0, None), ("price_above", 106.0, None), ("price_below", 105.0, None), ("unusual_volume", None, None), ("cross_sma50", None, None)]
    rules = spark.createDataFrame([(10 * j + k, s, c, level, f, None, None) for j, s in enumerate("ABC") for k, (c, level, f) in enumerate(kinds)], alerts.RULE)
    hits = alerts.evaluate(bars, rules)
    status = {r["rule_id"]: r["status"] for r in hits.collect()}
    assert [status[k] for k in range(5)] == ["hit", "no_hit", "no_hit", "hit", "no_hit"]
    assert {status[10 + k] for k in range(5)} == {"short_history"} and {status[20 + k] for k in range(5)} == {"no_data"}
    new = alerts.unreported(hits.unionByName(hits), hits.where("rule_id = 0"))
    assert [r["rule_id"] for r in new.collect()] == [3]


def test_pattern_signals_have_stops_and_follow_the_trend(spark, monkeypatch):
    """The best pattern of the last bar is against the trend, the next has no invalidation and no target."""
    closes = [100.0 + 0.1 * k for k in range(260)]
    bars = spark.createDataFrame([("a", "1d", k, c, c + 1, c - 1, c, 1.0) for k, c in enumerate(closes)], "symbol string, timeframe string, i int, open double, high double, low double, close double, volume double").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("i")))
    found = spark.createDataFrame(
        [("a@259", "1d", "bearish", 249, 249, False, 90.0, 120.0, 125.0, 80.0, 5), ("a@259", "1d", "bullish", 249, 249, False, 50.0, 120.0, None, None, 7), ("a@100", "1d", "bullish", 99, 99, False, 50.0, 105.0, 100.0, 130.0, 7)],
        "symbol string, timeframe string, direction string, confirmation_idx int, last int, provisional boolean, quality double, level double, inval double, target double, start_idx int",
    )
    monkeypatch.setattr(backtest.patterns, "detect", lambda *a: found)
    signals = lambda **k: {r["i"]: (r["side"], r["stop"], r["target"]) for r in backtest.pattern_signals(bars, ("x",), allow_short=True, **k).where("side is not null").collect()}
    followed = signals(trend_filter=True)  # no average of 200 bars at bar 100
    assert followed.keys() == {259} and followed[259][0] == 1
    scale, close = 2.0, closes[259]
    stop = 120 - 2 * scale - 0.2 * scale
    assert followed[259][1:] == pytest.approx((stop, close + 2 * abs(close - stop)))
    assert signals() == {259: (-1, pytest.approx(125 + 0.2 * scale), 80.0), 100: (1, pytest.approx(100 - 0.2 * scale), 130.0)}
