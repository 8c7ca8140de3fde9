import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import alerts, analysis, indicators, levels, patterns, validation
from tapeworks.operators.recursive import recursive, zigzag
from tapeworks.plans import trading
from tapeworks.sources import files
from tapeworks.sources.bars import hourly_events, indexed

from .test_shapes import path, series

KEYS = "symbol string, timeframe string"


@pytest.fixture(scope="module")
def drawn(spark):
    rise = path((60, 14), (20, -6), (30, 12), (15, -5), (25, 9), (12, -4), (30, 6), start=40)
    return indexed(spark.createDataFrame(pd.concat([series(rise, "UP"), series([(i, 150 - p) for i, p in rise], "DOWN", seed=8)])))


def test_frame_holds_what_each_indicator_gives(spark, sf_dir):
    bars = hourly_events(spark, sf_dir)
    frame = analysis.indicator_frame(bars).orderBy("symbol", "i").toPandas()
    for one, columns in ((indicators.sma(bars), ["sma_20"]), (indicators.bollinger(bars), ["bb_upper", "bb_pct_b"]), (recursive(bars, "rsi", "adx", "psar"), ["rsi", "adx", "psar"]), (indicators.money_flow(bars), ["cmf"]), (indicators.session_vwap(bars), ["vwap"])):
        own = one.orderBy("symbol", "i").toPandas()
        for c in columns:
            np.testing.assert_allclose(frame[c].astype(float), own[c].astype(float))
    silent = analysis.indicator_frame(bars.withColumn("volume", F.lit(None).cast("double")))
    assert silent.where("obv is not null or vwap is not null or rel_volume is not null").count() == 0
    few = bars.where("i < 60").withColumn("volume", F.lit(None).cast("double"))
    missing = {r["column"] for r in analysis.availability(few).collect()}
    assert missing == {"sma_100", "sma_200", "ema_100", "ema_200", "vol_sma", "rel_volume", "obv", "ad", "cmf", "mfi", "vwap"}


def naive_setup(side, close, scale, found, zones, fib):
    """A setup by the written rules, for one series."""
    s = 1 if side == "long" else -1
    weight = {"confirmed": 1.0, "retesting": 1.0, "approaching_confirmation": 0.8, "forming": 0.55}
    mine = [p for p in found if p["direction"] == ("bullish" if s > 0 else "bearish") and p["stage"] in weight and not p["target_reached"] and (p["conf"] is None or p["last"] - p["conf"] <= 30)]

    def rank(p):
        tired = p["conf"] is not None and s * (close - p["level"]) > 2 * scale
        return p["quality"] * weight[p["stage"]] * (0.6 if tired else 1)

    p = max(mine, key=rank, default=None)
    ahead, behind = (sorted((z for z in zones if sign * s * (z[0] - close) > 0), key=lambda z: abs(z[0] - close)) for sign in (1, -1))
    near = lambda z: z[1] if s > 0 else z[2]
    if p:
        trigger, beyond = p["level"], p["inval"]
        sure = p["stage"] in ("confirmed", "retesting")
        far = s * (close - trigger) > 2 * scale
        entry = (trigger + s * 0.25 * scale if far else close) if sure else trigger + s * 0.1 * scale
        status = ("extended" if far else "actionable") if sure else "watch"
    elif ahead and behind:
        trigger, beyond, status = (ahead[0][2] if s > 0 else ahead[0][1]), (behind[0][1] if s > 0 else behind[0][2]), "watch"
        entry = trigger + s * 0.1 * scale
    else:
        return False, "invalid", None, None, None, []
    stop = beyond - s * 0.2 * scale
    if s * (entry - stop) <= 0:
        return False, "invalid", round(entry, 6), round(stop, 6), None, []
    wanted = [(near(z), "zone") for z in ahead[:2] if s * (near(z) - entry) > 0.5 * scale]
    if p and s * (p["target"] - entry) > 0:
        wanted.append((p["target"], "measured"))
    wanted += [(f, "fib") for f in sorted(fib, key=lambda f: s * f) if s * (f - close) > 0 and s * (f - entry) > 0][:1]
    chosen = []
    for price, source in sorted(wanted, key=lambda x: (s * x[0], x[0], x[1])):
        if s * (price - entry) >= 0.5 * scale and all(abs(price - q) >= 0.5 * scale for q, _ in chosen) and len(chosen) < 3:
            chosen.append((price, source))
    main = next((q for q in chosen if q[1] == "measured"), chosen[-1] if chosen else None)
    ratio = round(s * (main[0] - entry) / (s * (entry - stop)), 2) if main else None
    if p and s * (close - p["target"]) >= 0:
        status = "target_reached"
    return True, status, round(entry, 6), round(stop, 6), ratio, [round(q, 6) for q, _ in chosen]


def test_setups_equal_a_naive_reading(spark):
    rng = np.random.default_rng(4)
    now, found, zones, fib, want = [], [], [], [], {}
    for k in range(60):
        name, close, scale = f"S{k}", float(rng.uniform(80, 120)), float(rng.uniform(1, 3))
        now.append((name, "1d", 200, close, scale))
        own = []
        for j in range(rng.integers(0, 4)):
            s = int(rng.choice([-1, 1]))
            stage = str(rng.choice(["forming", "approaching_confirmation", "confirmed", "retesting", "failed"]))
            level = close + float(rng.normal(0, 4))
            own.append({"direction": "bullish" if s > 0 else "bearish", "stage": stage, "level": level, "inval": level - s * float(rng.uniform(1, 8)), "target": level + s * float(rng.uniform(1, 15)), "target_reached": bool(rng.random() < 0.1), "quality": round(float(rng.uniform(20, 95)), 1) + j * 1e-3, "conf": int(rng.integers(160, 199)) if stage in ("confirmed", "retesting") else None, "last": 199})
        ours = [(mid, mid - 0.8, mid + 0.8) for mid in (close + float(rng.normal(0, 9)) for _ in range(rng.integers(0, 6)))]
        lines = [close + float(rng.normal(0, 10)) for _ in range(rng.integers(0, 4))]
        found += [(name, "1d", "x", p["direction"], p["stage"], 100 + j, 150, p["conf"], p["target_reached"], p["level"], p["inval"], p["target"], p["quality"], 199, False, True) for j, p in enumerate(own)]
        zones += [(name, "1d", *z) for z in ours]
        fib += [(name, "1d", x) for x in lines]
        want |= {(name, side): naive_setup(side, close, scale, own, ours, lines) for side in ("long", "short")}
    made = analysis.setups(
        spark.createDataFrame(now, f"{KEYS}, n int, close double, scale double"),
        spark.createDataFrame(found, f"{KEYS}, pattern_id string, direction string, stage string, start_idx int, end_idx int, confirmation_idx int, target_reached boolean, level double, inval double, target double, quality double, last int, experimental boolean, current boolean"),
        spark.createDataFrame(zones, f"{KEYS}, mid double, low double, high double"), spark.createDataFrame(fib, f"{KEYS}, price double"),
    ).collect()
    rounded = lambda x: None if x is None else round(x, 6)
    for r in made:
        got = (r["valid"], r["status"], rounded(r["entry"]), rounded(r["stop"]), r["primary_rr"], [round(t["price"], 6) for t in r["targets"] or []])
        expected = want[r["symbol"], r["side"]]
        assert got[:4] == expected[:4] and got[5] == expected[5], (r["symbol"], r["side"])
        assert (got[4] is None) == (expected[4] is None) and (got[4] is None or abs(got[4] - expected[4]) < 0.011)
        assert r["meets_least_ratio"] == (r["primary_rr"] is not None and r["primary_rr"] >= 2)
    assert len(made) == 120 and len({w[1] for w in want.values()}) >= 4


def test_report_score_scan_and_checks(spark, drawn):
    parts = analysis.parts_of(drawn)
    scores = {r["symbol"]: r for r in parts["score"].collect()}
    assert scores["UP"]["score"] > 50 > scores["DOWN"]["score"]
    for r in scores.values():
        known = {k: w for k, w in analysis.WEIGHTS.items() if r[k] is not None}
        assert r["score"] == pytest.approx(50 + 50 * sum(r[k] * w for k, w in known.items()) / sum(known.values()), abs=0.06) and r["coverage"] == pytest.approx(sum(known.values()) / 100)
    asked = spark.createDataFrame([("UP",), ("DOWN",), ("NONE",), ("UP",)], "symbol string")
    rows, errors = analysis.scan(parts, asked)
    shown = rows.collect()
    assert sorted(r["symbol"] for r in shown) == ["DOWN", "UP"] and [tuple(r) for r in errors.collect()] == [("NONE", None, "no data")]
    assert abs(shown[0]["score"] - 50) >= abs(shown[1]["score"] - 50)
    assert {r["symbol"] for r in analysis.scan(parts, least_score=50.1)[0].collect()} == {"UP"}
    assert analysis.scan(parts, pattern_ids=("crab",))[0].count() == 0 and analysis.scan(parts, least_ratio=1e6)[0].count() == 0
    report = {r["symbol"]: r for r in analysis.reports(parts).collect()}
    assert report["UP"]["summary"].startswith("UP (1d) last") and json.loads(report["UP"]["evidence"])["symbol"] == "UP"
    said = [(1, report["UP"]["summary"], report["UP"]["evidence"]), (2, "Price is 9876.5 after a head and shoulders.", '{"close": 12.5, "patterns": ["double_top"]}'), (3, "Close 12.55, two tops, SMA 50, ratio 1:2.", '{"close": 12.5, "patterns": ["double_top"]}')]
    checked = {r["id"]: r for r in analysis.checked(spark.createDataFrame(said, "id int, text string, evidence string")).collect()}
    assert checked[1]["passed"] and checked[3]["passed"]
    assert checked[2]["unsupported"] == [9876.5] and checked[2]["unknown_patterns"] == ["head_and_shoulders"]


def test_zones_hold_what_price_turned_at(spark):
    points = path((20, 10), (20, -10), (20, 10), (20, -10), (20, 10), (20, -10), (10, 5), start=50)
    bars = recursive(indexed(spark.createDataFrame(series(points, noise=0.15))), "scale")
    found = levels.zones(bars, zigzag(bars)).collect()
    assert any(r["low"] <= 60.3 <= r["high"] and r["kind"] == "resistance" for r in found) and any(r["low"] <= 49.7 <= r["high"] and r["kind"] == "support" for r in found)
    assert [r["place"] for r in sorted(found, key=lambda r: r["mid"])] == list(range(1, len(found) + 1)) and all(0 <= r["strength"] <= 100 for r in found)
    assert levels.zones(bars.where("i < 19"), zigzag(bars.where("i < 19"))).count() == 0


def test_cups_and_rounded_bottoms(spark):
    x = np.arange(61)
    bowl = 100 - 30 * (1 - ((x - 30) / 30.0) ** 2)
    rise, dent = np.linspace(80, 100, 40, endpoint=False), np.concatenate([np.linspace(100, 93, 7), np.linspace(94, 103, 8)])
    close = np.concatenate([rise, bowl, dent, [104.0, 104.5]])
    pdf = pd.DataFrame({"symbol": "A", "timeframe": "1d", "ts": pd.date_range("2024-01-01", periods=len(close)), "open": close, "high": close + 0.6, "low": close - 0.6, "close": close, "volume": 1e6})
    upside = pdf.assign(symbol="B", open=200 - pdf.open, high=200 - pdf.low, low=200 - pdf.high, close=200 - pdf.close)
    bars = patterns.context(recursive(indexed(spark.createDataFrame(pd.concat([pdf, upside]))), "scale"))
    found = {(r["symbol"], r["pattern_id"]): r for r in patterns.detect(bars, zigzag(bars), patterns.IDS["rounding"]).collect()}
    assert {("A", "rounding_bottom"), ("A", "cup_and_handle"), ("B", "rounding_top"), ("B", "inverted_cup_and_handle")} <= found.keys()
    assert found["A", "cup_and_handle"]["stage"] in ("confirmed", "retesting") and len(found["A", "cup_and_handle"]["points"]) == 4


def test_flags_of_both_sides(spark):
    wave = np.array([0, -1.2, -0.3, -1.6, -0.7, -2.0, -1.1, -2.4, -1.5, -2.8, -1.9])
    close = np.concatenate([np.full(30, 50.0) + 0.2 * np.sin(np.arange(30)), np.linspace(50, 66, 9)[1:], 66 + wave[1:], [67.5, 68.5, 69.0]])
    pdf = pd.DataFrame({"symbol": "A", "timeframe": "1d", "ts": pd.date_range("2024-01-01", periods=len(close)), "open": close, "high": close + 0.5, "low": close - 0.5, "close": close, "volume": np.where(np.arange(len(close)) < 38, 2e6, 1e6)})
    upside = pdf.assign(symbol="B", open=120 - pdf.open, high=120 - pdf.low, low=120 - pdf.high, close=120 - pdf.close)
    bars = patterns.context(recursive(indexed(spark.createDataFrame(pd.concat([pdf, upside]))), "scale"))
    found = {(r["symbol"], r["pattern_id"]): r for r in patterns.detect(bars, zigzag(bars), patterns.IDS["flag"]).collect()}
    assert {("A", "bull_flag"), ("B", "bear_flag")} <= found.keys()
    for (symbol, _), r in found.items():
        assert r["stage"] in ("confirmed", "retesting") and r["direction"] == ("bullish" if symbol == "A" else "bearish") and r["category"] == "continuation"
        assert abs(abs(r["target"] - r["level"]) - 17) < 1.5
    open_ = bars.where("i <= 46").withColumn("last", F.lit(46))
    assert {r["stage"] for r in patterns.detect(open_, zigzag(open_), patterns.IDS["flag"]).collect()} <= {"forming", "approaching_confirmation"}


def test_alerts_of_divergences_and_stale_series(spark, drawn):
    last = {r["symbol"]: r["i"] for r in drawn.groupBy("symbol").agg(F.max("i").alias("i")).collect()}
    diverged = spark.createDataFrame([("UP", "1d", "rsi", "regular_bullish", last["UP"]), ("UP", "1d", "macd", "regular_bearish", last["UP"] - 1), ("DOWN", "1d", "macd", "regular_bearish", last["DOWN"])], f"{KEYS}, indicator string, type string, signal_i int")
    fired = alerts.fired_divergences(drawn, diverged)
    assert {(r["symbol"], r["condition"]) for r in fired.collect()} == {("UP", "bullish_rsi_divergence"), ("DOWN", "bearish_macd_divergence")}
    rules = spark.createDataFrame([(1, "UP", "bullish_rsi_divergence", None), (2, "DOWN", "bearish_macd_divergence", None), (3, "NONE", "break_support", None)], "rule_id long, symbol string, condition string, pattern_id string")
    state = spark.createDataFrame([("DOWN", "1d", True, False), ("UP", "1d", True, True)], f"{KEYS}, stale boolean, synthetic boolean")
    assert {r["rule_id"]: r["status"] for r in alerts.evaluate_signals(drawn, rules, fired, state).collect()} == {1: "hit", 2: "stale", 3: "no_data"}


def test_files_with_their_own_headers_notes_and_routes(spark, tmp_path):
    (tmp_path / "AAA_1d.csv").write_text("# note\ntimestamp,open,high,low,close\n2024-01-01,9,12,8,11\n")
    (tmp_path / "BBB_1d.csv").write_text("close,low,high,open,timestamp,Vol\n# another\n5,4,6,4.5,2024-01-01,7\n6,5,7,5.5,2024-01-02,8\n")
    (tmp_path / "AAA_1d.meta.json").write_text('{"provider": "me", "adjusted": true, "is_synthetic": true}')
    raw = files.read_csv(spark, str(tmp_path))
    assert raw.count() == 3
    bars = files.with_notes(validation.clean(raw), files.read_notes(spark, str(tmp_path)))
    got = {(r["symbol"], r["i"]): (r["open"], r["high"], r["low"], r["close"], r["volume"], r["provider"], r["synthetic"]) for r in bars.collect()}
    assert got == {("AAA", 0): (9, 12, 8, 11, None, "me", True), ("BBB", 0): (4.5, 6, 4, 5, 7, None, False), ("BBB", 1): (5.5, 7, 5, 6, 8, None, False)}
    (tmp_path / "CCC_1d.csv").write_text("when,open\n2024-01-01,1\n")
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path))
    store = str(tmp_path / "store")
    assert {r["symbol"]: r["rows_out"] for r in files.save_upload(raw, store).collect()} == {"AAA": 1, "BBB": 2}
    assert files.read_bars(spark, store).count() == 3
    made = spark.createDataFrame([("SYN-A", "1d", 0, 1.0), ("B", "1d", 0, 2.0)], f"{KEYS}, i int, close double")
    assert sorted((r["symbol"], r["close"]) for r in files.routed(made.withColumn("close", F.lit(9.0)), made).collect()) == [("B", 9.0), ("SYN-A", 1.0)]
    weekly = files.bars_of(validation.clean(raw), "1w").collect()
    assert {(r["symbol"], r["timeframe"]) for r in weekly} == {("AAA", "1w"), ("BBB", "1w")}


def test_freshness(spark):
    rows = [("A", "1d", "2024-03-07 00:00:00"), ("A", "1h", "2024-03-08 14:00:00"), ("A", "1w", "2024-03-04 00:00:00"), ("A", "1M", "2024-03-01 00:00:00")]
    bars = spark.createDataFrame(rows, f"{KEYS}, t string").selectExpr("symbol", "timeframe", "cast(t as timestamp_ntz) as ts")
    seen = lambda at: {r["timeframe"]: (r["last_complete"], r["stale"]) for r in validation.freshness(bars, at, 3).collect()}
    assert seen("2024-03-08 14:30:00") == {"1d": (True, False), "1h": (False, False), "1w": (False, True), "1M": (False, True)}
    assert seen("2024-03-08 16:30:00")["1w"] == (True, True) and seen("2024-04-01 00:00:00")["1M"] == (True, True)
    open_ = validation.with_completeness(bars, validation.freshness(bars, "2024-03-08 14:30:00"))
    assert {r["timeframe"]: r["complete"] for r in open_.collect()} == {"1d": True, "1h": False, "1w": False, "1M": False}


def counted(spark, df):
    """``df``, and how many of its rows have been made, over all the times that it was."""
    rows = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), rows


@pytest.mark.parametrize("query", ["set03_setups", "sco07_scores"])
def test_trades_and_candidates_are_read_once(spark, sf_dir, monkeypatch, query):
    days, doubles, made, found = trading.line_trades, patterns.DETECTORS["double"], [], []

    def trades(*args):
        bars, rows = counted(spark, days(*args))
        made.append((days(*args), rows))
        return bars

    def double(*args):
        candidates, rows = counted(spark, doubles(*args))
        found.append((doubles(*args), rows))
        return candidates

    monkeypatch.setattr(trading, "line_trades", trades)
    monkeypatch.setitem(patterns.DETECTORS, "double", double)
    assert trading.QUERIES[query](spark, sf_dir).count()
    for (df, rows), in (made, found):
        assert rows.value == df.count() > 0


def test_setups_alone_are_those_of_a_report(spark, drawn):
    alone, whole = analysis.setups_of(drawn), analysis.parts_of(drawn)["setups"]
    assert alone.columns == whole.columns
    got = alone.orderBy("symbol", "side").collect()
    assert len(got) == 4 and got == whole.orderBy("symbol", "side").collect()
