import pandas as pd

from tapeworks.operators import levels, trends, validation
from tapeworks.operators.harmonics import candidates, impulses
from tapeworks.operators.resample import resample
from tapeworks.sources import files
from tapeworks.sources.bars import daily_trades, hourly_events, indexed
from tapeworks.streaming.bars import closed_bars, run_to_end, streamed_bars

CSV = "# made up\nDate,O,High,l,Close,Vol\n2024-01-02,10,11,9,10.5,100\n2024-01-03,10.5,12,10,11,200\n"


def test_files_to_store_and_back(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one/AB-C_1d.csv").write_text(CSV)
    bars = validation.clean(files.read_csv(spark, str(tmp_path / "one")))
    assert [(r["symbol"], r["timeframe"], r["close"], r["volume"]) for r in bars.orderBy("i").collect()] == [("AB-C", "1d", 10.5, 100.0), ("AB-C", "1d", 11.0, 200.0)]
    store = str(tmp_path / "store")
    files.write_bars(bars, store)
    files.write_bars(bars, store)  # replaces its own series
    assert files.read_bars(spark, store, "AB-C", "1d", start="2024-01-03").count() == 1
    plan = files.read_bars(spark, store, "AB-C", "1d", start="2024-01-03")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan and "GreaterThanOrEqual(ts" in plan


def test_first_source_wins_and_reach(spark):
    schema = "symbol string, timeframe string, i int, close double"
    a, b = spark.createDataFrame([("A", "1d", 0, 1.0)], schema), spark.createDataFrame([("A", "1d", 0, 2.0), ("B", "5m", 0, 3.0)], schema)
    assert sorted(map(tuple, files.first_of(a, b).collect())) == [("A", "1d", 0, 1.0), ("B", "5m", 0, 3.0)]
    got = {(r["symbol"], r["timeframe"]): r["source"] for r in files.reachable(files.first_of(a, b)).collect()}
    assert got["A", "1w"] == "1d" and got["B", "15m"] == "5m" and ("A", "1h") not in got


def test_names(spark):
    symbols = spark.createDataFrame([(0, "OGDC", "Oil and Gas"), (1, "PPL", "Petroleum and Gas")], "ord int, symbol string, name string")
    aliases = spark.createDataFrame([("OIL", "OGDC")], "alias string, symbol string")
    asked = spark.createDataFrame([("oil",), ("ppl",), ("gas",), ("nothing",)], "query string")
    assert {r["query"]: r["symbol"] for r in files.resolve(asked, symbols, aliases).collect()} == {"oil": "OGDC", "ppl": "PPL", "gas": "OGDC", "nothing": None}


def test_stream_equals_batch(spark, tmp_path):
    ticks = [("A", f"2024-01-01 0{h}:{m:02d}:00", float(h * 60 + m), h * 60 + m) for h in range(4) for m in range(0, 60, 7)]
    frame = spark.createDataFrame(ticks, "symbol string, ts string, price double, seq long").selectExpr("symbol", "timestamp(ts) AS ts", "price", "seq")
    frame.write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "ticks"))
    run_to_end(closed_bars(stream), str(tmp_path / "bars"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "bars")).orderBy("ts").collect()
    assert [(r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in got] == [(60.0 * h, 60.0 * h + 56, 60.0 * h, 60.0 * h + 56, 9.0) for h in range(3)]


def test_levels_and_trends(spark, sf_dir):
    hours = hourly_events(spark, sf_dir)
    for r in levels.volume_at_price(hours).collect():
        assert r["volume"] > 0
    assert {r["kind"] for r in levels.auxiliary(hours).collect()} <= {"sma_50", "sma_100", "sma_200", "round"}
    days = daily_trades(spark, sf_dir)
    found = trends.assess(days.unionByName(resample(days, "1d", "1M")))
    rows = found.collect()
    assert rows and all(-100 <= r["score"] <= 100 and (r["trend"] == "bullish") == (r["score"] >= 30) for r in rows)
    assert {r["symbol"] for r in trends.combine(found).collect()} == {r["symbol"] for r in rows}


def test_rising_series_is_bullish(spark):
    n = 260
    up = pd.DataFrame({"symbol": "U", "timeframe": "1d", "ts": pd.date_range("2024-01-01", periods=n), "open": range(100, 100 + n), "high": range(102, 102 + n), "low": range(99, 99 + n), "close": range(101, 101 + n), "volume": 1.0}).astype({c: float for c in ("open", "high", "low", "close")})
    row = trends.assess(indexed(spark.createDataFrame(up))).first()
    assert row["trend"] == "bullish" and row["strength"] in ("moderate", "strong")


SWINGS = "symbol string, timeframe string, k int, idx int, price double, kind string, confirmed_idx int, provisional boolean, scale double, prior double, volume_near double, last int"


def test_impulse(spark):
    prices = {"good": (100, 110, 105, 125, 115, 130), "overlap": (100, 110, 105, 125, 109, 130), "short third": (100, 120, 110, 121, 120.5, 140)}
    rows = [(name, "1d", k, 10 * k, float(p), "LH"[k % 2], 10 * k + 2, False, 1.0, 0.0, 1.0, 60) for name, ps in prices.items() for k, p in enumerate(ps)]
    found = impulses(spark.createDataFrame(rows, SWINGS)).collect()
    assert [(r["symbol"], r["pattern_id"], r["end_idx"], r["level"]) for r in found] == [("good", "elliott_impulse_up", 50, 115.0)] and abs(found[0]["target"] - (130 - 0.382 * 30)) < 1e-9


def test_gartley(spark):
    points = [(0, 100.0, "L"), (10, 130.0, "H"), (20, 130 - 0.618 * 30, "L"), (30, 130 - 0.618 * 30 + 0.6 * 0.618 * 30, "H"), (40, 130 - 0.786 * 30, "L")]
    rows = [("A", "1d", k, i, p, kind, i + 2, False, 1.0, 0.0, 1.0, 60) for k, (i, p, kind) in enumerate(points)]
    swings = spark.createDataFrame(rows, SWINGS)
    assert {r["pattern_id"] for r in candidates(swings).collect()} >= {"gartley_bullish"}


def test_streamed_bars_of_a_file_and_of_part_files(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    one, parts = (sorted(map(tuple, streamed_bars(spark, path).collect())) for path in (sf_dir, str(tmp_path)))
    assert one and parts == one
