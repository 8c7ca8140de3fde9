import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import blocked, recursive

SCHEMA = "symbol string, timeframe string, ts timestamp_ntz, i int, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def bars(spark):
    """A long series of sixteen blocks, one that trends for whole blocks, a flat one, and short ones."""
    rng, rows = np.random.default_rng(5), []
    for symbol, n, drift, noise in (("long", 1600, 0.0, 1.0), ("trend", 900, 0.3, 0.1), ("flat", 250, 0.0, 0.0), ("short", 20, 0.0, 1.0), ("one", 1, 0.0, 1.0)):
        close = 100 + np.cumsum(drift + noise * rng.standard_normal(n))
        high, low = close + noise * rng.random(n), close - noise * rng.random(n)
        rows += [(symbol, "1h", k, float(c), float(h), float(l), float(c), 1.0) for k, (c, h, l) in enumerate(zip(close, high, low, strict=True))]
    made = spark.createDataFrame(rows, "symbol string, timeframe string, i int, open double, high double, low double, close double, volume double")
    return made.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("i"))).select(*(x.split()[0] for x in SCHEMA.split(", "))).cache()


def compared(got, want, *columns):
    key = ["symbol", "i"]
    both = got.select(*key, *columns).join(want.select(*key, *(F.col(c).alias(f"w_{c}") for c in columns)), key, "full").collect()
    for r in both:
        for c in columns:
            assert (r[c] is None) == (r[f"w_{c}"] is None), r
            assert r[c] is None or abs(r[c] - r[f"w_{c}"]) < 1e-9, r
    return len(both)


@pytest.mark.parametrize("block", [7, 100])
def test_averages_equal_one_walk(spark, bars, block):
    got = blocked.averages(bars, {f"ema_{p}": (F.col("close"), p, blocked.EMA(p)) for p in (9, 50, 200)}, block)
    got = blocked.scale(got, block=block)
    want = recursive.recursive(bars, "ema_9", "ema_50", "ema_200", "scale")
    assert compared(got, want, "ema_9", "ema_50", "ema_200", "scale") == bars.count()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_gaps(bars):
    gaps = ("false", "i % 7 = 3", "i < 20", "i in (0, 5)", "i > 30", "true", "i between 95 and 230")
    x = bars.withColumns({f"x{k}": F.expr(f"if({g}, null, close)") for k, g in enumerate(gaps)}).where("symbol != 'flat'")
    got = blocked.averages(x, {f"e{k}": (F.col(f"x{k}"), 14, blocked.WILDER(14)) for k in range(len(gaps))}, 50)
    rows = sorted(got.collect(), key=lambda r: (r["symbol"], r["i"]))
    for symbol in ("long", "trend", "short", "one"):
        own = [r for r in rows if r["symbol"] == symbol]
        for k, gap in enumerate(gaps):
            want = recursive.wilder(np.array([np.nan if r[f"x{k}"] is None else r[f"x{k}"] for r in own]), 14)
            have = np.array([np.nan if r[f"e{k}"] is None else r[f"e{k}"] for r in own])
            assert np.allclose(have, want, rtol=0, atol=1e-9, equal_nan=True), (symbol, gap)


@pytest.mark.parametrize("block", [40, 100])
def test_swings_equal_one_walk(spark, bars, block):
    got = blocked.zigzag(blocked.scale(bars, block=block), block=block)
    want = recursive.zigzag(bars)
    columns = ["symbol", "k", "idx", "kind", "confirmed_idx", "provisional"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert got.count() > 100


def test_a_walk_may_stop_anywhere():
    rng = np.random.default_rng(2)
    close = 50 + np.cumsum(rng.standard_normal(400))
    high, low, least = (close + 0.5).tolist(), (close - 0.5).tolist(), [3.0] * 400
    whole, end = recursive.walk(recursive.START, high, low, least)
    for cut in (0, 1, 2, 57, 399):
        a, state = recursive.walk(recursive.START, high[:cut], low[:cut], least[:cut])
        b, last = recursive.walk(state, high[cut:], low[cut:], least[cut:], cut)
        assert a + b == whole and last == end


def test_places_by_spans(bars):
    got = blocked.indexed(bars.withColumnRenamed("i", "was"), span=7 * 3600)
    assert got.where("i != was").count() == 0 and got.count() == bars.count()
    assert blocked.indexed(bars.where("false").drop("i")).count() == 0
