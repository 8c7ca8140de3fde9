import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import indicators as ind
from tapeworks.operators import recursive as rec
from tapeworks.operators.resample import can_resample, resample
from tapeworks.sources.bars import indexed


def walk(n=300, seed=1, symbol="A"):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.015, n)))
    opened = np.concatenate([[100], close[:-1]]) * (1 + rng.normal(0, 0.002, n))
    high, low = np.maximum(opened, close) * (1 + rng.random(n) * 0.01), np.minimum(opened, close) * (1 - rng.random(n) * 0.01)
    ts = pd.date_range("2024-01-01", periods=n, freq="D")
    return pd.DataFrame({"symbol": symbol, "timeframe": "1d", "ts": ts, "open": opened, "high": high, "low": low, "close": close, "volume": rng.integers(1, 1000, n).astype(float)})


@pytest.fixture(scope="module")
def frame():
    return walk()


@pytest.fixture(scope="module")
def bars(spark, frame):
    return indexed(spark.createDataFrame(pd.concat([frame, walk(40, 2, "B")])))


def column(df, name, symbol="A"):
    return df.where(F.col("symbol") == symbol).orderBy("i").toPandas()[name].to_numpy(float)


def test_windows_equal_pandas(bars, frame):
    c, h, low = frame["close"], frame["high"], frame["low"]
    np.testing.assert_allclose(column(ind.sma(bars), "sma_20"), c.rolling(20).mean(), rtol=1e-9)
    np.testing.assert_allclose(column(ind.bollinger(bars), "bb_upper"), c.rolling(20).mean() + 2 * c.rolling(20).std(ddof=0), rtol=1e-9)
    np.testing.assert_allclose(column(ind.donchian(bars), "dc_mid"), (h.rolling(20).max() + low.rolling(20).min()) / 2, rtol=1e-9)
    np.testing.assert_allclose(column(ind.historical_volatility(bars), "hv"), np.log(c / c.shift(1)).rolling(20).std() * np.sqrt(245), rtol=1e-9)
    t = (h + low + c) / 3
    want = (t - t.rolling(20).mean()) / (0.015 * t.rolling(20).apply(lambda x: np.abs(x - x.mean()).mean(), raw=True))
    np.testing.assert_allclose(column(ind.commodity_channel(bars), "cci"), want, rtol=1e-7)
    got = ind.linear_regression(bars)
    k = np.arange(200, 300)
    slope, start = np.polyfit(k, c.to_numpy()[200:300], 1)
    assert abs(column(got, "linreg_slope")[299] - slope) < 1e-9 and abs(column(got, "linreg_mid")[299] - (start + slope * 299)) < 1e-8


def test_smoothing_starts_with_a_mean():
    x = np.array([np.nan, 1, 2, 3, 4, np.nan, 6.0])
    assert np.allclose(rec.smooth(x, 3, 0.5), [np.nan, np.nan, np.nan, 2, 3, 3, 4.5], equal_nan=True)
    assert np.isnan(rec.smooth(x[:3], 3, 0.5)).all() and np.isnan(rec.smooth(np.zeros(0), 3, 0.5)).all()
    assert np.allclose(rec.smooth(np.array([1, np.nan, 3, 5.0]), 3, 0.5), [1, 1, 2, 3.5])


def test_values_do_not_depend_on_later_bars(spark, bars, frame):
    names = [n for names in rec.KERNELS for n in names]
    whole = rec.recursive(bars, *names)
    part = rec.recursive(indexed(spark.createDataFrame(frame.iloc[:200])), *names)
    for name in names:
        np.testing.assert_allclose(column(whole, name)[:200], column(part, name), rtol=1e-12)


def test_bounds(bars):
    out = rec.recursive(bars, "rsi", "adx", "psar", "supertrend_dir", "scale").toPandas()
    assert out["rsi"].dropna().between(0, 100).all() and out["adx"].dropna().between(0, 100).all()
    assert set(out["supertrend_dir"]) <= {-1.0, 0.0, 1.0} and (out["scale"] > 0).all()
    inside = out.dropna(subset=["psar"])
    assert ((inside["psar"] >= inside["high"]) | (inside["psar"] <= inside["low"])).all()


def test_flat_prices(spark):
    flat = walk(60).assign(open=5.0, high=5.0, low=5.0, close=5.0, volume=0.0)
    bars = indexed(spark.createDataFrame(flat))
    out = ind.money_flow(ind.williams_r(ind.stochastic(ind.bollinger(rec.recursive(bars, "rsi"))))).toPandas()
    assert (out["rsi"].dropna() == 50).all() and out[["williams_r", "stoch_k", "bb_pct_b", "cmf"]].isna().all().all()
    assert not ind.has_volume(bars).first()["has_volume"]


def test_resampling(spark, bars, frame):
    pairs = {(a, b) for a in ("5m", "15m", "1h", "1d", "1w", "1M") for b in ("5m", "15m", "1h", "1d", "1w", "1M") if can_resample(a, b)}
    assert ("1d", "1w") in pairs and ("15m", "1h") in pairs and ("1w", "1M") not in pairs and ("1d", "1h") not in pairs
    with pytest.raises(ValueError):
        resample(bars, "1d", "1h")
    week = resample(bars, "1d", "1w").where("symbol = 'A'").orderBy("i").toPandas()
    g = frame.set_index("ts").groupby(pd.Grouper(freq="W-FRI", label="right", closed="right"))
    want = g.agg(open=("open", "first"), high=("high", "max"), low=("low", "min"), close=("close", "last"), volume=("volume", "sum"))
    np.testing.assert_allclose(week[["open", "high", "low", "close", "volume"]], want)
    assert list(week["ts"]) == list(g["close"].apply(lambda x: x.index[0]))


def test_empty_bars(bars):
    none = bars.where("false")
    assert rec.recursive(ind.sma(none), "rsi").collect() == [] and rec.zigzag(none).collect() == []
