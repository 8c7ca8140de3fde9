"""Indicators that only need windows: each function adds its columns to bars. The windows of all share one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.rolling import before, deviation, full, highest, last, lowest, mean, over, so_far, total

def _c(name: str) -> Column:
    return F.col(name)


def sma(bars: DataFrame, periods: tuple[int, ...] = (10, 20, 50, 100, 200)) -> DataFrame:
    return bars.withColumns({f"sma_{p}": mean(_c("close"), p) for p in periods})


def true_range(bars: DataFrame) -> DataFrame:
    """``tr``; null on a series' first bar, which has no close before it."""
    prev = before(_c("close"))
    spread = F.greatest(_c("high") - _c("low"), F.abs(_c("high") - prev), F.abs(_c("low") - prev))
    return bars.withColumn("tr", F.when(prev.isNotNull(), spread))


def linear_regression(bars: DataFrame, period: int = 100, width: float = 2.0) -> DataFrame:
    """The line through the last closes: its value and slope at the bar, and a channel of ``width`` residual deviations."""
    w = last(period)
    args = (_c("close"), _c("i"))
    slope, intercept = F.regr_slope(*args).over(w), F.regr_intercept(*args).over(w)
    residual = F.sqrt(F.greatest(F.regr_syy(*args).over(w) - slope * slope * F.regr_sxx(*args).over(w), F.lit(0.0)) / period)
    bars = bars.withColumns({"linreg_mid": full(intercept + slope * _c("i"), _c("close"), period), "linreg_slope": full(slope, _c("close"), period), "_residual": residual})
    return bars.withColumns({"linreg_upper": _c("linreg_mid") + width * _c("_residual"), "linreg_lower": _c("linreg_mid") - width * _c("_residual")}).drop("_residual")


def crossovers(bars: DataFrame, fast: str, slow: str, name: str = "cross") -> DataFrame:
    """1 where ``fast`` has come to stand above ``slow``, -1 where below, else 0."""
    bars = bars.withColumn("_d", _c(fast) - _c(slow))
    prev = before(_c("_d"))
    return bars.withColumn(name, F.when((_c("_d") > 0) & (prev <= 0), 1).when((_c("_d") < 0) & (prev >= 0), -1).otherwise(0)).drop("_d")


def ichimoku(bars: DataFrame, tenkan: int = 9, kijun: int = 26, senkou: int = 52, shift: int = 26) -> DataFrame:
    """Lines, spans at the bar they are computed on, and the cloud in force: the spans of ``shift`` bars ago."""
    middle = lambda n: (highest(_c("high"), n) + lowest(_c("low"), n)) / 2
    bars = bars.withColumns({"ichimoku_tenkan": middle(tenkan), "ichimoku_kijun": middle(kijun), "ichimoku_span_b_raw": middle(senkou)})
    bars = bars.withColumn("ichimoku_span_a_raw", (_c("ichimoku_tenkan") + _c("ichimoku_kijun")) / 2)
    return bars.withColumns({"ichimoku_cloud_a": before(_c("ichimoku_span_a_raw"), shift), "ichimoku_cloud_b": before(_c("ichimoku_span_b_raw"), shift)})


def session_vwap(bars: DataFrame) -> DataFrame:
    """Volume-weighted typical price since the day began; for intraday bars."""
    day = Window.partitionBy("symbol", "timeframe", F.to_date("ts")).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    typical = (_c("high") + _c("low") + _c("close")) / 3
    return bars.withColumn("vwap", over(F.sum(typical * _c("volume")).over(day), F.sum("volume").over(day)))


def stochastic(bars: DataFrame, period: int = 14, smooth: int = 3, signal: int = 3) -> DataFrame:
    low, high = lowest(_c("low"), period), highest(_c("high"), period)
    bars = bars.withColumn("_k", over(100 * (_c("close") - low), high - low))
    bars = bars.withColumn("stoch_k", mean(_c("_k"), smooth))
    return bars.withColumn("stoch_d", mean(_c("stoch_k"), signal)).drop("_k")


def stochastic_rsi(bars: DataFrame, period: int = 14, smooth: int = 3, signal: int = 3) -> DataFrame:
    """The stochastic of column ``rsi``."""
    low, high = lowest(_c("rsi"), period), highest(_c("rsi"), period)
    bars = bars.withColumn("_k", over(100 * (_c("rsi") - low), high - low))
    bars = bars.withColumn("stochrsi_k", mean(_c("_k"), smooth))
    return bars.withColumn("stochrsi_d", mean(_c("stochrsi_k"), signal)).drop("_k")


def rate_of_change(bars: DataFrame, period: int = 10) -> DataFrame:
    return bars.withColumn("roc", 100 * (over(_c("close"), before(_c("close"), period)) - 1))


def momentum(bars: DataFrame, period: int = 10) -> DataFrame:
    return bars.withColumn("momentum", _c("close") - before(_c("close"), period))


def commodity_channel(bars: DataFrame, period: int = 20) -> DataFrame:
    """Distance of the typical price from its mean, over 0.015 mean absolute deviations from that window's mean."""
    bars = bars.withColumn("_t", (_c("high") + _c("low") + _c("close")) / 3)
    bars = bars.withColumns({"_m": mean(_c("_t"), period), "_all": F.collect_list("_t").over(last(period))})
    spread = F.aggregate("_all", F.lit(0.0), lambda s, x: s + F.abs(x - _c("_m"))) / period
    return bars.withColumn("cci", over(_c("_t") - _c("_m"), 0.015 * spread)).drop("_t", "_m", "_all")


def williams_r(bars: DataFrame, period: int = 14) -> DataFrame:
    low, high = lowest(_c("low"), period), highest(_c("high"), period)
    return bars.withColumn("williams_r", over(-100 * (high - _c("close")), high - low))


def bollinger(bars: DataFrame, period: int = 20, width: float = 2.0) -> DataFrame:
    bars = bars.withColumns({"bb_mid": mean(_c("close"), period), "_s": deviation(_c("close"), period)})
    bars = bars.withColumns({"bb_upper": _c("bb_mid") + width * _c("_s"), "bb_lower": _c("bb_mid") - width * _c("_s")})
    span = _c("bb_upper") - _c("bb_lower")
    return bars.withColumns({"bb_width": over(span, _c("bb_mid")), "bb_pct_b": over(_c("close") - _c("bb_lower"), span)}).drop("_s")


def bollinger_squeeze(bars: DataFrame, period: int = 20, lookback: int = 120, share: float = 0.10) -> DataFrame:
    """Whether ``bb_width`` is among the lowest ``share`` of the last ``lookback`` bars; false until half of them are known."""
    w = last(lookback)
    known = F.count("bb_width").over(w) >= max(period, lookback // 2)
    return bars.withColumn("bb_squeeze", F.coalesce(known & (_c("bb_width") <= F.percentile("bb_width", F.lit(share)).over(w)), F.lit(False)))


def donchian(bars: DataFrame, period: int = 20) -> DataFrame:
    bars = bars.withColumns({"dc_upper": highest(_c("high"), period), "dc_lower": lowest(_c("low"), period)})
    return bars.withColumn("dc_mid", (_c("dc_upper") + _c("dc_lower")) / 2)


def historical_volatility(bars: DataFrame, period: int = 20, year: int = 245) -> DataFrame:
    """Sample deviation of log returns, for a year of ``year`` bars. Prices that aren't positive have no return."""
    ratio = over(_c("close"), before(_c("close")))
    bars = bars.withColumn("_r", F.when(ratio > 0, F.ln(ratio)))
    return bars.withColumn("hv", full(F.stddev_samp("_r").over(last(period)), _c("_r"), period) * F.sqrt(F.lit(float(year)))).drop("_r")


def has_volume(bars: DataFrame) -> DataFrame:
    """(symbol, timeframe, has_volume): whether a series' known volumes are more than 0 together."""
    return bars.groupBy("symbol", "timeframe").agg((F.coalesce(F.sum("volume"), F.lit(0.0)) > 0).alias("has_volume"))


def volume_averages(bars: DataFrame, period: int = 20) -> DataFrame:
    """``vol_sma``, and ``rel_volume``: the volume over the mean of the ``period`` bars before."""
    return bars.withColumns({"vol_sma": mean(_c("volume"), period), "rel_volume": over(_c("volume"), mean(_c("volume"), period, skip=1))})


def on_balance_volume(bars: DataFrame) -> DataFrame:
    """Running sum of the volume with the sign of the close's change, from the first bar's volume."""
    change = _c("close") - before(_c("close"))
    bars = bars.withColumn("_v", F.coalesce(F.signum(change) * _c("volume"), F.lit(0.0)))
    return bars.withColumn("obv", F.sum("_v").over(so_far()) + F.first("volume").over(so_far())).drop("_v")


def _flow() -> Column:
    """Where the close lies in the bar's range, from -1 to 1; 0 in a bar without a range."""
    return F.coalesce(over((_c("close") - _c("low")) - (_c("high") - _c("close")), _c("high") - _c("low")), F.lit(0.0))


def accumulation(bars: DataFrame) -> DataFrame:
    return bars.withColumn("ad", F.sum(_flow() * _c("volume")).over(so_far()))


def money_flow(bars: DataFrame, period: int = 20) -> DataFrame:
    return bars.withColumn("cmf", over(total(_flow() * _c("volume"), period), total(_c("volume"), period)))


def money_flow_index(bars: DataFrame, period: int = 14) -> DataFrame:
    bars = bars.withColumn("_t", (_c("high") + _c("low") + _c("close")) / 3)
    change, flow = _c("_t") - before(_c("_t")), _c("_t") * _c("volume")
    bars = bars.withColumns({"_up": F.when(change > 0, flow).when(change.isNotNull(), 0.0), "_down": F.when(change < 0, flow).when(change.isNotNull(), 0.0)})
    up, down = total(_c("_up"), period), total(_c("_down"), period)
    return bars.withColumn("mfi", over(100 * up, up + down)).drop("_t", "_up", "_down")


def volume_dry_up(bars: DataFrame, short: int = 5, long: int = 50, share: float = 0.6) -> DataFrame:
    return bars.withColumn("vol_dry_up", F.coalesce(mean(_c("volume"), short) < share * mean(_c("volume"), long), F.lit(False)))


def volume_price_divergence(bars: DataFrame, period: int = 20) -> DataFrame:
    """1 where the close fell and ``obv`` rose over ``period`` bars, -1 the other way round, else 0."""
    price, flow = _c("close") - before(_c("close"), period), _c("obv") - before(_c("obv"), period)
    return bars.withColumn("vol_price_div", F.when((price < 0) & (flow > 0), 1).when((price > 0) & (flow < 0), -1).otherwise(0))
