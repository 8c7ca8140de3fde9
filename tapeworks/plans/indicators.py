"""Queries of the indicators over hourly bars: each applies one operator and shows its columns to six decimals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.operators import blocked
from tapeworks.operators import indicators as ind
from tapeworks.operators.recursive import recursive
from tapeworks.sources.bars import hourly_events

Query = Callable[[SparkSession, str], DataFrame]

#: Bars in a block of the queries on long series.
BLOCK = 256


def shown(df: DataFrame, *columns: str, keys: tuple[str, ...] = ("symbol", "i")) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*keys, *(F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in columns))


def of(apply: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    return lambda spark, sf_dir: shown(apply(hourly_events(spark, sf_dir)), *columns)


def of_recursive(*columns: str) -> Query:
    return of(lambda bars: recursive(bars, *columns), *columns)


def blocked_averages(bars: DataFrame) -> DataFrame:
    """In blocks so small that these series have several."""
    return blocked.averages(blocked.indexed(bars.drop("i")), {f"ema_{p}": (F.col("close"), p, blocked.EMA(p)) for p in (9, 20, 50, 100, 200)}, BLOCK)


QUERIES: dict[str, Query] = {
    "ind02_blocked_ema": of(blocked_averages, *(f"ema_{p}" for p in (9, 20, 50, 100, 200))),
    "ind22_blocked_scale": of(lambda b: blocked.scale(b, block=BLOCK), "scale"),
    "ind01_sma": of(ind.sma, *(f"sma_{p}" for p in (10, 20, 50, 100, 200))),
    "ind02_ema": of_recursive(*(f"ema_{p}" for p in (9, 20, 50, 100, 200))),
    "ind04_true_range": of(ind.true_range, "tr"),
    "ind05_linear_regression": of(ind.linear_regression, "linreg_mid", "linreg_slope", "linreg_upper", "linreg_lower"),
    "ind06_crossovers": of(lambda b: ind.crossovers(ind.sma(b, (20, 50)), "sma_20", "sma_50", "ma_cross"), "ma_cross"),
    "ind07_adx": of_recursive("adx", "plus_di", "minus_di"),
    "ind08_supertrend": of_recursive("supertrend", "supertrend_dir"),
    "ind09_ichimoku": of(ind.ichimoku, *(f"ichimoku_{x}" for x in ("tenkan", "kijun", "span_a_raw", "span_b_raw", "cloud_a", "cloud_b"))),
    "ind10_parabolic_sar": of_recursive("psar"),
    "ind11_session_vwap": of(ind.session_vwap, "vwap"),
    "ind13_rsi": of_recursive("rsi"),
    "ind14_macd": of_recursive("macd", "macd_signal", "macd_hist"),
    "ind15_stochastic": of(ind.stochastic, "stoch_k", "stoch_d"),
    "ind16_stochastic_rsi": of(lambda b: ind.stochastic_rsi(recursive(b, "rsi")), "stochrsi_k", "stochrsi_d"),
    "ind17_rate_of_change": of(ind.rate_of_change, "roc"),
    "ind18_momentum": of(ind.momentum, "momentum"),
    "ind19_commodity_channel": of(ind.commodity_channel, "cci"),
    "ind20_williams_r": of(ind.williams_r, "williams_r"),
    "ind21_atr": of_recursive("atr"),
    "ind22_scale": of_recursive("scale"),
    "ind23_bollinger": of(ind.bollinger, "bb_mid", "bb_upper", "bb_lower", "bb_width", "bb_pct_b"),
    "ind24_bollinger_squeeze": of(lambda b: ind.bollinger_squeeze(ind.bollinger(b)), "bb_squeeze"),
    "ind25_keltner": of_recursive("kc_mid", "kc_upper", "kc_lower"),
    "ind26_donchian": of(ind.donchian, "dc_upper", "dc_lower", "dc_mid"),
    "ind27_historical_volatility": of(ind.historical_volatility, "hv"),
    "ind28_has_volume": lambda spark, sf_dir: ind.has_volume(hourly_events(spark, sf_dir)).select("symbol", "has_volume"),
    "ind29_volume_averages": of(ind.volume_averages, "vol_sma", "rel_volume"),
    "ind31_on_balance_volume": of(ind.on_balance_volume, "obv"),
    "ind32_accumulation": of(ind.accumulation, "ad"),
    "ind33_money_flow": of(ind.money_flow, "cmf"),
    "ind34_money_flow_index": of(ind.money_flow_index, "mfi"),
    "ind35_volume_dry_up": of(ind.volume_dry_up, "vol_dry_up"),
    "ind36_volume_price_divergence": of(lambda b: ind.volume_price_divergence(ind.on_balance_volume(b)), "vol_price_div"),
}
