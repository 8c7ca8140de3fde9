"""SQL of the indicator frame and its snapshot, put together from that of the single indicators."""

from __future__ import annotations

from tapeworks.plans.oracle import HOURLY, LINES, PER, indicators

#: Which query's SQL gives which columns of the frame.
COLUMNS = {
    "ind01_sma": [f"sma_{p}" for p in (10, 20, 50, 100, 200)], "ind02_ema": [f"ema_{p}" for p in (9, 20, 50, 100, 200)], "ind13_rsi": ["rsi"], "ind14_macd": ["macd", "macd_signal", "macd_hist"], "ind21_atr": ["atr"],
    "ind25_keltner": ["kc_mid", "kc_upper", "kc_lower"], "ind07_adx": ["adx", "plus_di", "minus_di"], "ind08_supertrend": ["supertrend", "supertrend_dir"], "ind10_parabolic_sar": ["psar"], "ind15_stochastic": ["stoch_k", "stoch_d"],
    "ind16_stochastic_rsi": ["stochrsi_k", "stochrsi_d"], "ind17_rate_of_change": ["roc"], "ind18_momentum": ["momentum"], "ind19_commodity_channel": ["cci"], "ind20_williams_r": ["williams_r"],
    "ind23_bollinger": ["bb_mid", "bb_upper", "bb_lower", "bb_width", "bb_pct_b"], "ind24_bollinger_squeeze": ["bb_squeeze"], "ind26_donchian": ["dc_upper", "dc_lower", "dc_mid"], "ind27_historical_volatility": ["hv"],
    "ind09_ichimoku": ["ichimoku_tenkan", "ichimoku_kijun", "ichimoku_span_b_raw", "ichimoku_span_a_raw", "ichimoku_cloud_a", "ichimoku_cloud_b"], "ind05_linear_regression": ["linreg_mid", "linreg_slope", "linreg_upper", "linreg_lower"],
    "ind29_volume_averages": ["vol_sma", "rel_volume"], "ind31_on_balance_volume": ["obv"], "ind32_accumulation": ["ad"], "ind33_money_flow": ["cmf"], "ind34_money_flow_index": ["mfi"], "ind35_volume_dry_up": ["vol_dry_up"],
    "ind36_volume_price_divergence": ["vol_price_div"], "ind11_session_vwap": ["vwap"],
}
SNAPSHOT = ("ind01_sma", "ind02_ema", "ind13_rsi", "ind14_macd", "ind21_atr", "ind07_adx", "ind23_bollinger", "ind24_bollinger_squeeze", "ind27_historical_volatility", "ind29_volume_averages", "ind31_on_balance_volume", "ind33_money_flow")


def unrounded(sql: str) -> str:
    """An indicator's SQL without the six decimals of its last selection."""
    head, tail = sql.rsplit("SELECT symbol, i, ", 1)
    return f"{head}SELECT symbol, i, {tail.replace('round(', '(').replace(', 6) AS', ') AS')}"


def frames() -> dict[str, str]:
    of = indicators()
    counts = [f"(SELECT symbol, {', '.join(f'count({c}) AS {c}' for c in names)} FROM ({of[q]}) GROUP BY symbol)" for q, names in COLUMNS.items()]
    turn = lambda x, n: f"CASE WHEN {x} > lag({x}, {n}) OVER p THEN 'rising' WHEN {x} < lag({x}, {n}) OVER p THEN 'falling' WHEN {x} = lag({x}, {n}) OVER p THEN 'flat' END"
    joined = " ".join(f"JOIN ({unrounded(of[q]).replace(HOURLY, LINES)}) x{k} USING (symbol, i)" for k, q in enumerate(SNAPSHOT))
    rows = (
        f"SELECT *, count(*) OVER (PARTITION BY symbol) AS n, sum(volume) OVER (PARTITION BY symbol) > 0 AS has_volume, lag(close) OVER p AS prev, {turn('rsi', 3)} AS rsi_direction, {turn('obv', 10)} AS obv_direction, {turn('macd_hist', 1)} AS hist_direction, lag(macd_hist) OVER p AS hb, "
        f"sma_50 - sma_200 AS d, lag(sma_50 - sma_200, 5) OVER p AS db, min(rsi) OVER (p ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS rl, count(rsi) OVER (p ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS rk FROM bars {joined} WINDOW p AS ({PER})"
    )
    shown = [
        "symbol", "n", *(f"round({x}, 6) AS {x}" for x in ("close", "atr", "hv", "rsi", "macd", "macd_signal", "macd_hist", "bb_upper", "bb_lower", "bb_mid", "bb_pct_b", "rel_volume", "cmf", "adx", "plus_di", "minus_di")), "round(100 * (close / prev - 1), 6) AS change_pct", "round(100 * atr / close, 6) AS atr_pct", "has_volume",
        *(f"close > {x} AS above_{x}" for x in ("sma_20", "sma_50", "sma_100", "sma_200", "ema_20", "ema_50", "ema_100", "ema_200")), "rsi_direction", "obv_direction", "hist_direction", "bb_squeeze", "CASE WHEN rsi >= 70 THEN 'overbought' WHEN rsi <= 30 THEN 'oversold' WHEN rsi IS NOT NULL THEN 'neutral' END AS rsi_zone",
        "CASE WHEN macd > macd_signal THEN 'above_signal' WHEN macd <= macd_signal THEN 'below_signal' END AS macd_state", "CASE WHEN macd_signal IS NULL THEN NULL WHEN macd > 0 THEN 'above' WHEN macd <= 0 THEN 'below' END AS macd_zero",
        "CASE WHEN macd_hist > 0 AND hb <= 0 THEN 'bullish_cross_this_bar' WHEN macd_hist < 0 AND hb >= 0 THEN 'bearish_cross_this_bar' END AS macd_cross",
        "CASE WHEN close > bb_upper THEN 'above_upper' WHEN close < bb_lower THEN 'below_lower' WHEN bb_pct_b >= 0.5 THEN 'upper_half' WHEN bb_upper IS NOT NULL THEN 'lower_half' END AS bb_position",
        "CASE WHEN adx >= 25 THEN 'strong' WHEN adx >= 20 THEN 'developing' WHEN adx IS NOT NULL THEN 'weak' END AS adx_strength", "d > 0 AND db <= 0 AND n > 205 AS golden_cross", "d < 0 AND db >= 0 AND n > 205 AS death_cross", "rk = 6 AND rl < 30 AND rsi >= 30 AS oversold_recovery",
    ]
    return {
        "ind37_frame": f"SELECT * FROM {counts[0]} c0 " + " ".join(f"JOIN {x} c{k} USING (symbol)" for k, x in enumerate(counts) if k),
        "ind38_snapshot": f"WITH RECURSIVE {LINES}, fr AS ({rows}) SELECT {', '.join(shown)} FROM fr WHERE i = n - 1",
    }
