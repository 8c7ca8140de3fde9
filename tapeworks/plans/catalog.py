"""The registered queries and their SQL."""

from __future__ import annotations

from tapeworks.plans import book, drawings, frame, indicators, market, oracle, shapes, trading

FLAGSHIP = indicators.QUERIES["ind23_bollinger"]


def queries() -> dict[str, indicators.Query]:
    return {**indicators.QUERIES, **shapes.QUERIES, **market.QUERIES, **trading.QUERIES, **drawings.QUERIES}


def oracle_sql() -> dict[str, str]:
    found = {**drawings.sql(), **oracle.indicators(), **oracle.swings(), **oracle.candles(), **oracle.patterns(), **oracle.structure(), **oracle.resampling(), **oracle.trading(), **oracle.harmonics(), **oracle.levels(), **oracle.timeframes(), **oracle.impulses(), **oracle.alerts(), **book.backtests(), **frame.frames()}
    same = {"ind02_blocked_ema": "ind02_ema", "ind22_blocked_scale": "ind22_scale", "swg01_blocked_zigzag": "swg01_zigzag"}
    return found | {name: found[other] for name, other in same.items()}
