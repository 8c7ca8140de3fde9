"""Indicators whose value depends on their own last value: one grouped pass computes all of a series.

A series is sequential by nature; different series run side by side. ``recursive`` appends the columns that are asked
for and nothing else, so that an unused one costs nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tapeworks.sources.bars import SERIES

NAN = float("nan")


def smooth(x: np.ndarray, period: int, alpha: float) -> np.ndarray:
    """Exponential smoothing from the mean of the first ``period`` known values; a gap keeps the last value.

    A gap among those first values makes it an average that starts at the first value and passes over gaps.
    """
    out = np.full(len(x), NAN)
    known = np.flatnonzero(~np.isnan(x))
    if not len(known) or len(x) - known[0] < period:
        return out
    start = known[0] + period - 1
    head = x[known[0] : start + 1]
    if np.isnan(head).any():
        start, value = known[0], x[known[0]]
    else:
        value = head.mean()
    tail = pd.Series(np.concatenate([[value], x[start + 1 :]]))
    out[start:] = tail.ewm(alpha=alpha, adjust=False, ignore_na=True).mean()
    return out


def ema(x: np.ndarray, period: int) -> np.ndarray:
    return smooth(x, period, 2 / (period + 1))


def wilder(x: np.ndarray, period: int) -> np.ndarray:
    return smooth(x, period, 1 / period)


def true_range(b: dict[str, np.ndarray]) -> np.ndarray:
    prev = np.concatenate([[NAN], b["close"][:-1]])
    tr = np.maximum(b["high"] - b["low"], np.maximum(np.abs(b["high"] - prev), np.abs(b["low"] - prev)))
    return tr


def scale(b: dict[str, np.ndarray], period: int = 14) -> np.ndarray:
    """Average true range that is known from the first bar on: a running mean until the smoothing starts; never 0."""
    tr = true_range(b)
    if len(tr):
        tr[0] = b["high"][0] - b["low"][0]
    a = wilder(tr, period)
    warm = np.nancumsum(tr) / np.maximum(np.cumsum(~np.isnan(tr)), 1)
    return np.maximum(np.where(np.isnan(a), warm, a), 1e-9)


def rsi(b: dict[str, np.ndarray], period: int = 14) -> np.ndarray:
    change = np.diff(b["close"], prepend=NAN)
    gain, loss = wilder(np.maximum(change, 0), period), wilder(np.maximum(-change, 0), period)
    with np.errstate(all="ignore"):
        out = 100 - 100 / (1 + gain / loss)
    out[(loss == 0) & ~np.isnan(gain)] = 100
    out[(loss == 0) & (gain == 0)] = 50
    return out


def macd(b: dict[str, np.ndarray], fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, ...]:
    line = ema(b["close"], fast) - ema(b["close"], slow)
    mean = ema(line, signal)
    return line, mean, line - mean


def directional(b: dict[str, np.ndarray], period: int = 14) -> tuple[np.ndarray, ...]:
    """ADX, +DI and -DI."""
    up, down = np.diff(b["high"], prepend=NAN), -np.diff(b["low"], prepend=NAN)
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    plus[:1] = minus[:1] = NAN
    with np.errstate(all="ignore"):
        ranged = wilder(true_range(b), period)
        pdi, mdi = 100 * wilder(plus, period) / ranged, 100 * wilder(minus, period) / ranged
        both = pdi + mdi
        dx = np.where(both == 0, NAN, 100 * np.abs(pdi - mdi) / both)
    return wilder(dx, period), pdi, mdi


def supertrend(b: dict[str, np.ndarray], period: int = 10, width: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """The trailing band in force, and 1 or -1 for the side it is on; 0 before the true range is known."""
    reach, middle = width * wilder(true_range(b), period), (b["high"] + b["low"]) / 2
    line, side = np.full(len(reach), NAN), np.zeros(len(reach))
    upper, lower, close = (middle + reach).tolist(), (middle - reach).tolist(), b["close"].tolist()
    above = below = NAN
    now = 0
    for i in np.flatnonzero(~np.isnan(reach)).tolist():
        hi, lo = upper[i], lower[i]
        if not now:
            above, below, now = hi, lo, 1
        else:
            above = hi if hi < above or close[i - 1] > above else above
            below = lo if lo > below or close[i - 1] < below else below
            now = (-1 if close[i] < below else 1) if now == 1 else (1 if close[i] > above else -1)
        line[i], side[i] = (below if now == 1 else above), now
    return line, side


def parabolic(b: dict[str, np.ndarray], step: float = 0.02, most: float = 0.2) -> np.ndarray:
    """Stop and reverse: the stop moves by a growing share towards the extreme, within the last two bars' range."""
    high, low = b["high"].tolist(), b["low"].tolist()
    out = np.full(len(high), NAN)
    if len(high) < 2:
        return out
    sign = -1 if low[0] - low[1] > max(0.0, high[1] - high[0]) else 1
    far, near = (high, low) if sign > 0 else (low, high)  # the extreme's side and the stop's side
    stop, extreme, pace = near[0], far[1], step
    for i in range(1, len(high)):
        if i > 1:
            stop += pace * (extreme - stop)
        inner = near[max(0, i - 2) : i]
        stop = min(stop, *inner) if sign > 0 else max(stop, *inner)
        if sign * (near[i] - stop) < 0:
            sign, far, near = -sign, near, far
            stop, extreme, pace = extreme, far[i], step
            edge = near[i - 1 : i + 1]
            stop = min(stop, *edge) if sign > 0 else max(stop, *edge)
        elif sign * (far[i] - extreme) > 0:
            extreme, pace = far[i], min(pace + step, most)
        out[i] = stop
    return out


def keltner(b: dict[str, np.ndarray], period: int = 20, ranged: int = 10, width: float = 2.0) -> tuple[np.ndarray, ...]:
    middle, reach = ema(b["close"], period), width * wilder(true_range(b), ranged)
    return middle, middle + reach, middle - reach


KERNELS: dict[tuple[str, ...], Callable[[dict[str, np.ndarray]], object]] = {
    **{(f"ema_{p}",): (lambda b, p=p: ema(b["close"], p)) for p in (9, 20, 50, 100, 200)},
    ("atr",): lambda b: wilder(true_range(b), 14),
    ("scale",): scale,
    ("rsi",): rsi,
    ("macd", "macd_signal", "macd_hist"): macd,
    ("adx", "plus_di", "minus_di"): directional,
    ("supertrend", "supertrend_dir"): supertrend,
    ("psar",): parabolic,
    ("kc_mid", "kc_upper", "kc_lower"): keltner,
}


def recursive(bars: DataFrame, *columns: str) -> DataFrame:
    """``bars`` with the named columns of ``KERNELS``; null where they are not defined yet."""
    used = {names: f for names, f in KERNELS.items() if set(names) & set(columns)}
    inputs = ["open", "high", "low", "close"]

    def run(series: pa.Table) -> pa.Table:
        series = series.sort_by("i")
        b = {c: series[c].cast(pa.float64()).to_numpy() for c in inputs}
        found = {}
        for names, f in used.items():
            values = f(b)
            found |= dict(zip(names, values if isinstance(values, tuple) else (values,), strict=True))
        for name in columns:
            series = series.append_column(name, pa.array(found[name], pa.float64(), from_pandas=True))
        return pa.table([series[f.name].cast(f.type) for f in kinds], schema=kinds)  # times of the session's zone go back as UTC

    schema = T.StructType([*bars.schema.fields, *(T.StructField(c, T.DoubleType()) for c in columns)])
    kinds = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    return bars.groupBy(*SERIES).applyInArrow(run, schema)


SWINGS = "symbol string, timeframe string, k int, idx int, price double, kind string, confirmed_idx int, provisional boolean"


Turn = tuple[int, float, str, int, bool]
#: What a walk over the turns knows behind a bar: the side that it seeks ("" before the first turn), and the running high and low with their places.
WalkState = tuple[str, int, float, int, float]
START: WalkState = ("", -1, NAN, -1, NAN)


def walk(state: WalkState, high: list[float], low: list[float], least: list[float], first: int = 0) -> tuple[list[Turn], WalkState]:
    """The turns that bars from place ``first`` on confirm, and the state behind them; so a walk may stop and go on anywhere.

    A turn is confirmed at the bar that is ``least`` away from it. An equal or further extreme moves the turn on, and does
    so rather than confirm on the same bar.
    """
    seeking, top_at, top, bottom_at, bottom = state
    out = []
    for i, (h, l, m) in enumerate(zip(high, low, least, strict=True), first):  # noqa: E741
        if seeking == "H":
            if h >= top:
                top_at, top = i, h
            elif top - l >= m:
                out.append((top_at, top, "H", i, False))
                seeking, bottom_at, bottom = "L", i, l
        elif seeking == "L":
            if l <= bottom:
                bottom_at, bottom = i, l
            elif h - bottom >= m:
                out.append((bottom_at, bottom, "L", i, False))
                seeking, top_at, top = "H", i, h
        elif top_at < 0:
            top_at, top, bottom_at, bottom = i, h, i, l
        else:
            if h > top:
                top_at, top = i, h
            if l < bottom:
                bottom_at, bottom = i, l
            if top - bottom >= m and top_at != bottom_at and i in (top_at, bottom_at):
                seeking = "H" if top_at > bottom_at else "L"
                out.append((bottom_at, bottom, "L", i, False) if seeking == "H" else (top_at, top, "H", i, False))
    if seeking == "H":  # the other side begins anew with the next turn
        bottom_at, bottom = -1, NAN
    elif seeking == "L":
        top_at, top = -1, NAN
    return out, (seeking, top_at, top, bottom_at, bottom)


def running(state: WalkState, last: int) -> list[Turn]:
    """The running extreme as a provisional turn, seen at bar ``last``; none before the first turn."""
    seeking, top_at, top, bottom_at, bottom = state
    return [(top_at, top, "H", last, True) if seeking == "H" else (bottom_at, bottom, "L", last, True)] if seeking else []


def turns(b: dict[str, np.ndarray], a: np.ndarray, width: float = 2.0) -> list[Turn]:
    """(index, price, kind, confirmed at, provisional) of alternating highs and lows, see ``walk``; the running extreme comes last."""
    out, state = walk(START, b["high"].tolist(), b["low"].tolist(), (width * a).tolist())
    return out + running(state, len(a) - 1)


def zigzag(bars: DataFrame, width: float = 2.0) -> DataFrame:
    """The swings of each series: (symbol, timeframe, k, idx, price, kind, confirmed_idx, provisional)."""

    def run(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("i")
        b = {c: series[c].to_numpy(float) for c in ("high", "low", "close")}
        found = turns(b, scale(b), width)
        rows = [(series["symbol"].iloc[0], series["timeframe"].iloc[0], k, *x) for k, x in enumerate(found)]
        return pd.DataFrame(rows, columns=["symbol", "timeframe", "k", "idx", "price", "kind", "confirmed_idx", "provisional"])

    return bars.select(*SERIES, "i", "high", "low", "close").groupBy(*SERIES).applyInPandas(run, SWINGS)
