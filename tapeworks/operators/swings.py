"""Fractal swings, labels and trend, all by windows and joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.rolling import series
from tapeworks.operators.recursive import zigzag
from tapeworks.sources.bars import SERIES


def fractals(bars: DataFrame, n: int = 3) -> DataFrame:
    """Alternating swings (symbol, timeframe, idx, price, kind, confirmed_idx).

    A bar is a high if no bar within ``n`` is higher and the ``n`` before are lower; lows the other way round. It is
    known ``n`` bars later. Of swings of one kind in a row the most extreme stays, of equal ones the first.
    """
    around, earlier = series().rowsBetween(-n, n), series().rowsBetween(-n, -1)
    inside = (F.count("*").over(around) == 2 * n + 1)
    high = inside & (F.col("high") == F.max("high").over(around)) & (F.col("high") > F.max("high").over(earlier))
    low = inside & (F.col("low") == F.min("low").over(around)) & (F.col("low") < F.min("low").over(earlier))
    bars = bars.withColumns({"_high": high, "_low": low})
    kinds = F.array_compact(F.array(F.when(F.col("_high"), F.struct(F.lit("H").alias("kind"), F.col("high").alias("price"))), F.when(F.col("_low"), F.struct(F.lit("L").alias("kind"), F.col("low").alias("price")))))
    raw = bars.select(*SERIES, F.col("i").alias("idx"), F.explode(kinds).alias("x")).select(*SERIES, "idx", "x.kind", "x.price")
    order = Window.partitionBy(*SERIES).orderBy("idx", "kind")
    run = F.sum(F.when(F.col("kind") == F.lag("kind").over(order), 0).otherwise(1)).over(order)
    extreme = F.struct(F.when(F.col("kind") == "H", F.col("price")).otherwise(-F.col("price")), -F.col("idx"))
    kept = raw.withColumn("run", run).groupBy(*SERIES, "run", "kind").agg(F.max_by("price", extreme).alias("price"), F.max_by("idx", extreme).alias("idx"))
    return kept.select(*SERIES, "idx", "price", "kind", (F.col("idx") + n).alias("confirmed_idx"))


def prominent(x: np.ndarray, least: float, distance: int) -> list[int]:
    """Places of peaks (the middle of flat ones) at least ``distance`` apart, higher ones first, that stand ``least`` above the higher of the valleys on both sides."""
    edge = np.flatnonzero(np.diff(x)) + 1
    starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(x)]]) - 1
    level = x[starts]
    inner = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    peaks = (starts[inner] + ends[inner]) // 2
    kept = np.ones(len(peaks), bool)
    for k in np.argsort(x[peaks], kind="stable")[::-1]:
        if kept[k]:
            kept &= (np.abs(peaks - peaks[k]) >= distance) | (np.arange(len(peaks)) == k)
    out = []
    for p in peaks[kept].tolist():
        higher = np.flatnonzero(x > x[p])
        left, right = higher[higher < p].max(initial=-1) + 1, higher[higher > p].min(initial=len(x))
        if x[p] - max(x[left : p + 1].min(), x[p:right].min()) >= least:
            out.append(p)
    return out


def peaks(bars: DataFrame, width: float = 2.0, distance: int = 3) -> DataFrame:
    """Swings of closes by prominence: ``width`` times the median of ``scale``. They look ahead, so they are for drawing alone.

    (symbol, timeframe, idx, price, kind, confirmed_idx), alternating; a series is one pandas group.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        x, least = frame["close"].to_numpy(float), max(width * float(frame["scale"].median()), 1e-9)
        found = [(i, x[i], "H") for i in prominent(x, least, distance)] + [(i, x[i], "L") for i in prominent(-x, least, distance)]
        out: list[tuple] = []
        for one in sorted(found):
            if out and out[-1][2] == one[2]:
                if (one[1] > out[-1][1]) == (one[2] == "H") and one[1] != out[-1][1]:
                    out[-1] = one
            else:
                out.append(one)
        first = frame.iloc[0]
        return pd.DataFrame([(first["symbol"], first["timeframe"], *o, o[0]) for o in out], columns=["symbol", "timeframe", "idx", "price", "kind", "confirmed_idx"])

    return bars.select(*SERIES, "i", "close", "scale").groupBy(*SERIES).applyInPandas(run, "symbol string, timeframe string, idx int, price double, kind string, confirmed_idx int")


def detect(bars: DataFrame, method: str = "zigzag") -> DataFrame:
    """Confirmed swings of ``bars`` with ``scale`` by ``zigzag``, ``fractal`` or ``peaks``: (symbol, timeframe, idx, price, kind, confirmed_idx)."""
    if method == "fractal":
        return fractals(bars)
    if method == "peaks":
        return peaks(bars)
    if method != "zigzag":
        raise ValueError(f"unknown method {method}")
    return zigzag(bars).where("not provisional").select(*SERIES, "idx", "price", "kind", "confirmed_idx")


def confirmed_upto(swings: DataFrame, bar: int) -> DataFrame:
    """The swings that are known at bar ``bar``."""
    known = F.col("confirmed_idx") <= bar
    return swings.where(known & ~F.col("provisional") if "provisional" in swings.columns else known)


def labelled(swings: DataFrame) -> DataFrame:
    """Confirmed ``swings`` with ``label``: HH or LH for highs, HL or LL for lows, against the last of their kind; equal counts as lower."""
    prev = F.lag("price").over(Window.partitionBy(*SERIES, "kind").orderBy("idx"))
    higher = F.when(F.col("price") > prev, F.lit("H")).otherwise(F.lit("L"))
    return swings.withColumn("label", F.when(prev.isNotNull(), F.concat(higher, F.col("kind"))))


def trend(swings: DataFrame, last: int = 4) -> DataFrame:
    """(symbol, timeframe, trend) from the last four labels: up if three are HH or HL and the fourth, if any, is one too or is the only other one.

    Down likewise with LH and LL, else range. Fewer than three labels leave it undetermined.
    """
    place = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("idx"), F.desc("kind")))
    recent = labelled(swings).withColumn("place", place).where(F.col("place") <= last)
    counts = recent.groupBy(*SERIES).agg(F.count("label").alias("n"), F.count_if(F.col("label").isin("HH", "HL")).alias("up"), F.count_if(F.col("label").isin("LH", "LL")).alias("down"))
    n, up, down = F.col("n"), F.col("up"), F.col("down")
    mostly = lambda x, y: (x >= 3) & ((y == 0) | (n == 4))
    return counts.select(*SERIES, F.when(n < 3, "undetermined").when(mostly(up, down), "uptrend").when(mostly(down, up), "downtrend").otherwise("range").alias("trend"))
