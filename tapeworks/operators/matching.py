"""Drawn price paths found in data: a similarity join of drawings with every window of every series.

A drawing is a path of closes in any unit, as read off a chart. It matches where the correlation of prices and that of
their changes with some window of as many bars are high enough. Series are cut into blocks that overlap by a drawing's
length, so that a long one is many tasks. Inside a block all windows meet all drawings of a length as one product, and
what leaves it is the best window of each drawing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.sources.bars import SERIES

# Least correlation of prices and of changes, how far below the first a window is still shown.
PRICE, CHANGE, NEAR = 0.95, 0.8, 0.05
#: Windows that end in one block of a series, drawings that are compared at once, points of drawings that go along with one pass over the bars.
BLOCK, TILE, POINTS = 4096, 256, 1_000_000
#: Sums of two correlations that are equal to so many digits are ties; the earlier window wins.
DIGITS = 9
FOUND = "symbol string, timeframe string, drawing_id string, price double, change double, end_i int"


def _shapes(drawings: DataFrame) -> DataFrame:
    """(drawing_id, symbol, log, path): one row for each drawing of rows (drawing_id, k, close, and perhaps symbol, log)."""
    symbol = F.col("symbol") if "symbol" in drawings.columns else F.lit(None).cast("string")
    log = F.coalesce(F.col("log"), F.lit(False)) if "log" in drawings.columns else F.lit(False)
    rows = drawings.select(F.col("drawing_id").cast("string").alias("drawing_id"), "k", F.col("close").cast("double").alias("close"), symbol.alias("symbol"), log.alias("log")).where("close is not null")
    path = F.transform(F.array_sort(F.collect_list(F.struct("k", "close"))), lambda p: p["close"])
    return rows.groupBy("drawing_id").agg(F.min("symbol").alias("symbol"), F.max("log").alias("log"), path.alias("path"))


def _correlation(paths: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Of each window (row) with each path (column); NaN where either is constant."""
    p = paths - paths.mean(axis=1, keepdims=True)
    w = windows - windows.mean(axis=1, keepdims=True)
    flat = np.ptp(windows, axis=1) == 0
    with np.errstate(all="ignore"):
        p = p / np.sqrt((p * p).sum(axis=1, keepdims=True))
        w = w / np.sqrt((w * w).sum(axis=1, keepdims=True))
    w[flat] = np.nan
    return w @ p.T


def _best(close: np.ndarray, first: int, symbol: str, shapes: list[tuple], own: int) -> Iterator[tuple]:
    """(drawing, price, change, end) of the best window of each drawing; ends before ``own`` are another block's."""
    groups: dict[tuple[int, bool], list[tuple]] = {}
    for drawing, only, log, path in shapes:
        if only in (None, symbol):
            groups.setdefault((len(path), log), []).append((drawing, path))
    for (n, log), group in groups.items():
        start = max(0, own - first - n + 1)
        x = close[start:]
        if n < 2 or len(x) < n:
            continue
        with np.errstate(all="ignore"):
            windows = np.lib.stride_tricks.sliding_window_view(np.log(x) if log else x, n)
        for low in range(0, len(group), TILE):
            part = group[low : low + TILE]
            paths = np.array([path for _, path in part])
            price = _correlation(paths, windows)
            change = _correlation(np.diff(paths), np.diff(windows))
            both = np.where(price >= PRICE - NEAR, np.round(price + change, DIGITS), np.nan)
            for j, (drawing, _) in enumerate(part):
                if not np.isnan(both[:, j]).all():
                    at = int(np.nanargmax(both[:, j]))
                    yield drawing, float(price[at, j]), float(change[at, j]), first + start + at + n - 1


def _pass(bars: DataFrame, shapes: list[tuple], block: int) -> DataFrame:
    """The best windows of some drawings, a row for each drawing, series and block that has one."""
    halo = max(len(path) for *_, path in shapes) - 1

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        symbol, timeframe, b = (rows[c][0].as_py() for c in ("symbol", "timeframe", "block"))
        close = rows["close"].to_numpy()
        out = [(symbol, timeframe, *x) for x in _best(close, rows["i"][0].as_py(), symbol, shapes, b * block)]
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

    i = F.col("i").cast("long")
    blocks = F.sequence(F.floor(i / block), F.least(F.floor((i + halo) / block), F.floor(F.col("_last") / block)))
    last = F.max("i").over(Window.partitionBy(*SERIES)).cast("long")
    cut = bars.select(*SERIES, i.alias("i"), F.col("close").cast("double").alias("close"), last.alias("_last")).select(*SERIES, "i", "close", F.explode(blocks).alias("block"))
    return cut.groupBy(*SERIES, "block").applyInArrow(run, FOUND)


def _passes(shapes: DataFrame, points: int) -> Iterator[list[tuple]]:
    """The drawings in lots of at most ``points`` points (or one drawing), as they come to the driver."""
    lot: list[tuple] = []
    held = 0
    for r in shapes.toLocalIterator():
        if lot and held + len(r["path"]) > points:
            yield lot
            lot, held = [], 0
        lot.append((r["drawing_id"], r["symbol"], r["log"], r["path"]))
        held += len(r["path"])
    if lot:
        yield lot


def match(drawings: DataFrame, bars: DataFrame, block: int = BLOCK, points: int = POINTS) -> DataFrame:
    """(drawing_id, symbol, timeframe, price_correlation, return_correlation, end_i, n, matched): where each drawing lies in each series.

    ``drawings(drawing_id, k, close)`` are paths in the order of ``k``; with a ``symbol`` only its series are looked at,
    with ``log`` they are compared with the logarithms of prices. A row is the window with the largest sum of both
    correlations among those whose prices correlate to 0.9 at least, of equal ones the earliest; it is ``matched`` from
    0.95 for the prices and 0.8 for their changes. Series without such a window, those that are shorter than a drawing
    among them, have no row, nor have constant windows and drawings of under two points. Rows without a close are no
    points; an empty table gives no rows. Every further POINTS points of drawings are another pass over the bars.
    """
    shapes = _shapes(drawings)
    lots = [_pass(bars, lot, block) for lot in _passes(shapes, points)]
    if not lots:
        return bars.sparkSession.createDataFrame([], "drawing_id string, symbol string, timeframe string, price_correlation double, return_correlation double, end_i int, n int, matched boolean")
    found = reduce(DataFrame.unionByName, lots)
    best = F.max_by(F.struct("price", "change", "end_i"), F.struct(F.round(F.col("price") + F.col("change"), DIGITS), -F.col("end_i")))
    rows = found.groupBy("drawing_id", *SERIES).agg(best.alias("x")).join(shapes.select("drawing_id", F.size("path").alias("n")), "drawing_id")
    return rows.select("drawing_id", *SERIES, F.col("x.price").alias("price_correlation"), F.col("x.change").alias("return_correlation"), "x.end_i", "n", ((F.col("x.price") >= PRICE) & (F.col("x.change") >= CHANGE)).alias("matched"))


def located(drawings: DataFrame, bars: DataFrame, **options: int) -> DataFrame:
    """(drawing_id, symbol, timeframe, price_correlation, return_correlation, end_ts, n, matched): the best series of each drawing, with the time of its last bar.

    Drawings that no series comes near have a row with nulls that is not matched.
    """
    order = F.struct("matched", F.round(F.col("price_correlation") + F.col("return_correlation"), DIGITS), F.col("symbol"), F.col("timeframe"))
    best = match(drawings, bars, **options).groupBy("drawing_id").agg(F.max_by(F.struct(*SERIES, "price_correlation", "return_correlation", "end_i", "matched"), order).alias("x"))
    rows = best.select("drawing_id", "x.*").join(bars.select(*SERIES, F.col("i").alias("end_i"), F.col("ts").alias("end_ts")), [*SERIES, "end_i"])
    all_ = _shapes(drawings).select("drawing_id", F.size("path").alias("n"))
    return all_.join(rows, "drawing_id", "left").select("drawing_id", *SERIES, "price_correlation", "return_correlation", "end_ts", "n", F.coalesce("matched", F.lit(False)).alias("matched"))


def calibrated(points: DataFrame) -> DataFrame:
    """(drawing_id, log, y1, price1, y2, price2): the price axis that ``points(drawing_id, y, price)`` imply.

    A least-squares line through (y, price), or (y, log price) where ``log`` is true, read at the smallest and the
    largest ``y``. Fewer than two different heights give no row; points without a height or a price count for nothing,
    nor do prices that aren't positive on a logarithmic axis.
    """
    log = F.coalesce(F.col("log"), F.lit(False)) if "log" in points.columns else F.lit(False)
    rows = points.select("drawing_id", F.col("y").cast("double").alias("y"), F.col("price").cast("double").alias("price"), log.alias("log")).where("y is not null and price is not null and (not log or price > 0)")
    rows = rows.withColumn("v", F.when(F.col("log"), F.log("price")).otherwise(F.col("price")))
    fit = rows.groupBy("drawing_id", "log").agg(F.regr_slope("v", "y").alias("slope"), F.regr_intercept("v", "y").alias("start"), F.min("y").alias("y1"), F.max("y").alias("y2")).where("y1 < y2")
    at = lambda y: F.when(F.col("log"), F.exp(F.col("slope") * F.col(y) + F.col("start"))).otherwise(F.col("slope") * F.col(y) + F.col("start"))
    return fit.select("drawing_id", "log", "y1", at("y1").alias("price1"), "y2", at("y2").alias("price2"))


def by_ticks(ticks: DataFrame) -> DataFrame:
    """(drawing_id, y1, price1, y2, price2): the axis between the highest and the lowest of the labels ``ticks(drawing_id, y_frac, price, height)`` of a picture.

    ``y_frac`` is the share of the picture's height from its top. The labels have to span a tenth of it, and prices have
    to rise towards the top, or there is no row; labels outside the picture or without a positive price are left out.
    """
    y = F.round(F.col("y_frac") * F.col("height"), 1)
    rows = ticks.where("y_frac between 0 and 1 and price > 0").select("drawing_id", "height", F.struct(y.alias("y"), F.col("price").cast("double").alias("price")).alias("p"))
    ends = rows.groupBy("drawing_id").agg(F.max("height").alias("height"), F.min("p").alias("a"), F.max("p").alias("b"))
    ends = ends.where((F.col("b.y") - F.col("a.y") > 0.1 * F.col("height")) & (F.col("a.price") > F.col("b.price")))
    return ends.select("drawing_id", F.col("a.y").alias("y1"), F.col("a.price").alias("price1"), F.col("b.y").alias("y2"), F.col("b.price").alias("price2"))


def _price(axis_log: Column, y: Column) -> Column:
    """The price at a height of an axis (y1, price1, y2, price2)."""
    c = F.col
    share = (y - c("y1")) / (c("y2") - c("y1"))
    return F.when(axis_log, F.exp(F.log("price1") + share * (F.log("price2") - F.log("price1")))).otherwise(c("price1") + share * (c("price2") - c("price1")))


def priced(pixels: DataFrame, axes: DataFrame) -> DataFrame:
    """(drawing_id, k, open, high, low, close, uncertainty): candles in pixels (drawing_id, k, y_open, y_high, y_low, y_close) as prices.

    ``axes`` have a row (y1, price1, y2, price2, and perhaps ``log``) for each drawing; candles without one have no row.
    The high and the low are widened to hold all four prices. ``uncertainty`` is what one and a half pixels are worth at
    the median of a drawing's closes.
    """
    c = F.col
    log = F.coalesce(c("log"), F.lit(False)) if "log" in axes.columns else F.lit(False)
    rows = pixels.select("drawing_id", "k", *(c(f"y_{x}").cast("double").alias(f"y_{x}") for x in ("open", "high", "low", "close"))).join(axes.select("drawing_id", "y1", "price1", "y2", "price2", log.alias("_log")), "drawing_id")
    four = {x: _price(c("_log"), c(f"y_{x}")) for x in ("open", "high", "low", "close")}
    rows = rows.withColumns(four | {"pixel": F.abs(_price(c("_log"), c("y_close") + 0.5) - _price(c("_log"), c("y_close") - 0.5))})
    each = rows.groupBy("drawing_id").agg((1.5 * F.median("pixel")).alias("uncertainty"))
    wide = rows.withColumns({"high": F.greatest("open", "high", "low", "close"), "low": F.least("open", "high", "low", "close")})
    return wide.join(each, "drawing_id").select("drawing_id", "k", "open", "high", "low", "close", "uncertainty")


def _tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(name), "&", "and"), r"[-\s]+"), lambda t: t != ""))


def supported(claims: DataFrame, found: DataFrame) -> DataFrame:
    """``claims(drawing_id, claim_id, name)`` with ``matched``, the first by ``place`` of the patterns ``found(drawing_id, place, name)`` that shares enough words, and ``supported``.

    Enough are all but one of the claim's words of three letters and more, and one at least. Null and shorter names are
    supported by nothing. A drawing's claims meet its patterns by the words they share.
    """
    own = claims.select("drawing_id", "claim_id", F.filter(_tokens(F.col("name")), lambda t: F.length(t) > 2).alias("words"))
    words = own.select("drawing_id", "claim_id", F.size("words").alias("n"), F.explode("words").alias("word"))
    shared = words.join(found.select("drawing_id", "place", F.col("name").alias("matched"), F.explode(_tokens(F.col("name"))).alias("word")), ["drawing_id", "word"])
    enough = shared.groupBy("drawing_id", "claim_id", "place", "matched").agg(F.count("*").alias("both"), F.max("n").alias("n")).where("both >= greatest(1, n - 1)")
    first = enough.groupBy("drawing_id", "claim_id").agg(F.min(F.struct("place", "matched")).alias("x")).select("drawing_id", "claim_id", "x.matched")
    return claims.join(first, ["drawing_id", "claim_id"], "left").withColumn("supported", F.col("matched").isNotNull())
