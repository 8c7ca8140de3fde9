"""Chart patterns of consecutive swings, and their life from forming to resolved.

A detector turns runs of swings (``lead``) or windows of bars into candidates: a level to break (a line, if ``slope`` is
not 0), a level that ends it, a target. The life of all candidates of all detectors is one range join with the bars after
them and conditional minima; nothing walks bar by bar. Overlapping patterns of one kind are then thinned out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.rolling import before, mean, over, series
from tapeworks.operators import indicators
from tapeworks.sources.bars import SERIES

# Tolerances in scales (average true ranges) and waits in bars.
BREAK, NEAR, RETEST, FAIL_BARS, WAIT_BARS, AGE_BARS = 0.25, 1.0, 0.6, 15, 60, 250
EQUAL, DEPTH, PRIOR, TREND = 1.0, 2.5, 1.5, 3.0
#: The least height of a pattern in percent, by timeframe; 3 for days.
HEIGHT_PCT = {"5m": 0.8, "15m": 0.8, "1h": 0.8, "1w": 6.0, "1M": 6.0}
OVERLAP, CURRENT_BARS, RESOLVED_BARS, LEAST_BARS = 0.6, 40, 10, 30
BUCKET = 256
ACTIVE = ("forming", "approaching_confirmation", "confirmed", "retesting")
#: What a candidate may leave out: ``slope`` and ``at`` make the level a line through it at bar ``at``, likewise those of
#: ``inval``. ``reach`` is a distance from the level at the break to the target shown, which is also the one awaited if
#: ``retarget``. ``need`` is a price that an unconfirmed one must have come to. ``rule``: 1 drops those that are
#: invalidated without a break or miss ``need``, 2 all without a break, 3 keeps those that end at the last bar forming.
#: 4 is for pairs of lines. ``shown_end`` is where it ends, if that isn't ``last_idx``, after which it is watched. ``shown_inval`` is shown for ``inval``, along ``stop_slope`` from bar 0. Past ``apex`` an unbroken one is invalidated.
#: Candidates with one ``pair`` are one pattern whose direction the break decides.
OPTIONS = {
    "slope": (0.0, "double"), "at": (0, "int"), "inval_slope": (0.0, "double"), "inval_at": (0, "int"), "reach": (None, "double"), "retarget": (False, "boolean"), "wait": (WAIT_BARS, "int"),
    "need": (None, "double"), "rule": (0, "int"), "points": (None, "array<int>"), "shown_inval": (None, "double"), "pair": (None, "bigint"), "unsure": (False, "boolean"),
    "stop_slope": (0.0, "double"), "apex": (None, "double"), "shown_end": (None, "int"),
}
CANDIDATE = [*SERIES, "pattern_id", "sgn", "start_idx", "last_idx", "level", "inval", "target", "parts", "n_parts", *OPTIONS]


def least_height() -> Column:
    """The share of a price that a pattern must be high, by the row's timeframe."""
    return F.coalesce(*(F.when(F.col("timeframe") == t, p / 100) for t, p in HEIGHT_PCT.items()), F.lit(0.03))


def _prior(bars: int) -> Column:
    past = series().rowsBetween(-bars, -1)
    up = (F.col("high") - F.min("low").over(past)) / F.col("scale")
    down = (F.max("high").over(past) - F.col("low")) / F.col("scale")
    return F.when(F.col("i") == 0, 0.0).when(up >= down, up).otherwise(-down)


def context(bars: DataFrame) -> DataFrame:
    """``bars`` with column ``scale``, and what candidates need of a bar: prior move, relative volume, volume around it.

    A column ``complete``, whether a bar has ended, is kept; without one all have.
    """
    w = series()
    average = F.when(F.count("volume").over(w.rowsBetween(-20, -1)) >= 20, F.avg("volume").over(w.rowsBetween(-20, -1)))
    return bars.withColumns({
        "prior": _prior(40),
        "rel_volume": over(F.col("volume"), average),
        "volume_near": F.avg("volume").over(w.rowsBetween(-2, 2)),
        "last": F.count("*").over(Window.partitionBy(*SERIES)) - 1,
        "complete": F.coalesce("complete", F.lit(True)) if "complete" in bars.columns else F.lit(True),
    })


def pivots(swings: DataFrame, bars: DataFrame, *more: str) -> DataFrame:
    """``swings`` with the context of their bar, and ``more`` columns of it."""
    at = bars.select(*SERIES, F.col("i").alias("idx"), "scale", "prior", "volume_near", "last", *more)
    return swings.join(at, [*SERIES, "idx"])


def runs(swings: DataFrame, n: int, *more: str) -> DataFrame:
    """A row for each ``n`` consecutive swings: columns p1 to pn, structs of a swing's own."""
    w = Window.partitionBy(*SERIES).orderBy("k")
    whole = F.struct("idx", "price", "kind", "provisional", "scale", "prior", "volume_near", "last", *more)
    row = swings.select(*SERIES, "k", whole.alias("p1"))
    return row.withColumns({f"p{j + 1}": F.lead("p1", j).over(w) for j in range(1, n)}).where(f"p{n} is not null")


def closeness(difference: Column, tolerance: Column) -> Column:
    """1 for no difference, 0 from ``tolerance`` on."""
    return F.when(tolerance > 0, F.greatest(F.lit(0.0), 1 - F.abs(difference) / tolerance)).otherwise(0.0)


def _share(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _total(parts: list[Column]) -> list[Column]:
    """The sum of known parts, each clipped to 0 to 1, and how many are known."""
    clipped = [F.when(p.isNotNull(), _share(p)) for p in parts]
    add = lambda a, b: a + b
    return [reduce(add, [F.coalesce(p, F.lit(0.0)) for p in clipped]).alias("parts"), reduce(add, [F.when(p.isNotNull(), 1).otherwise(0) for p in clipped]).alias("n_parts")]


def _filled(candidates: DataFrame) -> DataFrame:
    missing = {name: F.lit(value).cast(kind) for name, (value, kind) in OPTIONS.items() if name not in candidates.columns}
    return candidates.withColumns(missing).select(*CANDIDATE) if missing else candidates.select(*CANDIDATE)


def _candidate(rows: DataFrame, pattern: Column, sgn: Column, level: Column, inval: Column, target: Column, parts: list[Column], n: int = 0, **options: Column) -> DataFrame:
    """Candidates of runs of ``n`` swings; without ``n`` ``start_idx``, ``last_idx`` and ``points`` are among the options."""
    if n:
        options = {"start_idx": F.col("p1.idx"), "last_idx": F.col(f"p{n}.idx"), "unsure": F.col(f"p{n}.provisional"), "points": F.array(*(F.col(f"p{k}.idx").cast("int") for k in range(1, n + 1)))} | options
    return _filled(rows.select(*SERIES, pattern.alias("pattern_id"), sgn.cast("double").alias("sgn"), level.alias("level"), inval.cast("double").alias("inval"), target.alias("target"), *_total(parts), *(x.alias(name) for name, x in options.items())))


def _fading(first: str, last: str) -> Column:
    """1 if the volume around the last extreme is under that around the first, else 0.5; null without volume."""
    a, b = F.col(f"{first}.volume_near"), F.col(f"{last}.volume_near")
    return F.when(a.isNotNull() | b.isNotNull(), F.when(b < a, 1.0).otherwise(0.5))


def doubles(swings: DataFrame) -> DataFrame:
    """Double tops and bottoms: two like extremes around a deep one, after a move."""
    c = F.col
    rows = runs(swings, 3)
    s = F.when(c("p1.kind") == "H", 1.0).otherwise(-1.0)
    a, t, b, scale = c("p1.price"), c("p2.price"), c("p3.price"), c("p3.scale")
    near, far = s * F.least(s * a, s * b), s * F.greatest(s * a, s * b)
    depth, gap, prior = s * near - s * t, c("p3.idx") - c("p1.idx"), s * c("p1.prior")
    rows = rows.where((F.abs(a - b) <= EQUAL * scale) & (depth >= DEPTH * scale) & (depth >= least_height() * F.abs(t)) & gap.between(8, 120) & (prior >= PRIOR))
    parts = [closeness(a - b, EQUAL * scale), depth / (5 * scale), prior / (2 * TREND), F.when(gap.between(15, 80), 1.0).otherwise(0.6), _fading("p1", "p3")]
    return _candidate(rows, F.when(s > 0, "double_top").otherwise("double_bottom"), -s, t, far, t - (far - t), parts, 3)


def _widths(bars: DataFrame, reach: int = 30) -> DataFrame:
    """``bars`` with ``wide_high`` and ``wide_low``: bars around each, up to ``reach`` to a side, that stay within a scale of its high and low."""
    w = series()

    def side(price: str, sign: int, ahead: bool) -> Column:
        near = F.collect_list(price).over(w.rowsBetween(1, reach) if ahead else w.rowsBetween(-reach, -1))
        near = near if ahead else F.reverse(near)
        far = F.array_position(F.transform(near, lambda v: sign * (F.col(price) - v) <= EQUAL * F.col("scale")), F.lit(False))
        return F.when(far > 0, far - 1).otherwise(F.size(near))

    return bars.withColumns({name: 1 + side(price, sign, False) + side(price, sign, True) for name, price, sign in (("wide_high", "high", 1), ("wide_low", "low", -1))})


def adam_and_eve(swings: DataFrame, bars: DataFrame) -> DataFrame:
    """Double tops and bottoms whose first extreme is at most 5 bars wide and whose second is twice as wide, 6 bars at least."""
    wide = _widths(bars).select(*SERIES, "i", "wide_high", "wide_low")
    found = doubles(pivots(swings, bars))
    for name, place in (("a", "start_idx"), ("b", "last_idx")):
        own = F.when(F.col("sgn") < 0, F.col("wide_high")).otherwise(F.col("wide_low"))
        found = found.join(wide.withColumnRenamed("i", place), [*SERIES, place]).withColumn(f"_{name}", own).drop("wide_high", "wide_low")
    found = found.where((F.col("_a") <= 5) & (F.col("_b") >= F.greatest(2 * F.col("_a"), F.lit(6))))
    return found.withColumn("pattern_id", F.when(F.col("sgn") < 0, "adam_eve_top").otherwise("adam_eve_bottom")).select(*CANDIDATE)


# Bars of a consolidation, the part of the pole that it may give back and that its edges may be apart, its drift
# with the pole in scales a bar and against it in pole slopes, how near to an edge a turn tests it, bars between tests, tests
# of an edge, and how much narrower a pennant gets.
REST, GIVEN, APART, DRIFT, AGAINST, TEST, SPACING, TESTED, NARROWS = (5, 25), 0.4, 0.75, 0.12, 0.4, 0.4, 3, 2, 0.55


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda total, y: total + y)


def _line(y: Column, n: Column) -> tuple[Column, Column]:
    """Slope and height at its first element of the least-squares line through an array of ``n`` values, from its sums."""
    mean, spread = (n - 1) / 2, n * (n * n - 1) / 12
    slope = _sum(F.transform(y, lambda v, k: v * (k - mean))) / spread
    return slope, _sum(y) / n - slope * mean


def _turns_near(y: Column, n: Column, gap: Callable[[Column], Column], room: Callable[[Column], Column]) -> Column:
    """How many peaks of ``y``, spaced out, lie within a share of the ``room`` to the edge that is ``gap`` above them."""
    at = lambda k: F.element_at(y, k + 1)
    peak = lambda k: ((k == 0) | (at(k) >= at(F.greatest(k, F.lit(1)) - 1))) & (at(k) >= at(k + 1)) & (gap(k) <= TEST * room(k))
    start = F.struct(F.lit(0).alias("n"), F.lit(-SPACING).alias("last"))
    spaced = lambda held, k: F.when(k - held["last"] >= SPACING, F.struct((held["n"] + 1).alias("n"), k.alias("last"))).otherwise(held)
    return F.aggregate(F.filter(F.sequence(F.lit(0), n - 2), peak), start, spaced, lambda held: held["n"])


def flags(swings: DataFrame, bars: DataFrame) -> DataFrame:
    """Flags and pennants: a pole of 2 to 20 bars and 5 scales, then 5 to 25 bars that give back at most 0.4 of it between two tested lines.

    Poles come from windows over the last 150 bars. Each is a row with its at most 46 bars, and one for each bar that may end it;
    edges are least squares by sums over these, shifted until no bar is beyond them.
    """
    c, w = F.col, series()
    past, ahead = w.rowsBetween(-20, 0), w.rowsBetween(1, 5)
    sides = [(1.0, c("high"), c("low")), (-1.0, -c("low"), -c("high"))]
    looked = bars.withColumns({f"x{k}": F.struct(F.lit(s).alias("s"), h.alias("h"), F.max(h).over(past).alias("top"), F.max(h).over(ahead).alias("next"), F.min(F.struct(low.alias("v"), c("i").alias("i"))).over(past).alias("base")) for k, (s, h, low) in enumerate(sides)})
    poles = looked.where((c("i") >= 20) & c("i").between(c("last") - 150, c("last") - 5)).select(*SERIES, c("i").alias("t"), "scale", "last", F.explode(F.array("x0", "x1")).alias("x"))
    size, n = c("x.h") - c("x.base.v"), c("t") - c("x.base.i")
    poles = poles.where((c("x.h") >= c("x.top")) & (c("x.next") <= c("x.h")) & (n >= 2) & (size >= 5 * c("scale")) & (size / n >= 0.45 * c("scale")))
    poles = poles.select(*SERIES, c("t").cast("int").alias("t"), c("last").cast("int").alias("last"), c("x.s").alias("s"), c("x.base.i").cast("int").alias("base"))
    near = poles.withColumn("i", F.explode(F.sequence(c("base"), F.least(c("last"), c("t") + 25)))).join(bars.select(*SERIES, "i", "high", "low", "close", "scale", "volume"), [*SERIES, "i"])
    # the far and the near side of the pole's direction, from its base on
    bar = F.struct("i", F.when(c("s") > 0, c("high")).otherwise(-c("low")).alias("far"), F.when(c("s") > 0, c("low")).otherwise(-c("high")).alias("near"), (c("s") * c("close")).alias("close"), "scale", "volume")
    rows = near.groupBy(*SERIES, "base", "t", "s", "last").agg(F.sort_array(F.collect_list(bar)).alias("b")).withColumn("tip", c("t") - c("base"))
    of = lambda field, k: F.element_at(c("b"), k + 1)[field]
    rows = rows.withColumns({"height": of("far", c("tip")) - c("b")[0]["near"], "a": of("scale", c("tip"))})
    # the bars at which the pole goes on and at which too much is given back; the consolidation ends before the first of them
    rows = rows.where(c("t") + REST[0] <= c("last")).withColumn("most", F.least(c("t") + REST[1], c("last")))
    soonest = lambda meets: F.array_min(F.filter(F.sequence(F.lit(0), c("most") - c("t")), meets)) + 1
    rows = rows.withColumns({"on": soonest(lambda k: of("far", c("tip") + k) > of("far", c("tip"))), "low": soonest(lambda k: of("far", c("tip")) - of("near", c("tip") + k) > GIVEN * c("height"))})
    rows = rows.withColumns({x: F.when(c("t") + c(x) <= c("most"), c("t") + F.greatest(c(x), F.lit(REST[0]))) for x in ("on", "low")})
    rows = rows.withColumn("until", F.least(c("most"), c("on") - 1, c("low") - 1)).where(c("until") >= c("t") + REST[0])
    # a row for each bar that may follow it: its edges up to there
    rows = rows.withColumn("j", F.explode(F.sequence(c("t") + REST[0], c("until"))))
    rows = rows.withColumn("n", c("j") - c("t")).withColumn("rest", F.slice("b", c("tip") + 1, c("n")))
    rows = rows.withColumns({"tops": c("rest.far"), "bottoms": F.transform("rest", lambda x: -x["near"])})
    edge = lambda side, k: c(f"{side}_b") + c(f"{side}_m") * k
    width = lambda k: edge("tops", k) + edge("bottoms", k)
    above = lambda side: F.array_max(F.transform(side, lambda y, k: y - edge(side, k)))
    tests = lambda side: _turns_near(c(side), c("n"), lambda k: edge(side, k) - F.element_at(c(side), k + 1), width)
    for side in ("tops", "bottoms"):
        slope, height = _line(c(side), c("n"))
        rows = rows.withColumns({f"{side}_m": slope, f"{side}_b": height})
        rows = rows.withColumn(f"{side}_b", c(f"{side}_b") + above(side))
    rows = rows.withColumns({"tops_tests": tests("tops"), "bottoms_tests": tests("bottoms")})
    rows = rows.withColumns({"drift": (c("tops_m") - c("bottoms_m")) / 2, "w0": width(F.lit(0)), "w1": width(c("n") - 1), "depth": F.array_max("bottoms"), "given": of("far", c("tip")) + F.array_max("bottoms")})
    fits = (c("drift") <= DRIFT * c("a")) & (-c("drift") <= AGAINST * c("height") / c("tip")) & (c("w0") <= APART * c("height")) & (c("tops_tests") >= TESTED) & (c("bottoms_tests") >= TESTED)
    after = c("j") - c("base")
    usual = lambda x: _sum(F.filter(x, lambda v: v.isNotNull() & ~F.isnan(v))) / F.nullif(F.size(F.filter(x, lambda v: v.isNotNull() & ~F.isnan(v))), F.lit(0))
    quiet = usual(c("rest.volume")) < usual(F.slice("b", 1, c("tip") + 1)["volume"])
    rows = rows.where(fits).withColumns({"breaks": of("close", after) > edge("tops", c("n")) + BREAK * of("scale", after), "dry": F.when(quiet, 1.0).when(~quiet, 0.4)})
    # the first break ends it, or else the last bar that fits
    pole = [*SERIES, "base", "t", "s"]
    shape = F.struct("n", "tops_m", "tops_b", "bottoms_m", "w0", "w1", "given", "depth", "dry", "j")
    rows = rows.groupBy(*pole, "last", "tip", "height", "a", "on", "low").agg(F.min(F.when(c("breaks"), c("j"))).alias("brk"), F.max_by(shape, "j").alias("newest"), F.min_by(shape, F.when(c("breaks"), c("j"))).alias("broken"))
    rows = rows.where(c("brk").isNotNull() | c("on").isNull() | (c("low") < c("on"))).withColumn("x", F.coalesce("broken", "newest"))
    rows = rows.where((c("x.w0") > 0) & (c("x.w1") > 0))
    found = rows.select(
        *pole, c("x.tops_m").alias("m"), (c("x.tops_b") - c("x.tops_m") * c("t")).alias("b"), (c("x.given") / (GIVEN * c("height"))).alias("held"), (c("x.j") - 1).alias("end"), "brk", (c("brk").isNull() & (c("low").isNotNull() | (c("last") - c("t") > REST[1]))).alias("dead"),
        ((c("x.w1") / c("x.w0") < NARROWS) & (c("x.tops_m") <= 0) & (c("x.bottoms_m") <= 0)).alias("pennant"), c("x.w0").alias("w0"), "height", (c("height") / c("tip") / c("a")).alias("steep"), "a", c("x.dry").alias("dry"), (-c("x.depth")).alias("low"),
    )

    ends = bars.where("i = last").select(*SERIES, "last")
    found = found.join(ends, SERIES)
    s, kind = c("s"), F.when(c("pennant"), "pennant").otherwise("flag")
    cons = c("end") - c("t") + 1
    parts = [c("height") / (10 * c("a")), c("steep"), 1 - F.least(F.lit(1.0), c("w0") / (0.75 * c("height"))), 1 - c("held"), F.when(cons.between(5, 20), 1.0).otherwise(0.6), c("dry")]
    at = F.coalesce("brk", "last")
    return _candidate(
        found, F.concat(F.when(s > 0, "bull_").otherwise("bear_"), kind), s, s * c("b"), F.lit(None), s * (c("m") * at + c("b")) + s * c("height"), parts, start_idx=c("base"), last_idx=F.coalesce(c("brk") - 1, c("last")), slope=s * c("m"),
        reach=c("height"), shown_inval=s * c("low"), shown_end=c("end"), apex=F.when(c("dead"), -1.0), points=F.array(c("base").cast("int"), c("t").cast("int")),
    )


BOWL = "symbol string, timeframe string, r0 int, s double, cup boolean, level double, inval double, begins int, ends int, depth double, fit double, vertex double, base double, a double, prior double, pull double, points array<int>"


def bowl(h: np.ndarray, low: np.ndarray, c: np.ndarray, a: np.ndarray, least_share: float, least: int, most: int, handle: int) -> list[dict]:
    """The rounded bottom, and before it the cup, that begin at the first bar of the arrays (highs, lows, closes, scales); places count from it."""
    part = low[1 : most + 1]
    dip = 1 + int(part.argmin())
    back = np.flatnonzero(h[dip + 1 : most + 1] >= h[0] - NEAR * a[dip + 1 : most + 1])
    if not len(back) or (e := dip + 1 + int(back[0])) < least:
        return []
    bottom = int(low[: e + 1].argmin())
    depth, scale = h[0] - low[bottom], float(np.median(a[: e + 1]))
    if depth < 4 * scale or not least_share <= depth / abs(h[0]) <= 0.5:
        return []
    x, y = np.arange(e + 1.0), c[: e + 1]
    a2, a1, a0 = np.polyfit(x, y, 2)
    if a2 <= 0:
        return []
    fit = 1 - ((y - (a2 * x * x + a1 * x + a0)) ** 2).sum() / max(((y - y.mean()) ** 2).sum(), 1e-12)
    found = {"depth": depth, "fit": fit, "vertex": -a1 / (2 * a2) / e, "base": float((y <= low[bottom] + depth / 3).mean()), "a": scale}
    if fit < 0.7 or not 0.25 <= found["vertex"] <= 0.75 or found["base"] < 0.42:
        return []
    rounds = [found | {"cup": False, "level": h[0], "inval": low[bottom], "begins": e, "ends": e, "pull": None, "points": [0, bottom, e]}]
    # the right rim: the highest bar from there until a pullback of 1.5 scales, unless a close breaks out first
    span = slice(e, min(len(h), e + handle + 1))
    top = np.maximum.accumulate(h[span])
    higher = np.concatenate([[True], h[span][1:] > top[:-1]])
    out = c[span] > h[0] + BREAK * a[span]
    falls = ~higher & (top - low[span] >= 1.5 * a[span])
    first_out, first_fall = (int(z.argmax()) if z.any() else len(z) for z in (out, falls))
    if first_fall >= first_out:
        return rounds
    rim = e + int(np.flatnonzero(higher[: first_fall + 1])[-1])
    level, tail = max(h[0], h[rim]), slice(rim + 1, min(len(h), rim + handle + 1))
    broke = np.flatnonzero(c[tail] > level + BREAK * a[tail])
    stop = rim + 1 + int(broke[0]) if len(broke) else tail.stop
    if len(h) - 1 - rim < 5 or stop - rim - 1 < 5:
        return rounds
    dent = rim + 1 + int(low[rim + 1 : stop].argmin())
    pull = level - low[dent]
    if 0 < pull <= 0.5 * depth and low[dent] > low[bottom] + depth / 2:
        cup = {"cup": True, "level": level, "inval": low[dent], "begins": rim + 1, "ends": max(e, dent), "pull": pull, "points": [0, bottom, e, dent]}
        return [found | cup, *rounds]
    return rounds


def roundings(swings: DataFrame, bars: DataFrame, least: int = 30, most: int = 200, handle: int = 30) -> DataFrame:
    """Rounded bottoms and tops, and cups with a handle: closes from a rim back to its height that a parabola fits.

    After the lowest bar of the ``most`` that follow a confirmed high, the first within a scale of the rim ends the bowl,
    ``least`` bars at least. The fit explains 0.7, its vertex lies in the middle half, 0.42 of the closes in the lowest
    third. A pullback of up to half the depth, 5 to ``handle`` bars after the right rim, is a handle. Tops are bottoms
    upside down. A rim is one row, with the at most ``most + 2 * handle + 1`` bars that it needs; rims are fitted one by one.
    """
    c = F.col
    kept = AGE_BARS + most + WAIT_BARS + FAIL_BARS + 2
    rims = swings.where("not provisional").select(*SERIES, c("idx").alias("r0"), F.when(c("kind") == "H", 1.0).otherwise(-1.0).alias("s"))
    ends = bars.where("i = last").select(*SERIES, "last")
    rims = rims.join(ends, SERIES).where((c("last") - c("r0") >= least) & (c("r0") >= c("last") - kept))
    near = rims.withColumn("i", F.explode(F.sequence(c("r0"), F.least(c("last"), c("r0") + most + 2 * handle)))).join(bars.select(*SERIES, "i", "high", "low", "close", "scale", "prior"), [*SERIES, "i"])
    grouped = near.groupBy(*SERIES, "r0", "s").agg(F.sort_array(F.collect_list(F.struct("i", "high", "low", "close", "scale"))).alias("b"), F.max(F.when(c("i") == c("r0"), c("s") * c("prior"))).alias("prior"))
    rows = grouped.select(*SERIES, "r0", "s", "prior", least_height().alias("share"), *(c(f"b.{x}").alias(x) for x in ("high", "low", "close", "scale")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                up, high, low = r.s > 0, np.asarray(r.high), np.asarray(r.low)
                for x in bowl(high if up else -low, low if up else -high, r.s * np.asarray(r.close), np.asarray(r.scale), r.share, least, most, handle):
                    out.append({"symbol": r.symbol, "timeframe": r.timeframe, "r0": r.r0, "s": r.s, "prior": r.prior} | x | {k: x[k] + r.r0 for k in ("begins", "ends")} | {"points": [u + r.r0 for u in x["points"]]})
            yield pd.DataFrame(out, columns=[f.split()[0] for f in BOWL.split(", ")])

    rows = rows.mapInPandas(run, BOWL)
    s, cup = c("s"), c("cup")
    name = F.when(cup, F.when(s > 0, "cup_and_handle").otherwise("inverted_cup_and_handle")).otherwise(F.when(s > 0, "rounding_bottom").otherwise("rounding_top"))
    parts = [(c("fit") - 0.7) / 0.3, c("base") / 0.55, 1 - F.abs(c("vertex") - 0.5) / 0.25, c("depth") / (8 * c("a")), F.when(c("prior") < 0, 1.0).otherwise(0.5), F.when(cup, F.when(c("pull") <= c("depth") / 3, 1.0).otherwise(0.6))]
    return _candidate(rows, name, s, s * c("level"), s * c("inval"), s * (c("level") + c("depth")), parts, start_idx=c("r0"), last_idx=c("begins") - 1, shown_end=c("ends"), points=c("points"))


def triples(swings: DataFrame) -> DataFrame:
    """Triple tops and bottoms: three like extremes."""
    c = F.col
    rows = runs(swings, 5)
    s = F.when(c("p1.kind") == "H", 1.0).otherwise(-1.0)
    peaks, scale = [c(f"p{k}.price") for k in (1, 3, 5)], c("p5.scale")
    neck = s * F.least(s * c("p2.price"), s * c("p4.price"))
    spread, far = F.greatest(*peaks) - F.least(*peaks), s * F.greatest(*(s * p for p in peaks))
    depth, span, prior = s * ((peaks[0] + peaks[1] + peaks[2]) / 3 - neck), c("p5.idx") - c("p1.idx"), s * c("p1.prior")
    rows = rows.where((spread <= 1.2 * EQUAL * scale) & (depth >= DEPTH * scale) & (depth >= least_height() * F.abs(neck)) & span.between(16, 240) & (prior >= PRIOR))
    parts = [closeness(spread, 1.2 * EQUAL * scale), depth / (5 * scale), prior / (2 * TREND), closeness(c("p2.price") - c("p4.price"), 2 * scale)]
    return _candidate(rows, F.when(s > 0, "triple_top").otherwise("triple_bottom"), -s, neck, far, neck - (far - neck), parts, 5)


def measured_moves(swings: DataFrame) -> DataFrame:
    """A leg, a retracement of 0.3 to 0.7 of it, and a second leg as long as the first to come."""
    c = F.col
    rows = runs(swings, 3)
    s = F.when(c("p1.kind") == "L", 1.0).otherwise(-1.0)
    a, b, d, scale = c("p1.price"), c("p2.price"), c("p3.price"), c("p2.scale")
    leg = F.abs(b - a)
    back = over(F.abs(b - d), leg)
    rows = rows.where((leg >= 5 * scale) & (leg >= least_height() * a) & back.between(0.3, 0.7))
    return _candidate(rows, F.when(s > 0, "measured_move_up").otherwise("measured_move_down"), s, b, d, d + (b - a), [leg / (10 * scale), 1 - F.abs(back - 0.5) / 0.25], 3)


def head_and_shoulders(swings: DataFrame) -> DataFrame:
    """A head between two like shoulders over a neckline through the swings between them, after a move.

    The level is the neckline; the head ends the pattern, though the right shoulder is shown as what does. The target
    lies as far from the neckline at the break as the head does.
    """
    c = F.col
    rows = runs(swings, 5)
    s = F.when(c("p1.kind") == "H", 1.0).otherwise(-1.0)
    left, head, right, scale = c("p1.price"), c("p3.price"), c("p5.price"), c("p5.scale")
    rows = rows.withColumn("m", (c("p4.price") - c("p2.price")) / F.greatest(c("p4.idx") - c("p2.idx"), F.lit(1)))
    neck = lambda p: c("p2.price") + c("m") * (c(f"{p}.idx") - c("p2.idx"))
    rows = rows.withColumn("h", s * (head - neck("p3")))
    first, second = c("p3.idx") - c("p1.idx"), c("p5.idx") - c("p3.idx")
    drift, prior = F.abs(c("m") * (c("p5.idx") - c("p1.idx"))), s * c("p1.prior")
    out = F.least(s * (head - left), s * (head - right))
    rows = rows.where(
        (out >= scale) & (c("h") > 0) & (c("h") >= least_height() * F.abs(neck("p3"))) & (F.abs(left - right) <= 0.5 * c("h")) & (s * (right - neck("p5")) > 0) & (s * (left - neck("p1")) > 0)
        & (second > 0) & (first / second).between(1 / 2.5, 2.5) & (drift <= 0.6 * c("h")) & (prior >= PRIOR)
    )
    parts = [closeness(left - right, 0.5 * c("h")), closeness(1 - F.least(first, second) / F.greatest(first, second), F.lit(1.0)), out / (3 * scale), closeness(drift, 0.6 * c("h")), prior / (2 * TREND), _fading("p1", "p5")]
    name = F.when(s > 0, "head_and_shoulders").otherwise("inverse_head_and_shoulders")
    return _candidate(rows, name, -s, c("p2.price"), head, F.lit(None).cast("double"), parts, 5, slope=c("m"), at=c("p2.idx"), reach=c("h"), retarget=F.lit(True), shown_inval=right)


def diamonds(swings: DataFrame) -> DataFrame:
    """Six confirmed swings that broaden up to the middle and contract after it; the sides of the right half are the levels."""
    c = F.col
    rows = runs(swings.where("not provisional"), 6)
    up = c("p1.kind") == "H"
    h = [F.when(up, c(f"p{2 * k + 1}")).otherwise(c(f"p{2 * k + 2}")) for k in range(3)]
    low = [F.when(up, c(f"p{2 * k + 2}")).otherwise(c(f"p{2 * k + 1}")) for k in range(3)]
    rows = rows.withColumns({f"h{k + 1}": x for k, x in enumerate(h)} | {f"l{k + 1}": x for k, x in enumerate(low)})
    price, idx, scale = lambda x: c(f"{x}.price"), lambda x: c(f"{x}.idx"), c("p6.scale")
    width = price("h2") - price("l2")
    rows = rows.where(
        (price("h2") > price("h1")) & (price("h2") > price("h3")) & (price("l2") < price("l1")) & (price("l2") < price("l3")) & (width >= 4 * scale) & (width >= least_height() * price("h2"))
        & (F.least(price("h2") - price("h3"), price("l3") - price("l2")) >= 0.5 * scale)
    )
    slope = {x: (price(f"{x}3") - price(f"{x}2")) / F.greatest(idx(f"{x}3") - idx(f"{x}2"), F.lit(1)) for x in "hl"}
    top, prior = c("p1.prior") >= 0, c("p1.prior")
    side = lambda a, b: F.when(top, a).otherwise(b)
    sgn = side(F.lit(-1.0), F.lit(1.0))
    reached = side(price("l2") + slope["l"] * (c("p6.idx") - idx("l2")), price("h2") + slope["h"] * (c("p6.idx") - idx("h2")))
    parts = [width / (10 * scale), F.abs(prior) / (2 * TREND), 1 - F.least(F.lit(1.0), F.abs((idx("h2") - idx("h1")) - (idx("h3") - idx("h2"))) / F.greatest(idx("h3") - idx("h1"), F.lit(1)))]
    return _candidate(
        rows, side(F.lit("diamond_top"), F.lit("diamond_bottom")), sgn, side(price("l2"), price("h2")), side(price("h2"), price("l2")), reached + sgn * width, parts, 6,
        slope=side(slope["l"], slope["h"]), at=side(idx("l2"), idx("h2")), inval_slope=side(slope["h"], slope["l"]), inval_at=side(idx("h2"), idx("l2")), reach=width,
    )


def v_reversals(swings: DataFrame) -> DataFrame:
    """A steep leg of 2 to 20 bars that is taken back to 0.618 within one and a half times its bars.

    Without a break it stays while it may still come and 0.382 has been taken back.
    """
    c = F.col
    rows = runs(swings, 2)
    s = F.when(c("p2.kind") == "L", 1.0).otherwise(-1.0)
    a, b, scale, n = c("p1.price"), c("p2.price"), c("p2.scale"), c("p2.idx") - c("p1.idx")
    drop = F.abs(a - b)
    rows = rows.where(n.between(2, 20) & (drop >= 6 * scale) & (drop / n >= 0.5 * scale) & (drop >= least_height() * a))
    return _candidate(
        rows, F.when(s > 0, "v_bottom").otherwise("inverted_v_top"), s, b + 0.618 * (a - b), b, a, [drop / n / (1.5 * scale), drop / (12 * scale)], 2,
        unsure=F.lit(False), wait=F.greatest(F.lit(3), (1.5 * n).cast("int")), need=b + 0.382 * (a - b), rule=F.lit(1),
    )


def traps(bars: DataFrame, past: int = 40, wait: int = 5, scan: int = 120) -> DataFrame:
    """Closes beyond the extreme of the ``past`` bars before, the first of their kind, that close back within ``wait`` bars."""
    c, w = F.col, series()
    frame, ahead = w.rowsBetween(-past, -1), w.rowsBetween(0, wait)
    rows = bars.withColumns({
        "top": F.max("high").over(frame), "bottom": F.min("low").over(frame), "earlier": before(c("close")), "tol": BREAK * c("scale"),
        "peak": F.max(F.struct("high", -c("i"))).over(ahead), "trough": F.min(F.struct("low", "i")).over(ahead),
    }).where((c("i") >= past) & (c("i") >= c("last") - scan) & ((c("i") < c("last")) | c("complete")))
    up = (c("close") > c("top") + c("tol")) & ~(c("earlier") > c("top") + c("tol"))
    down = (c("close") < c("bottom") - c("tol")) & ~(c("earlier") < c("bottom") - c("tol"))
    side = lambda name, sgn, level, extreme, at, other: F.struct(F.lit(name).alias("name"), F.lit(sgn).alias("sgn"), c(level).alias("level"), c(extreme).alias("extreme"), at.cast("int").alias("at"), c(other).alias("other"))
    kinds = F.array_compact(F.array(F.when(up, side("bull_trap", -1.0, "top", "peak.high", -c("peak.col2"), "bottom")), F.when(down, side("bear_trap", 1.0, "bottom", "trough.low", c("trough.i"), "top"))))
    rows = rows.withColumn("x", F.explode(kinds))
    return _candidate(
        rows, c("x.name"), c("x.sgn"), c("x.level"), c("x.extreme"), c("x.other"), [F.lit(min(1.0, past / 40))],
        start_idx=c("i") - past, last_idx=c("i"), points=F.array(c("i").cast("int"), c("x.at")), wait=F.lit(wait), rule=F.lit(2),
    )


def compressions(bars: DataFrame, least: int = 6, most: int = 3, ratio: float = 0.55) -> DataFrame:
    """The last runs of squeezed Bollinger bands that are narrow against their median; the direction comes from the break."""
    c, w = F.col, series()
    wide = indicators.bollinger_squeeze(indicators.bollinger(bars), share=0.15)
    middle = F.when(F.count("bb_width").over(w.rowsBetween(-119, 0)) >= 60, F.percentile("bb_width", 0.5).over(w.rowsBetween(-119, 0)))
    wide = wide.withColumn("usual", middle).where(c("bb_squeeze") & (c("last") + 1 >= 80))
    island = wide.withColumn("run", c("i") - F.row_number().over(w))
    found = island.groupBy(*SERIES, "run").agg(
        F.min("i").alias("first"), F.max("i").alias("end"), F.max("high").alias("top"), F.min("low").alias("bottom"), F.avg("bb_width").alias("width"), F.min_by("usual", "i").alias("usual"), F.max_by("scale", "i").alias("scale"),
    ).where(c("end") - c("first") + 1 >= least)
    found = found.withColumn("place", F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("end")))).where((c("place") <= most) & (c("usual") > 0) & (c("width") / c("usual") <= ratio))
    rows = found.withColumn("sgn", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    high, s = c("top") - c("bottom"), c("sgn")
    level, other = F.when(s > 0, c("top")).otherwise(c("bottom")), F.when(s > 0, c("bottom")).otherwise(c("top"))
    return _candidate(
        rows, F.lit("compression_breakout"), s, level, F.lit(None), level + s * high, [(c("end") - c("first") + 1) / 15, 1 - F.least(F.lit(1.0), high / (6 * c("scale")))],
        start_idx=c("first"), last_idx=c("end"), points=F.array(c("first").cast("int"), c("end").cast("int")), rule=F.lit(3), shown_inval=other, pair=F.xxhash64("first", "end"),
    )


def contractions(swings: DataFrame, bars: DataFrame) -> DataFrame:
    """Pullbacks of an uptrend each at most 0.8 of the one before, with highs within 8 percent: the newest such run of the last five swings."""
    c = F.col
    w = series()
    known = bars.withColumns({"sma50": mean(c("close"), 50), "prior80": _prior(80), "v": c("volume"), "v_sum": F.sum("volume").over(w.rowsBetween(Window.unboundedPreceding, 0)), "v_n": F.count("volume").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    more = ("close", "sma50", "prior80", "v", "v_sum", "v_n")
    sure = pivots(swings.where("not provisional"), known, *more)
    order = Window.partitionBy(*SERIES).orderBy("k")
    whole = F.struct("idx", "price", *more)
    row = sure.withColumns({"me": whole, "place": F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("k")))})
    pulls = [F.when(F.lag("idx", 2 * j + 1).over(order).isNotNull(), F.struct(F.lag("me", 2 * j + 1).over(order).alias("h"), F.lag("me", 2 * j).over(order).alias("l"))) for j in range(5)]
    row = row.withColumn("pulls", F.array_compact(F.array(*pulls))).where((c("kind") == "L") & (c("place") <= 5) & (F.size("pulls") > 0))
    depth = lambda p: (p["h"]["price"] - p["l"]["price"]) / p["h"]["price"] * 100
    row = row.withColumn("depths", F.transform("pulls", depth))
    stop = F.filter(F.sequence(F.lit(1), F.size("depths")), lambda j: (j == F.size("depths")) | (F.try_element_at("depths", j) > 0.8 * F.try_element_at("depths", j + 1)))
    row = row.withColumn("n", F.array_min(stop)).where("n >= 2").withColumn("run", F.slice("pulls", F.lit(1), c("n")))
    highs = F.transform("run", lambda p: p["h"]["price"])
    row = row.withColumns({"new": F.try_element_at("run", F.lit(1)), "old": F.try_element_at("run", F.lit(-1)), "top": F.array_max(highs), "low_top": F.array_min(highs)})
    row = row.where(((c("top") - c("low_top")) / c("top") * 100 <= 8.0) & (c("old.h.close") >= c("old.h.sma50")) & (c("old.h.prior80") >= TREND))
    row = row.withColumn("best", F.min("place").over(Window.partitionBy(*SERIES))).where("place = best")
    average = lambda p: (c(f"{p}.l.v_sum") - c(f"{p}.h.v_sum") + F.coalesce(c(f"{p}.h.v"), F.lit(0.0))) / F.nullif(c(f"{p}.l.v_n") - c(f"{p}.h.v_n") + F.when(c(f"{p}.h.v").isNotNull(), 1).otherwise(0), F.lit(0))
    dry = F.when(average("new").isNotNull() & average("old").isNotNull(), F.when(average("new") < 0.8 * average("old"), 1.0).otherwise(0.4))
    pivot = c("new.h.price")
    return _candidate(
        row, F.lit("vcp"), F.lit(1.0), pivot, c("new.l.price"), pivot + c("old.h.price") - c("old.l.price"), [c("n") / 4, 1 - F.least(F.lit(1.0), c("depths")[0] / 10), dry],
        start_idx=c("old.h.idx"), last_idx=c("new.l.idx"), points=F.flatten(F.transform("run", lambda p: F.array(p["h"]["idx"].cast("int"), p["l"]["idx"].cast("int")))),
    )


def two_lines(swings: DataFrame, bars: DataFrame, anchors: int = 10) -> DataFrame:
    """Triangles, wedges, channels, rectangles and broadening shapes: lines fitted to the highs and lows of 5 to 9 confirmed swings.

    For each of the last ``anchors`` swings the longest run that ends there and fits: points within 0.9 scales (the median
    of its bars) of their line, at most 8 % of the closes beyond a line by 0.35, 12 to 220 bars, lines that don't cross.
    Shapes whose direction is open are pairs of candidates.
    """
    c, w = F.col, Window.partitionBy(*SERIES)
    sure = swings.where("not provisional").withColumn("back", F.row_number().over(w.orderBy(F.desc("k"))) - 1)
    runs_ = sure.where(c("back") < anchors).select(*SERIES, c("k").alias("anchor"), F.explode(F.sequence(F.lit(5), F.lit(9))).alias("count"))
    key = [*SERIES, "anchor", "count"]
    points = runs_.withColumn("k", F.explode(F.sequence(c("anchor") - c("count") + 1, c("anchor")))).join(sure.select(*SERIES, "k", "idx", "price", "kind"), [*SERIES, "k"])
    of = lambda kind, x: F.when(c("kind") == kind, x)
    x = c("idx").cast("double")
    fits = points.groupBy(*key).agg(
        F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("end"), F.sort_array(F.collect_list(F.struct("idx", "price", "kind"))).alias("seg"), F.count_if(c("kind") == "H").alias("nh"), F.count_if(c("kind") == "L").alias("nl"),
        *(f(of(kind, c("price")), of(kind, x)).alias(f"{name}{side}") for kind, side in (("H", "u"), ("L", "l")) for f, name in ((F.regr_slope, "m"), (F.regr_intercept, "b"))),
    ).where((c("n") == c("count")) & (c("nh") >= 2) & (c("nl") >= 2) & (c("end") - c("first")).between(12, 220))
    gap = F.array_max(F.transform("seg", lambda p: F.abs(p["price"] - F.when(p["kind"] == "H", c("mu") * p["idx"] + c("bu")).otherwise(c("ml") * p["idx"] + c("bl")))))
    upper, lower = (lambda j: c("mu") * j + c("bu")), (lambda j: c("ml") * j + c("bl"))
    fits = fits.withColumns({"gap": gap, "w0": upper(c("first")) - lower(c("first")), "w1": upper(c("end")) - lower(c("end"))}).where((c("w0") > 0) & (c("w1") > 0))
    near = bars.select(*SERIES, "i", "close", "scale", "volume", "prior", "last")
    met = fits.withColumn("i", F.explode(F.sequence("first", "end"))).join(near, [*SERIES, "i"])
    met = met.withColumn("a", F.percentile("scale", 0.5).over(Window.partitionBy(*key)))
    half = c("first") + F.floor((c("end") - c("first") + 1) / 2)
    columns = ["n", "first", "end", "gap", "w0", "w1", "mu", "bu", "ml", "bl"]
    fits = met.groupBy(*key, *columns).agg(
        F.first("seg").alias("seg"), F.max("a").alias("a"), F.avg(((c("close") > upper(c("i")) + 0.35 * c("a")) | (c("close") < lower(c("i")) - 0.35 * c("a"))).cast("double")).alias("outside"), F.max(F.when(c("i") == c("first"), c("prior"))).alias("prior"), F.max("last").alias("last"),
        F.avg(F.when(c("i") < half, c("volume"))).alias("v0"), F.avg(F.when(c("i") >= half, c("volume"))).alias("v1"),
    ).where((c("gap") <= 0.9 * c("a")) & (c("outside") <= 0.08))
    n = c("end") - c("first")
    tilt = lambda m: F.when(F.abs(m * n / c("a")) <= 1.2, "flat").when(m > 0, "up").otherwise("down")
    fits = fits.withColumns({"su": tilt(c("mu")), "sl": tilt(c("ml")), "du": F.abs(c("mu") * n / c("a")), "dl": F.abs(c("ml") * n / c("a")), "ratio": c("w1") / c("w0")})
    both = lambda a, b: (c("su") == a) & (c("sl") == b)
    shape = (
        F.when(c("ratio") < 0.72, F.when(both("flat", "up"), "ascending_triangle").when(both("down", "flat"), "descending_triangle").when(both("down", "up"), "symmetrical_triangle").when(both("up", "up"), "rising_wedge").when(both("down", "down"), "falling_wedge"))
        .when(c("ratio") <= 1.4, F.when(both("up", "up"), "ascending_channel").when(both("down", "down"), "descending_channel").when(both("flat", "flat"), F.when(F.abs("prior") >= TREND, "rectangle").otherwise("horizontal_channel")))
        .when(both("up", "down"), F.when(c("prior") >= TREND, "broadening_top").when(c("prior") <= -TREND, "broadening_bottom").when(F.abs(c("du") - c("dl")) <= 0.5 * F.greatest("du", "dl"), "expanding_triangle").otherwise("broadening_formation"))
        .when(both("up", "flat") | both("flat", "down"), "broadening_formation")
    )
    triangle = c("pattern").isin("ascending_triangle", "descending_triangle", "symmetrical_triangle")
    fits = fits.withColumn("pattern", shape).where("pattern is not null")
    fits = fits.withColumn("apex", F.when(triangle & (c("mu") != c("ml")), (c("bl") - c("bu")) / (c("mu") - c("ml")))).where(c("apex").isNull() | (c("apex") > c("end")))
    fits = fits.withColumn("place", F.row_number().over(Window.partitionBy(*SERIES, "anchor").orderBy(F.desc("count")))).where("place = 1")
    fixed = F.when(c("pattern").isin("ascending_triangle", "falling_wedge"), 1.0).when(c("pattern").isin("descending_triangle", "rising_wedge"), -1.0)
    rows = fits.withColumns({"fixed": fixed, "wedge": c("pattern").isin("rising_wedge", "falling_wedge"), "measure": F.when(triangle, c("w0")).otherwise(c("w1"))})
    rows = rows.withColumn("sgn", F.explode(F.when(c("fixed").isNotNull(), F.array("fixed")).otherwise(F.array(F.lit(1.0), F.lit(-1.0)))))
    s = c("sgn")
    side = lambda a, b: F.when(s > 0, a).otherwise(b)
    target = F.when(c("wedge"), side(upper(c("first")), lower(c("first")))).otherwise(side(upper(c("last")) + c("measure"), lower(c("last")) - c("measure")))
    parts = [
        0.4 + 0.15 * (c("count") - 4), 1 - c("gap") / (0.9 * c("a")), 1 - c("outside") / 0.08, F.when(n.between(20, 150), 1.0).otherwise(0.6), F.when(c("fixed").isNotNull(), F.when(c("fixed") * c("prior") > 0, 1.0).otherwise(0.5)),
        F.when((F.floor((n + 1) / 2) > 2) & (c("v0").isNotNull() | c("v1").isNotNull()), F.when(c("v1") < c("v0"), 1.0).otherwise(0.5)),
    ]
    held = c("fixed").isNotNull()
    return _candidate(
        rows, c("pattern"), s, side(c("bu"), c("bl")), F.when(held, side(c("bl"), c("bu"))), target, parts, start_idx=c("first"), last_idx=c("end"), slope=side(c("mu"), c("ml")), inval_slope=F.when(held, side(c("ml"), c("mu"))).otherwise(0.0), reach=F.when(~c("wedge"), c("measure")),
        shown_inval=side(c("bl"), c("bu")), stop_slope=side(c("ml"), c("mu")), apex=c("apex"), rule=F.when(held, 0).otherwise(4), pair=F.when(~held, F.xxhash64("anchor", "count")), points=F.transform("seg", lambda p: p["idx"].cast("int")),
    )


def lifecycle(candidates: DataFrame, bars: DataFrame) -> DataFrame:
    """The stage of each candidate of ``bars``, which have ``context``.

    Before the break: a close beyond ``inval`` invalidates, one beyond the level confirms, and ``wait`` bars without
    either expire it; else it is forming, or approaching if the last close is near or a bar that has not ended broke it
    (``provisional``). After it: a close back through the level within FAIL_BARS fails it unless the target was reached,
    on that bar or before; a bar near the level among the last three makes it retesting. Candidates on an unsure pivot
    that confirm, and those whose end is older than AGE_BARS, are left out.
    """
    c = F.col
    ends = bars.where("i = last").select(*SERIES, "last", c("close").alias("last_close"), c("scale").alias("last_scale"))
    key = [*SERIES, "cand"]
    found = _filled(candidates).join(ends, SERIES).where(c("last_idx") >= c("last") - AGE_BARS - c("wait") - FAIL_BARS - 2)
    found = found.withColumn("cand", F.xxhash64("pattern_id", "start_idx", "last_idx", "level", "slope", "sgn", "target", "pair"))
    line = lambda j, of="": c("inval" if of else "level") + c(f"{of}slope") * (j - c(f"{of}at"))
    blocks = F.sequence(((c("last_idx") + 1) / BUCKET).cast("int"), (F.greatest(c("last"), c("last_idx") + 1) / BUCKET).cast("int"))
    reach = found.select(*key, "sgn", "level", "slope", "at", "inval", "inval_slope", "inval_at", "target", "reach", "retarget", "wait", "last_idx", "last", F.explode(blocks).alias("bucket"))
    after = bars.select(*SERIES, c("i").alias("j"), "high", "low", "close", "scale", "rel_volume", "complete", (c("i") / BUCKET).cast("int").alias("bucket"))
    both = reach.join(after, [*SERIES, "bucket"]).where("j > last_idx")
    s, tolerance = c("sgn"), BREAK * c("scale")
    waiting = c("j") <= c("last_idx") + c("wait") + 2
    both = both.withColumn("line", line(c("j")))
    both = both.withColumns({"_inv": F.when(waiting & (s * (line(c("j"), "inval_") - c("close")) > tolerance), c("j")), "_brk": F.when(waiting & (s * (c("close") - c("line")) > tolerance), F.struct("j", "line", "complete", "rel_volume"))})
    own = Window.partitionBy(*key)
    both = both.withColumns({"inv": F.min("_inv").over(own), "brk": F.min("_brk").over(own)})
    goal = F.when(c("retarget"), c("brk.line") + s * c("reach")).otherwise(c("target"))
    later = c("j") > c("brk.j")
    favoured, adverse = F.when(s > 0, c("high")).otherwise(c("low")), F.when(s > 0, c("low") - c("line")).otherwise(c("line") - c("high"))
    seen = both.groupBy(*key).agg(
        F.min("inv").alias("inv"), F.min("brk").alias("b"), F.max(s * favoured).alias("best"),
        F.min(F.when(later & (s * favoured >= s * goal), c("j"))).alias("tgt"),
        F.min(F.when(later & c("complete") & (c("j") <= c("brk.j") + FAIL_BARS) & (s * (c("brk.line") - c("close")) > tolerance), c("j"))).alias("fail"),
        F.max(F.when(later & (adverse <= RETEST * c("scale")), c("j"))).alias("retest"),
    )
    expiry = c("last_idx") + c("wait") + 2
    rows = found.join(seen, key, "left").withColumn("expiry", F.when(expiry <= c("last"), expiry))
    never = F.lit(1 << 40)
    inv, brk, exp, tgt, fail = (F.coalesce(x, never) for x in (c("inv"), c("b.j"), c("expiry"), c("tgt"), c("fail")))
    ended = (inv <= brk) & (inv <= exp) & (inv < never) | (exp < brk) & (exp < never)
    broken = ~ended & (brk < never)
    whole = F.coalesce(c("b.complete"), F.lit(True))
    confirmed = broken & whole
    failed = confirmed & (fail < tgt)
    hit = confirmed & ~failed & (tgt < never)
    near = s * (line(c("last")) - c("last_close")) <= NEAR * c("last_scale")
    stage = (
        F.when(ended, "invalidated").when(failed, "failed").when(confirmed & ~hit & (c("last") - c("retest") <= 2), "retesting").when(confirmed, "confirmed")
        .when((c("rule") == 3) & (c("last_idx") == c("last")), "forming").when(broken | near, "approaching_confirmation").otherwise("forming")
    )
    rows = rows.withColumns({
        "stage": stage, "confirmation_idx": F.when(confirmed, c("b.j")), "target_reached": hit, "provisional": broken & ~whole, "rel_volume": F.when(confirmed, c("b.rel_volume")),
        "_end": F.when(ended, F.least(inv, exp)).when(failed, c("fail")).when(confirmed, c("b.j")).otherwise(c("last_idx")),
    })
    drawn = F.coalesce("shown_end", "last_idx")
    rows = rows.withColumn("end_idx", F.least(F.greatest(drawn, F.when(ended | confirmed, c("_end")).otherwise(drawn)), c("last")))
    open_ = c("confirmation_idx").isNull()
    rows = rows.withColumn("stage", F.when(open_ & (c("last") > c("apex")), "invalidated").otherwise(c("stage")))
    lapsed = (c("rule") == 1) & open_ & ((c("stage") == "invalidated") | F.coalesce(c("best") < s * c("need"), F.lit(True))) | (c("rule") == 2) & open_ & ~c("provisional")
    rows = rows.where(~(c("unsure") & ~open_) & ~lapsed & (c("end_idx") >= c("last") - AGE_BARS))
    # of a pair the earlier break counts, of equal ones that upwards; without one the side that is not invalidated, of lines that in approach
    first = F.row_number().over(Window.partitionBy(*SERIES, "pattern_id", "pair", F.when(c("pair").isNull(), c("cand"))).orderBy(F.asc_nulls_last("confirmation_idx"), (c("rule") == 4) & ~c("provisional"), c("stage") == "invalidated", (c("rule") == 4) & (c("stage") != "approaching_confirmation"), F.desc("sgn")))
    rows = rows.withColumn("side", first).where("side = 1")
    told = c("pair").isNull() | ~open_ | ((c("rule") == 4) & c("provisional"))
    at = F.coalesce("confirmation_idx", "last")
    confirms = F.when(c("rel_volume").isNotNull(), c("rel_volume") >= 1.5)
    volume = F.when(confirms, 1.0).when(confirms.isNotNull(), 0.3)
    bonus = F.when(c("stage").isin("confirmed", "retesting"), 1.0).when(c("stage") == "approaching_confirmation", 0.6).when(c("stage") == "forming", 0.4).otherwise(0.0)
    swift = F.when(c("rule") == 2, F.when(F.coalesce(c("confirmation_idx"), c("last_idx") + c("wait")) - c("last_idx") <= 3, 1.0).otherwise(0.6))
    along = (c("confirmation_idx") - c("start_idx")) / (c("apex") - c("start_idx"))
    timing = F.when(along.isNotNull(), F.when(along.between(0.5, 0.85), 1.0).otherwise(0.6))
    extra = lambda x: F.when(x.isNotNull(), 1).otherwise(0)
    quality = 100 * (c("parts") + F.coalesce(volume, F.lit(0.0)) + F.coalesce(swift, F.lit(0.0)) + F.coalesce(timing, F.lit(0.0)) + bonus) / (c("n_parts") + 1 + extra(volume) + extra(swift) + extra(timing))
    return rows.select(
        *SERIES, "pattern_id", F.when(~told, "neutral").when(c("sgn") > 0, "bullish").otherwise("bearish").alias("direction"), "stage", "start_idx", "end_idx", "confirmation_idx", "target_reached",
        F.when(told, line(at)).alias("level"), F.when(told, F.coalesce(c("shown_inval") + c("stop_slope") * at, line(at, "inval_"))).alias("inval"), F.when(told, F.coalesce(line(at) + c("sgn") * c("reach"), c("target"))).alias("target"),
        F.round(quality, 1).alias("quality"), confirms.alias("volume_confirmation"), "rel_volume", "provisional", "points", "last_idx", "last",
    )


def distinct(found: DataFrame) -> DataFrame:
    """``found`` without patterns that overlap a better one of their kind by over 0.6 of the shorter, or share two key points with it.

    Better is of higher quality, then of later end, then of earlier start. A kind's patterns of a series are at most a
    few hundred, as their age is bounded, so that one row holds them.
    """
    whole = F.struct((-F.col("quality")).alias("_q"), (-F.col("end_idx")).alias("_e"), F.col("start_idx").alias("_s"), F.col("last_idx").alias("_l"), F.struct(*found.columns).alias("row"))
    grouped = found.groupBy(*SERIES, "pattern_id").agg(F.sort_array(F.collect_list(whole)).alias("all"))

    def clash(x: Column, y: Column) -> Column:
        shared = F.least(x["row"]["end_idx"], y["row"]["end_idx"]) - F.greatest(x["row"]["start_idx"], y["row"]["start_idx"])
        span = F.least(x["row"]["end_idx"] - x["row"]["start_idx"], y["row"]["end_idx"] - y["row"]["start_idx"])
        return (shared / F.when(span == 0, 1).otherwise(span) > OVERLAP) | (F.coalesce(F.size(F.array_intersect(x["row"]["points"], y["row"]["points"])) >= 2, F.lit(False)))

    kept = F.aggregate("all", F.filter("all", lambda x: F.lit(False)), lambda acc, x: F.when(F.exists(acc, lambda y: clash(x, y)), acc).otherwise(F.array_append(acc, x)))
    return grouped.select(F.explode(kept).alias("x")).select("x.row.*")


#: Pattern ids that each detector finds.
IDS = {
    "double": ("double_top", "double_bottom"), "triple": ("triple_top", "triple_bottom"), "measured_move": ("measured_move_up", "measured_move_down"),
    "adam_eve": ("adam_eve_top", "adam_eve_bottom"), "rounding": ("rounding_bottom", "rounding_top", "cup_and_handle", "inverted_cup_and_handle"),
    "head_and_shoulders": ("head_and_shoulders", "inverse_head_and_shoulders"), "diamond": ("diamond_top", "diamond_bottom"), "v_reversal": ("v_bottom", "inverted_v_top"),
    "flag": ("bull_flag", "bear_flag", "bull_pennant", "bear_pennant"),
    "two_line": (
        "ascending_triangle", "descending_triangle", "symmetrical_triangle", "rising_wedge", "falling_wedge", "ascending_channel", "descending_channel", "rectangle", "horizontal_channel", "broadening_top", "broadening_bottom", "expanding_triangle", "broadening_formation",
    ),
    "trap": ("bull_trap", "bear_trap"), "compression": ("compression_breakout",), "vcp": ("vcp",),
}
DETECTORS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "double": lambda z, bars: doubles(pivots(z, bars)), "triple": lambda z, bars: triples(pivots(z, bars)), "measured_move": lambda z, bars: measured_moves(pivots(z, bars)),
    "head_and_shoulders": lambda z, bars: head_and_shoulders(pivots(z, bars)), "diamond": lambda z, bars: diamonds(pivots(z, bars)), "v_reversal": lambda z, bars: v_reversals(pivots(z, bars)),
    "adam_eve": adam_and_eve, "rounding": roundings, "flag": flags, "two_line": two_lines, "trap": lambda z, bars: traps(bars), "compression": lambda z, bars: compressions(bars), "vcp": contractions,
}
EXPERIMENTAL = frozenset({"vcp"})
CONTINUATION = frozenset({"measured_move_up", "measured_move_down", "vcp", "bull_flag", "bear_flag", "bull_pennant", "bear_pennant", "ascending_triangle", "descending_triangle", "ascending_channel", "descending_channel", "rectangle"})
BILATERAL = frozenset({"compression_breakout", "symmetrical_triangle", "expanding_triangle", "broadening_formation", "horizontal_channel"})


def category(pattern: Column) -> Column:
    return F.when(pattern.isin(*CONTINUATION), "continuation").when(pattern.isin(*BILATERAL), "bilateral").otherwise("reversal")


def proposed(bars: DataFrame, swings: DataFrame, include: tuple[str, ...] | None = None, experimental: bool = True) -> dict[str, DataFrame]:
    """The candidates of each detector that finds an id of ``include``, by its name. Series of fewer than LEAST_BARS bars have none."""
    wanted = [d for d, ids in IDS.items() if (include is None or set(ids) & set(include)) and (experimental or not set(ids) & EXPERIMENTAL)]
    if not wanted:
        raise ValueError(f"no detector finds any of {include}")
    enough = bars.where(F.col("last") + 1 >= LEAST_BARS)
    found = {d: DETECTORS[d](swings, enough) for d in wanted}
    return found if include is None else {d: x.where(F.col("pattern_id").isin(*include)) for d, x in found.items()}


def settled(candidates: dict[str, DataFrame], bars: DataFrame) -> DataFrame:
    """The patterns that ``candidates`` of ``bars`` become, thinned out (see ``distinct``), with ``category`` and ``experimental``. All share one join with the bars."""
    rows = distinct(lifecycle(reduce(DataFrame.unionByName, candidates.values()), bars.where(F.col("last") + 1 >= LEAST_BARS)))
    return rows.withColumns({"category": category(F.col("pattern_id")), "experimental": F.col("pattern_id").isin(*EXPERIMENTAL)})


def detect(bars: DataFrame, swings: DataFrame, include: tuple[str, ...] | None = None, experimental: bool = True) -> DataFrame:
    """All patterns of ``bars`` with ``context``: what detectors have ``proposed``, ``settled``."""
    return settled(proposed(bars, swings, include, experimental), bars)


def current(found: DataFrame) -> DataFrame:
    """``found`` with ``current``: confirmed within CURRENT_BARS, active with an end within them, or resolved within RESOLVED_BARS."""
    c = F.col
    active = c("stage").isin(*ACTIVE) & (c("end_idx") >= c("last") - CURRENT_BARS)
    resolved = c("stage").isin("failed", "invalidated") & (c("end_idx") >= c("last") - RESOLVED_BARS)
    return found.withColumn("current", F.coalesce(c("last") - c("confirmation_idx") <= CURRENT_BARS, F.lit(False)) | active | resolved)
