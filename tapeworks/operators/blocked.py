"""Averages and swings of series that are too long for one task: each is cut into blocks, and what a block needs of those before it is small.

An exponential average is an affine map of its last value, so that of a block is two numbers: how much of the value
before it remains, and what it adds. These are composed over the blocks of a series, then each block applies what came
in; all of it is column expressions. Swings have no such short form. Their walk is run on all blocks at once, from what the
blocks before were last seen to hand on; blocks whose guess was wrong are run again until none is. Walks from different
states soon meet, so that few rounds are needed.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.operators.recursive import START, walk
from tapeworks.session import stored
from tapeworks.sources.bars import SERIES, seconds

#: Bars in a block; fewer where the weights of one would leave the range of a double.
BLOCK, RANGE = 4096, 200
AT = [*SERIES, "block"]
#: Weight of a new value for an average of so many bars, and for Wilder's.
EMA, WILDER = (lambda n: 2 / (n + 1)), (lambda n: 1 / n)


def indexed(bars: DataFrame, span: int = 30 * 86400) -> DataFrame:
    """``bars`` with ``i``, the place of each in its series by ``ts``, counted inside spans of so many seconds, so that a series is many tasks."""
    cut = bars.withColumn("_span", F.floor(seconds(F.col("ts")) / span))
    counts = cut.groupBy(*SERIES, "_span").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*SERIES).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(*SERIES, "_span").orderBy("ts")) - 1
    return cut.join(counts.select(*SERIES, "_span", before.alias("_before")), [*SERIES, "_span"]).withColumn("i", (place + F.col("_before")).cast("int")).drop("_span", "_before")


def length(alpha: float, most: int = BLOCK) -> int:
    """Bars of a block in which the weights (1 - alpha) ** -k stay in range."""
    return min(most, max(1, int(RANGE * math.log(10) / -math.log(1 - alpha)))) if alpha < 1 else most


def _blocks(bars: DataFrame, size: int) -> DataFrame:
    return bars.withColumn("block", F.floor(F.col("i") / size).cast("int"))


def _in_block(order: Column | str = "i"):
    return Window.partitionBy(*AT).orderBy(order)


def _before_block(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df``, in blocks, with the last ``value`` of the block before: a row for each block goes to a window over blocks."""
    last = df.groupBy(*AT).agg(F.max_by(value, "i").alias("_last"))
    last = last.select(*AT, F.lag("_last").over(Window.partitionBy(*SERIES).orderBy("block")).alias(name))
    return df.join(last, AT)


def averages(bars: DataFrame, wanted: dict[str, tuple[Column, int, float]], block: int = BLOCK, warm: bool = False) -> DataFrame:
    """``bars(symbol, timeframe, i, ...)`` with an exponential average for each ``name: (value, period, alpha)``, as ``recursive.smooth`` has it.

    It starts with the mean of the first ``period`` known values; a gap keeps the last value. A gap among those first
    makes it start at the first known value instead. Null before its start, or, with ``warm``, the mean of the values so
    far. ``i`` has to count each series from 0 without holes. Bars are written once with their values and once with the
    sums inside blocks; all else is a row for each block.
    """
    c, size = F.col, min(length(alpha, block) for *_, alpha in wanted.values())
    own, order = Window.partitionBy(*SERIES), Window.partitionBy(*SERIES).orderBy("block")
    x = {name: F.nanvl(value.cast("double"), F.lit(None)) for name, (value, *_) in wanted.items()}
    b = stored(_blocks(bars, size).withColumns({f"_x_{n}": v for n, v in x.items()}), "blocked")
    first = b.groupBy(*AT).agg(F.max("i").alias("end"), *(F.min(F.when(c(f"_x_{n}").isNotNull(), c("i"))).alias(n) for n in wanted))
    first = stored(first.select(*AT, F.max("end").over(own).alias("_end"), *(F.min(n).over(own).alias(f"_first_{n}") for n in wanted)), "blocked-first")
    near = {n: c(f"_x_{n}").isNotNull() & (c("i") >= c(f"_first_{n}")) & (c("i") < c(f"_first_{n}") + period) for n, (_, period, _) in wanted.items()}
    heads = b.join(first, AT).groupBy(*AT).agg(*(f for n, is_near in near.items() for f in (F.count_if(is_near).alias(f"n_{n}"), F.sum(F.when(is_near, c(f"_x_{n}"))).alias(f"s_{n}"), F.min_by(f"_x_{n}", F.when(is_near, c("i"))).alias(f"v_{n}"))))
    seeds = []
    for n, (_, period, _) in wanted.items():
        late = F.sum(f"n_{n}").over(own) < period
        begins = F.when(late, c(f"_first_{n}")).otherwise(c(f"_first_{n}") + period - 1)
        seeds += [F.when(c("_end") >= c(f"_first_{n}") + period - 1, begins).alias(f"_start_{n}")]
        seeds += [F.when(late, F.min_by(f"v_{n}", F.when(c(f"n_{n}") > 0, c("block"))).over(own)).otherwise(F.sum(f"s_{n}").over(own) / period).alias(f"_seed_{n}")]
    b = b.join(stored(first.join(heads, AT).select(*AT, *seeds), "blocked-seeds"), AT)
    # from the seed on known values count; k is their number in the block so far
    used = {n: F.when(c("i") > c(f"_start_{n}"), c(f"_x_{n}")) for n in wanted}
    b = b.withColumns({f"_k_{n}": F.count(u).over(_in_block()) for n, u in used.items()})
    added = {n: F.sum(used[n] * alpha * F.pow(F.lit(1 - alpha), -c(f"_k_{n}"))).over(_in_block()) * F.pow(F.lit(1 - alpha), c(f"_k_{n}")) for n, (*_, alpha) in wanted.items()}
    b = stored(b.withColumns({f"_added_{n}": F.coalesce(a, F.lit(0.0)) for n, a in added.items()}), "blocked-sums")
    ends = b.groupBy(*AT).agg(F.min("i").alias("low"), *(f for n in wanted for f in (F.max(f"_k_{n}").alias(f"k_{n}"), F.max_by(f"_added_{n}", "i").alias(f"added_{n}"), F.first(f"_start_{n}").alias(f"start_{n}"), F.first(f"_seed_{n}").alias(f"seed_{n}"))))
    ends = stored(ends, "blocked-ends")
    came = ends.select(*AT)
    for n, (*_, alpha) in wanted.items():
        maps = F.array_sort(F.collect_list(F.struct("block", c("low").alias("low"), c(f"k_{n}").alias("k"), c(f"added_{n}").alias("added"), c(f"start_{n}").alias("start"), c(f"seed_{n}").alias("seed"))))

        def grown(v: Column, m: Column, q: float = 1 - alpha) -> Column:
            started = F.when(m["low"] > m["start"], F.coalesce(v, m["seed"])).when(m["start"] < m["low"] + size, m["seed"])
            return F.pow(F.lit(q), m["k"]) * started + m["added"]

        start = F.struct(F.lit(None).cast("double").alias("v"), F.expr("cast(array() as array<struct<block:int,v:double>>)").alias("all"))
        folded = ends.groupBy(*SERIES).agg(F.aggregate(maps, start, lambda s, m: F.struct(grown(s["v"], m).alias("v"), F.concat(s["all"], F.array(F.struct(m["block"].alias("block"), s["v"].alias("v")))).alias("all")), lambda s: s["all"]).alias("all"))
        came = came.join(folded.select(*SERIES, F.explode("all").alias("x")).select(*SERIES, "x.block", c("x.v").alias(f"_in_{n}")), AT)
    b = b.join(stored(came, "blocked-in"), AT)
    early = Window.partitionBy(*SERIES, "block", c("i") < max(p for _, p, _ in wanted.values())).orderBy("i")
    for n, (*_, alpha) in wanted.items():
        known = F.when(c("i") >= c(f"_start_{n}"), F.pow(F.lit(1 - alpha), c(f"_k_{n}")) * F.coalesce(f"_in_{n}", f"_seed_{n}") + c(f"_added_{n}"))
        b = b.withColumn(n, F.coalesce(known, F.avg(f"_x_{n}").over(early)) if warm else known)
    return b.select(*(x for x in bars.columns if x not in wanted), *wanted)


def true_range(bars: DataFrame, first: bool = True, block: int = BLOCK) -> DataFrame:
    """``bars`` with ``tr``; the first bar's is its height, or null unless ``first``."""
    c = F.col
    b = _before_block(_blocks(bars, block), "close", "_came")
    prev = F.coalesce(F.lag("close").over(_in_block()), c("_came"))
    height = c("high") - c("low")
    tr = F.when(prev.isNull(), height if first else F.lit(None)).otherwise(F.greatest(height, F.abs(c("high") - prev), F.abs(c("low") - prev)))
    return b.withColumn("tr", tr).drop("block", "_came")


def scale(bars: DataFrame, period: int = 14, block: int = BLOCK) -> DataFrame:
    """``bars`` with ``scale``, as ``recursive.scale`` has it: the average true range, a running mean until it starts, never 0.

    A block holds ``period`` bars at least, so that the running mean is the first block's.
    """
    found = averages(true_range(bars, True, block), {"scale": (F.col("tr"), period, WILDER(period))}, max(block, period), warm=True)
    return found.withColumn("scale", F.greatest("scale", F.lit(1e-9))).drop("tr")


WALKED = "symbol string, timeframe string, block int, seeking string, top_at long, top double, bottom_at long, bottom double, turns array<struct<idx:int,price:double,kind:string,confirmed_idx:int>>"
STATE = ["seeking", "top_at", "top", "bottom_at", "bottom"]


def _walked(part: pa.Table, width: float) -> pa.Table:
    """The walk over a block from the state that came in, which each of its rows holds."""
    part = part.sort_by("i")
    came = tuple(part[f"_{x}"][0].as_py() for x in STATE)
    least = [width * x for x in part["scale"].to_pylist()]
    turns, state = walk(came if came[0] is not None else START, part["high"].to_pylist(), part["low"].to_pylist(), least, part["i"][0].as_py())
    row = {c: part[c][0].as_py() for c in AT} | dict(zip(STATE, state, strict=True)) | {"turns": [dict(zip(("idx", "price", "kind", "confirmed_idx"), t[:4], strict=True)) for t in turns]}
    turn = pa.list_(pa.struct([("idx", pa.int32()), ("price", pa.float64()), ("kind", pa.string()), ("confirmed_idx", pa.int32())]))
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), turn]
    return pa.Table.from_pylist([row], schema=pa.schema(list(zip([*AT, *STATE, "turns"], kinds, strict=True))))


def zigzag(bars: DataFrame, width: float = 2.0, block: int = BLOCK) -> DataFrame:
    """The swings of ``bars`` with ``scale``, as ``recursive.zigzag`` has them: (symbol, timeframe, k, idx, price, kind, confirmed_idx, provisional).

    Each round walks the blocks whose incoming state is not the one that they were last walked with. Equal states give
    equal walks, so that in the end all blocks are as one walk would have left them; there are as many rounds as the
    blocks that a wrong guess lasts for: two or three as a rule, one for each block before a series' first turn.
    """
    c = F.col
    slim = stored(_blocks(bars, block).select(*AT, c("i").cast("int").alias("i"), c("high").cast("double").alias("high"), c("low").cast("double").alias("low"), c("scale").cast("double").alias("scale")), "walk-bars")
    none = {f"_{x}": F.lit(None).cast("string" if x == "seeking" else "long" if x.endswith("_at") else "double") for x in STATE}
    came = slim.select(*AT).distinct().withColumns(none)
    done = None
    order = Window.partitionBy(*SERIES).orderBy("block")
    while True:
        made = slim.join(came, AT).groupBy(*AT).applyInArrow(lambda t: _walked(t, width), WALKED).join(came, AT)
        if done is not None:
            made = made.unionByName(done.join(came.select(*AT), AT, "left_anti"))
        done = stored(made, "walk")
        given = done.select(*AT, *(c(f"_{x}").alias(f"was_{x}") for x in STATE), *(F.lag(x).over(order).alias(f"_{x}") for x in STATE))
        same = F.lit(True)
        for x in STATE:
            same = same & c(f"_{x}").eqNullSafe(c(f"was_{x}"))  # NaN is equal to itself here
        came = stored(given.where(~same).select(*AT, *(f"_{x}" for x in STATE)), "walk-in")
        if came.isEmpty():
            break
    turns = done.select(*AT, F.posexplode("turns").alias("p", "t"))
    last = slim.groupBy(*SERIES).agg(F.max("i").alias("last"))
    ends = done.groupBy(*SERIES).agg(F.max_by(F.struct(*STATE), "block").alias("s")).join(last, SERIES).where("s.seeking != ''")
    top = c("s.seeking") == "H"
    tail = ends.select(*SERIES, F.lit((1 << 31) - 1).alias("block"), F.lit(0).alias("p"), F.when(top, c("s.top_at")).otherwise(c("s.bottom_at")).cast("int").alias("idx"), F.when(top, c("s.top")).otherwise(c("s.bottom")).alias("price"), c("s.seeking").alias("kind"), c("last").alias("confirmed_idx"), F.lit(True).alias("provisional"))
    rows = turns.select(*AT, "p", "t.*", F.lit(False).alias("provisional")).unionByName(tail)
    # a block's turns are counted by where the blocks before it end
    counts = rows.groupBy(*AT).agg(F.count("*").alias("_n"))
    before = counts.select(*AT, F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(before, AT).select(*SERIES, (c("p") + c("_before")).cast("int").alias("k"), "idx", "price", "kind", "confirmed_idx", "provisional")
