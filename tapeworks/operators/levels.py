"""Price levels: support and resistance zones of swings, volume at price, averages and round numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.rolling import mean
from tapeworks.sources.bars import SERIES

#: Price blocks that a series' range is cut into at most.
BLOCKS = 1024
# Distances of round numbers.
STEPS = (0.5, 1, 5, 10, 50, 100, 500, 1000, 5000)
# Scales that join swings into a zone and that it is wider than they are, bars of a reaction, half-life of a
# touch in bars, touches a zone needs, zones of a series, bars under which an episode is a touch, weights of its strength.
CLUSTER, PAD, REACTION, HALF_LIFE, TOUCHES, MOST, EPISODE, LEAST_BARS = 0.8, 0.15, 5, 120, 2, 12, 15, 20
WEIGHTS = {"touches": 3, "recency": 2, "rejection": 2, "role_reversal": 1, "retests": 1, "volume": 1}
ZONE_NEAR = 0.6


def volume_at_price(bars: DataFrame, bins: int = 30, most: int = 2) -> DataFrame:
    """(symbol, timeframe, price, volume): the middles of the ``most`` of ``bins`` equal price ranges with the largest volume.

    A bar counts with its typical price; the highest price belongs to the last range. Of equal volumes the lower price
    comes first. Series without volume or with one price only have none.
    """
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    w = Window.partitionBy(*SERIES)
    b = bars.withColumn("t", typical).withColumns({"lo": F.min("t").over(w), "hi": F.max("t").over(w)}).where("hi > lo")
    width = (F.col("hi") - F.col("lo")) / bins
    placed = b.withColumns({"width": width, "bin": F.least(F.floor((F.col("t") - F.col("lo")) / width), F.lit(bins - 1))})
    summed = placed.groupBy(*SERIES, "bin").agg(F.sum("volume").alias("volume"), (F.first("lo") + (F.first("bin") + 0.5) * F.first("width")).alias("price")).where("volume > 0")
    ranked = summed.withColumn("place", F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("volume"), "bin")))
    return ranked.where(F.col("place") <= most).select(*SERIES, "price", "volume")


def auxiliary(bars: DataFrame, periods: tuple[int, ...] = (50, 100, 200)) -> DataFrame:
    """(symbol, timeframe, kind, price): averages and round numbers about the last close.

    Round numbers are multiples of the smallest of STEPS that the price holds fewer than 40 of, from one below to two
    above, as far as they are above 0.
    """
    b = bars.withColumns({f"_sma{p}": mean(F.col("close"), p) for p in periods})
    b = b.withColumn("place", F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("i")))).where("place = 1")
    step = F.coalesce(*(F.when(F.col("close") / x < 40, F.lit(float(x))) for x in STEPS), F.lit(10000.0))
    base = F.floor(F.col("close") / F.col("step"))
    round_numbers = F.transform(F.sequence(F.lit(-1), F.lit(2)), lambda k: F.struct(F.lit("round").alias("kind"), ((base + k) * F.col("step")).alias("price")))
    averages = F.array(*(F.struct(F.lit(f"sma_{p}").alias("kind"), F.col(f"_sma{p}").alias("price")) for p in periods))
    rows = b.where("close > 0").withColumn("step", step).select(*SERIES, F.explode(F.concat(averages, round_numbers)).alias("x"))
    return rows.select(*SERIES, "x.kind", "x.price").where("price is not null and (kind <> 'round' or price > 0)")


def _by_price(df: DataFrame, low: str, high: str, step: str = "_step") -> DataFrame:
    """``df`` with a row for each price block, ``step`` wide, that the range from ``low`` to ``high`` reaches into; ``_from`` is its first."""
    rows = df.withColumn("_from", F.floor(F.col(low) / F.col(step)))
    return rows.withColumn("_block", F.explode(F.sequence("_from", F.floor(F.col(high) / F.col(step)))))


def _visits(made: DataFrame, b: DataFrame) -> DataFrame:
    """(symbol, timeframe, zone, episodes, stay_idx, crossings): the stays of bars in zones, and how often closes change sides of their middles.

    Bars meet only the zones of the price blocks that they reach into. A block is two scales wide, or what cuts the
    series' range into BLOCKS.
    """
    c = F.col
    steps = b.groupBy(*SERIES).agg(F.greatest(2 * F.max_by("scale", "i"), (F.max("high") - F.min("low")) / BLOCKS).alias("_step"))
    prev = F.lag("close").over(Window.partitionBy(*SERIES).orderBy("i"))
    bars = b.select(*SERIES, "i", "low", "high", "close", prev.alias("prev")).join(steps, SERIES)
    ranges = made.select(*SERIES, "zone", c("low").alias("z_low"), c("high").alias("z_high"), "mid").join(steps, SERIES)
    at, each = [*SERIES, "_block"], [*SERIES, "zone"]
    # a bar and a zone meet in the first block that both reach into
    inside = _by_price(bars, "low", "high").drop("_step").join(_by_price(ranges, "z_low", "z_high").select(*at, "zone", "z_low", "z_high", c("_from").alias("_z")), at)
    inside = inside.where((c("_block") == F.greatest("_from", "_z")) & (c("low") <= c("z_high")) & (c("high") >= c("z_low")))
    stay = c("i") - F.row_number().over(Window.partitionBy(*each).orderBy("i"))
    stays = inside.withColumn("stay", stay).groupBy(*each, "stay").agg(F.min("i").alias("a"), F.max("i").alias("z"))
    stays = stays.groupBy(*each).agg(F.count_if(c("z") - c("a") < EPISODE).alias("episodes"), F.max("z").alias("stay_idx"))
    # a change of sides lies between two closes; one that is the middle itself keeps the side before
    moves = _by_price(bars.where("prev is not null").withColumns({"_lo": F.least("prev", "close"), "_hi": F.greatest("prev", "close")}), "_lo", "_hi").drop("_step")
    middles = ranges.select(*SERIES, "zone", "mid", F.floor(c("mid") / c("_step")).alias("_block"))
    side = lambda x: F.nullif(F.signum(c(x) - c("mid")), F.lit(0.0))
    met = moves.join(middles, at).where(c("mid").between(c("_lo"), c("_hi"))).withColumns({"now": side("close"), "was": side("prev")})
    met = met.withColumn("was", F.last("was", ignorenulls=True).over(Window.partitionBy(*each).orderBy("i")))
    crossed = met.groupBy(*each).agg(F.count_if(c("now") != c("was")).alias("crossings"))
    return stays.join(crossed, each, "full")


def zones(bars: DataFrame, swings: DataFrame) -> DataFrame:
    """Support and resistance zones of ``bars`` with column ``scale``: a row for each of at most MOST a series, by price (``place`` from 1).

    (symbol, timeframe, place, low, high, mid, kind, touches, first_idx, last_idx, strength, role_reversals, crossings,
    sources, distance, immediate, major). Confirmed swings and the highest and lowest bar (of several the first) join the
    zone below if they are within CLUSTER scales of its mean so far. Touches are distinct swings, or stays of fewer than
    EPISODE bars if these are more; zones with fewer than TOUCHES are left out unless they hold an extreme. ``immediate``
    is the nearest support and resistance, ``major`` the strongest. Series of fewer than LEAST_BARS bars have none.

    A series' swings are folded in one row; zones meet the bars that reach into their price blocks.
    """
    c, w = F.col, Window.partitionBy(*SERIES).orderBy("i")
    ahead = w.rowsBetween(1, REACTION)
    average = F.when(F.count("volume").over(w.rowsBetween(-19, 0)) >= 5, F.avg("volume").over(w.rowsBetween(-19, 0)))
    b = bars.withColumns({"fall": (c("high") - F.min("low").over(ahead)) / c("scale"), "rise": (F.max("high").over(ahead) - c("low")) / c("scale"), "rel": c("volume") / F.nullif(average, F.lit(0.0)), "n": F.count("*").over(Window.partitionBy(*SERIES))})
    b = b.where(c("n") >= LEAST_BARS)
    now = b.groupBy(*SERIES).agg(
        F.max_by("close", "i").alias("price"), F.max_by("scale", "i").alias("now_scale"), F.max("n").alias("n"), F.max_by("close", F.when(c("i") <= F.greatest(F.lit(0), c("n") - 6), c("i"))).alias("earlier"), (F.sum("volume") > 0).alias("has_volume"),
        F.max(F.struct("high", -c("i"), "i")).alias("top"), F.min(F.struct("low", "i")).alias("bottom"),
    )
    extreme = lambda source, price, idx: F.struct(F.lit(source).alias("source"), c(price).alias("level"), c(idx).alias("idx"))
    extremes = now.select(*SERIES, F.explode(F.array(extreme("historical_high", "top.high", "top.i"), extreme("historical_low", "bottom.low", "bottom.i"))).alias("x")).select(*SERIES, "x.*")
    found = swings.where("not provisional").select(*SERIES, F.concat(F.lit("swing_"), "kind").alias("source"), c("price").alias("level"), "idx").unionByName(extremes)

    order = F.sort_array(F.collect_list(F.struct("level", "idx", "source")))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("zone"), F.array().cast("array<int>").alias("zones"))

    def step(acc, x):
        near = x["level"] - acc["sum"] / F.greatest(acc["n"], F.lit(1)) <= CLUSTER * c("now_scale")
        joined = (acc["n"] > 0) & near
        zone = acc["zone"] + F.when(joined, 0).otherwise(1)
        return F.struct((F.when(joined, acc["sum"]).otherwise(0.0) + x["level"]).alias("sum"), (F.when(joined, acc["n"]).otherwise(0) + 1).alias("n"), zone.alias("zone"), F.array_append(acc["zones"], zone).alias("zones"))

    folded = found.join(now, SERIES).groupBy(*SERIES, "now_scale").agg(order.alias("all")).withColumn("zones", F.aggregate("all", start, step, lambda acc: acc["zones"]))
    members = folded.select(*SERIES, F.explode(F.arrays_zip("all", "zones")).alias("x")).select(*SERIES, c("x.zones").alias("zone"), "x.all.*")
    at = b.select(*SERIES, c("i").alias("idx"), "fall", "rise", "rel")
    high = c("source").isin("swing_H", "historical_high")
    made = members.join(at, [*SERIES, "idx"]).groupBy(*SERIES, "zone").agg(
        F.min("level").alias("lo"), F.max("level").alias("hi"), F.count_distinct("idx").alias("pivots"), F.min("idx").alias("first_idx"), F.max("idx").alias("pivot_idx"), F.avg(F.when(high, c("fall")).otherwise(c("rise"))).alias("reaction"),
        F.avg("rel").alias("rel"), (F.bool_or(high) & F.bool_or(~high)).alias("both"), F.bool_or(c("source").startswith("historical")).alias("extreme"), F.array_sort(F.collect_set("source")).alias("sources"),
    ).join(now, SERIES)
    made = made.withColumns({"low": c("lo") - PAD * c("now_scale"), "high": c("hi") + PAD * c("now_scale")}).withColumn("mid", (c("low") + c("high")) / 2)

    seen = _visits(made, b)
    rows = made.join(seen, [*SERIES, "zone"], "left").fillna(0, ["episodes", "crossings"]).withColumns({"touches": F.greatest("pivots", "episodes"), "last_idx": F.greatest("pivot_idx", F.coalesce("stay_idx", "pivot_idx"))}).where((c("touches") >= TOUCHES) | c("extreme"))
    one = lambda x: F.least(F.lit(1.0), x)
    parts = {
        "touches": one(c("touches") / 5), "recency": F.pow(F.lit(0.5), (c("n") - 1 - c("last_idx")) / HALF_LIFE), "rejection": one(F.coalesce("reaction", F.lit(0.0)) / 4), "role_reversal": F.when(c("both"), 1.0).otherwise(0.3),
        "retests": F.when(c("crossings") > 0, one(c("crossings") / 4)).otherwise(0.2), "volume": F.when(c("has_volume"), F.greatest(F.lit(0.0), one(c("rel") / 2))),
    }
    add = lambda x, y: x + y
    strength = 100 * reduce(add, (F.coalesce(x * WEIGHTS[p], F.lit(0.0)) for p, x in parts.items())) / reduce(add, (F.when(x.isNotNull(), WEIGHTS[p]).otherwise(0) for p, x in parts.items()))
    holds = c("price").between(c("low"), c("high"))
    support = F.when(holds, c("earlier") > c("mid")).otherwise(c("mid") < c("price"))
    rows = rows.withColumns({"strength": F.round(strength, 1), "kind": F.when(support, "support").otherwise("resistance")})
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("strength"), "zone"))).where(c("rank") <= MOST)
    side = Window.partitionBy(*SERIES, "kind")
    nearest = F.row_number().over(side.orderBy(F.when(c("kind") == "support", -c("mid")).otherwise(c("mid")))) == 1
    rows = rows.withColumns({"place": F.row_number().over(Window.partitionBy(*SERIES).orderBy("mid")), "immediate": nearest, "major": F.row_number().over(side.orderBy(F.desc("strength"), "mid")) == 1, "distance": F.round((c("mid") - c("price")) / c("now_scale"), 2)})
    return rows.select(*SERIES, "place", "low", "high", "mid", "kind", "touches", "first_idx", "last_idx", "strength", c("both").alias("role_reversals"), "crossings", "sources", "distance", "immediate", "major")


def near_zone(prices: DataFrame, found: DataFrame, price: str, reach: str) -> DataFrame:
    """``prices`` with ``zone``, the lowest place of ``found`` that ``price`` is in or within ``reach`` of; null for none, and ``zones``, how many the series has.

    A series has MOST zones at most, so that they travel as an array.
    """
    listed = found.groupBy(*SERIES).agg(F.sort_array(F.collect_list(F.struct("place", "low", "high"))).alias("_zones"))
    hit = F.filter("_zones", lambda z: F.col(price).between(z["low"] - F.col(reach), z["high"] + F.col(reach)))
    rows = prices.join(listed, SERIES, "left")
    return rows.withColumns({"zone": F.try_element_at(hit, F.lit(1))["place"], "zones": F.coalesce(F.size("_zones"), F.lit(0))}).drop("_zones")
