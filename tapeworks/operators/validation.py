"""Raw candles made clean, and a report on what was wrong with them. Nothing is filled in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.operators.resample import MINUTES
from tapeworks.sources.bars import SERIES, indexed, midnight, seconds

# The names that columns may come under.
ALIASES = {
    "timestamp": ("timestamp", "date", "datetime", "time"),
    "open": ("open", "o"),
    "high": ("high", "h"),
    "low": ("low", "l"),
    "close": ("close", "c", "price"),
    "volume": ("volume", "v", "vol"),
}
REQUIRED = ("timestamp", "open", "high", "low", "close")


def named(raw: DataFrame) -> DataFrame:
    """``raw`` with the usual names, whatever the case and blanks of its own; a missing volume is null."""
    own = {c.strip().lower(): c for c in reversed(raw.columns)}
    found = {name: next((own[a] for a in aliases if a in own), None) for name, aliases in ALIASES.items()}
    if missing := [c for c in REQUIRED if not found[c]]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    rest = [c for c in raw.columns if c not in found.values()]
    volume = F.col(f"`{found['volume']}`") if found["volume"] else F.lit(None).cast("double")
    return raw.select(*rest, *(F.col(f"`{found[c]}`").alias(c) for c in REQUIRED), volume.alias("volume"))


def checked(raw: DataFrame, order: str = "position") -> DataFrame:
    """Every row of ``raw`` (symbol, timeframe, timestamp, prices, volume, ``order``) with ``problem``: null for a clean bar.

    ``bad_timestamp``, ``duplicate`` (of rows with one time the last in ``order`` stays) and ``invalid`` prices. Daily
    and coarser times are put to midnight; text that is no number is null.
    """
    numbers = {c: F.expr(f"try_cast({c} AS DOUBLE)") for c in ("open", "high", "low", "close", "volume")}
    ts = F.expr("try_cast(timestamp AS TIMESTAMP_NTZ)")
    b = raw.withColumns({**numbers, "ts": F.when(F.col("timeframe").isin("1d", "1w", "1M"), midnight(ts)).otherwise(ts)})
    # rows without a time are dealt by their place, so that a broken file is not one task's
    twin = F.row_number().over(Window.partitionBy(*SERIES, "ts", F.when(F.col("ts").isNull(), F.col(order))).orderBy(F.desc(order)))
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))  # noqa: E741
    sound = (h >= l) & (h >= F.greatest(o, c) - 1e-9) & (l <= F.least(o, c) + 1e-9) & (o > 0) & (h > 0) & (l > 0) & (c > 0) & F.coalesce(F.col("volume") >= 0, F.lit(True))
    sound = sound & o.isNotNull() & h.isNotNull() & l.isNotNull() & c.isNotNull()
    return b.withColumn("problem", F.when(F.col("ts").isNull(), "bad_timestamp").when(twin > 1, "duplicate").when(~F.coalesce(sound, F.lit(False)), "invalid"))


def clean(raw: DataFrame, order: str = "position") -> DataFrame:
    return indexed(checked(raw, order).where("problem is null").select(*SERIES, "ts", "open", "high", "low", "close", "volume"))


def report(raw: DataFrame, order: str = "position", holidays: DataFrame | None = None, as_of: str | None = None, most_days: float | None = None) -> DataFrame:
    """(symbol, timeframe, rows_in, rows_out, ..., score, rating): a row for each series.

    Missing candles are weekdays of a daily series without a bar that are no ``holidays(date)``, or steps of more than
    one and a half intervals inside a day; jumps are opens more than 30 % from the close before. Seen at the time ``as_of`` a series whose last bar is over
    ``most_days`` old is ``stale``, see ``freshness``; without them none is.
    """
    rows = checked(raw, order)
    counts = rows.groupBy(*SERIES).agg(F.count("*").alias("rows_in"), *(F.count_if(F.col("problem") == p).alias(n) for p, n in (("bad_timestamp", "bad_timestamps"), ("duplicate", "duplicates"), ("invalid", "invalid_rows"))))
    good = clean(raw, order)
    w = Window.partitionBy(*SERIES).orderBy("i")
    minutes = F.create_map(*(F.lit(x) for pair in MINUTES.items() for x in pair))
    step = (seconds(F.col("ts")) - F.lag(seconds(F.col("ts"))).over(w)) / 60
    good = good.withColumns({"jump": F.abs(F.col("open") / F.lag("close").over(w) - 1) > 0.3, "gap": (step > 1.5 * minutes[F.col("timeframe")]) & (F.to_date("ts") == F.to_date(F.lag("ts").over(w)))})
    stats = good.groupBy(*SERIES).agg(
        F.count("*").alias("rows_out"), F.count_if("jump").alias("jumps"), F.count_if("gap").alias("gaps"), F.count_if(F.col("volume") == 0).alias("zero_volume_bars"), (F.count("volume") > 0).alias("has_volume"),
        F.avg(((F.col("high") == F.col("low")) & (F.coalesce("volume", F.lit(0.0)) == 0)).cast("double")).alias("flat_share"), F.to_date(F.min("ts")).alias("first"), F.to_date(F.max("ts")).alias("last"), F.count_distinct(F.when(F.weekday("ts") < 5, F.to_date("ts"))).alias("weekdays"),
    )
    days = stats.where("timeframe = '1d'").select(*SERIES, F.explode(F.sequence("first", "last")).alias("date")).where(F.weekday("date") < 5)
    if holidays is not None:
        days = days.join(holidays.select(F.col("date").cast("date")).distinct(), "date", "left_anti")
    absent = days.join(good.select(*SERIES, F.to_date("ts").alias("date")).distinct(), [*SERIES, "date"], "left_anti").groupBy(*SERIES).agg(F.count("*").alias("absent"))
    r = counts.join(stats, SERIES, "left").join(absent, SERIES, "left").fillna(0, ["rows_out", "jumps", "gaps", "absent", "zero_volume_bars"])
    r = r.withColumn("missing_candles", F.when(F.col("timeframe") == "1d", F.col("absent")).otherwise(F.col("gaps")))
    old = freshness(good, as_of, most_days).select(*SERIES, "stale") if as_of is not None else None
    r = r.withColumn("stale", F.lit(False)) if old is None else r.join(old, SERIES, "left").withColumn("stale", F.coalesce("stale", F.lit(False)))
    lost = lambda most, part, whole: F.least(F.lit(float(most)), 100 * F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    score = 100 - F.when(F.col("rows_out") < 60, 35.0).when(F.col("rows_out") < 200, 10.0).otherwise(0.0) - F.when(F.coalesce("has_volume", F.lit(False)), 0.0).otherwise(15.0) - lost(20, "invalid_rows", "rows_in") - lost(15, "missing_candles", "rows_out") - F.when(F.col("jumps") > 0, 10.0).otherwise(0.0) - F.when(F.col("stale"), 20.0).otherwise(0.0)
    r = r.withColumn("raw", F.when(F.col("rows_out") > 0, score).otherwise(0.0))
    rating = F.when(F.col("rows_out") == 0, "insufficient").when(F.col("raw") >= 80, "high").when(F.col("raw") >= 60, "medium").when(F.col("raw") >= 30, "low").otherwise("insufficient")
    return r.select(*SERIES, "rows_in", "bad_timestamps", "duplicates", "invalid_rows", "rows_out", "zero_volume_bars", (F.coalesce("flat_share", F.lit(0.0)) > 0.05).alias("illiquid"), "jumps", "missing_candles", "stale", F.greatest(F.lit(0.0), F.col("raw")).alias("score"), rating.alias("rating"))


def freshness(bars: DataFrame, as_of: str, most_days: float | None = None, closes: str = "15:30", friday_closes: str = "16:30") -> DataFrame:
    """(symbol, timeframe, last_ts, last_complete, staleness_days, stale) of each series of ``bars``, seen at the local time ``as_of``.

    An intraday bar is complete when its interval has passed; one of a day at the close of its session, of a week at the
    close of its Friday, of a month after its last day. A series is stale if its last bar is over ``most_days`` old.
    """
    c, now = F.col, F.to_timestamp_ntz(F.lit(as_of))
    last = bars.groupBy(*SERIES).agg(F.max("ts").alias("last_ts"))
    minutes = F.create_map(*(F.lit(x) for pair in MINUTES.items() for x in pair))
    day = F.when(c("timeframe") == "1w", F.date_add(F.to_date("last_ts"), (F.lit(11) - F.weekday("last_ts")) % 7)).otherwise(F.to_date("last_ts"))
    session = F.to_timestamp_ntz(F.concat_ws(" ", day.cast("string"), F.when(F.weekday(day) == 4, friday_closes).otherwise(closes)))
    until = (c("last_ts") + F.make_dt_interval(mins=F.try_element_at(minutes, "timeframe"))).cast("timestamp_ntz")
    complete = F.when(c("timeframe").isin("1d", "1w"), now >= session).when(c("timeframe") == "1M", F.to_date(now) > F.last_day("last_ts")).otherwise(now >= until)
    days = (seconds(now) - seconds(c("last_ts"))) / 86400
    return last.select(*SERIES, "last_ts", complete.alias("last_complete"), F.round(days, 2).alias("staleness_days"), (days > most_days if most_days is not None else F.lit(False)).alias("stale"))


def with_completeness(bars: DataFrame, fresh: DataFrame) -> DataFrame:
    """``bars`` with ``complete``: false only for a series' last bar that ``freshness`` finds open."""
    open_ = fresh.where("not last_complete").select(*SERIES, F.col("last_ts").alias("ts"), F.lit(False).alias("complete"))
    return bars.join(open_, [*SERIES, "ts"], "left").withColumn("complete", F.coalesce("complete", F.lit(True)))
