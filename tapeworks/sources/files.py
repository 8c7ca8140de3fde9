"""Candle files and the native store."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.operators.resample import MINUTES, can_resample, resample
from tapeworks.operators.validation import clean, named, report

#: A file of candles is called SYMBOL_timeframe.csv.
NAME = r"^([A-Za-z0-9.\-]{1,20})_(" + "|".join(MINUTES) + r")\.csv$"
RAW = "symbol string, timeframe string, timestamp string, open string, high string, low string, close string, volume string, position bigint"


def read_csv(spark: SparkSession, folder: str) -> DataFrame:
    """All candle files of a folder as one raw frame (symbol, timeframe, timestamp, prices, volume, position), all text.

    Lines that begin with ``#`` are comments. Each file's columns are named by its own header, in any order and by any of
    the usual names; files whose header lacks one that is needed raise. The frame goes to ``validation``.
    """
    # a block's lines follow those of the block before, whichever task reads it
    place = (F.col("_metadata.file_block_start") + F.monotonically_increasing_id() % (1 << 33)).alias("position")
    lines = spark.read.text(f"{folder}/*.csv").select(F.regexp_replace("value", "^\ufeff", "").alias("value"), F.col("_metadata.file_name").alias("file"), place)
    lines = lines.withColumns({"symbol": F.upper(F.regexp_extract("file", NAME, 1)), "timeframe": F.regexp_extract("file", NAME, 2)})
    lines = lines.where((F.col("symbol") != "") & (F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    first = lines.groupBy("symbol", "timeframe").agg(F.min_by("value", "position").alias("header"), F.min("position").alias("at"))
    kinds = [r["header"] for r in first.select("header").distinct().collect()]  # as many as there are layouts
    if not kinds:
        return spark.createDataFrame([], RAW)
    rows = lines.join(first, ["symbol", "timeframe"]).where("position > at")
    parts = []
    for header in kinds:
        columns = [c.strip() for c in next(csv.reader([header]))]
        cells = F.from_csv("value", ", ".join(f"_{k} string" for k in range(len(columns)))).alias("cells")
        own = rows.where(F.col("header") == header).select("symbol", "timeframe", "position", cells)
        parts.append(named(own.select("symbol", "timeframe", "position", *(F.trim(f"cells._{k}").alias(c) for k, c in enumerate(columns) if c.lower() not in ("symbol", "timeframe", "position")))))
    names = [c.split()[0] for c in RAW.split(", ")]
    return reduce(DataFrame.unionByName, [p.select(*(F.col(n).cast("string") if n != "position" else F.col(n) for n in names)) for p in parts])


def with_notes(bars: DataFrame, notes: DataFrame) -> DataFrame:
    """``bars`` with the ``provider``, ``adjusted`` (null if unknown) and ``synthetic`` of their series from ``read_notes``."""
    return bars.join(notes, ["symbol", "timeframe"], "left").withColumn("synthetic", F.coalesce("synthetic", F.lit(False)))


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """(symbol, timeframe, provider, adjusted, synthetic) from the files SYMBOL_timeframe.meta.json of a folder."""
    found = spark.read.option("multiLine", True).schema("provider string, adjusted boolean, is_synthetic boolean").json(f"{folder}/*.meta.json").select("*", F.col("_metadata.file_name").alias("file"))
    name = NAME.replace("csv", r"meta\.json")
    return found.select(F.upper(F.regexp_extract("file", name, 1)).alias("symbol"), F.regexp_extract("file", name, 2).alias("timeframe"), "provider", "adjusted", F.coalesce("is_synthetic", F.lit(False)).alias("synthetic")).where("symbol <> ''")


def save_upload(raw: DataFrame, path: str) -> DataFrame:
    """Validate uploaded candles, write their clean bars to the store and return the report on each series.

    Series whose symbol is no name of up to 20 capital letters, digits, dots and dashes, or that keep no bar, are not
    written.
    """
    report_ = report(raw)
    good = clean(raw).where(F.col("symbol").rlike(r"^[A-Z0-9.\-]{1,20}$"))
    write_bars(good, path)
    return report_


def bars_of(bars: DataFrame, timeframe: str) -> DataFrame:
    """The bars of every symbol in ``timeframe``: its own, else resampled from the coarsest timeframe that it can be made from."""
    wanted = reachable(bars).where(F.col("timeframe") == timeframe).select("symbol", "source")
    chosen = bars.join(wanted, "symbol").where(F.col("timeframe") == F.col("source")).drop("source")
    own = chosen.where(F.col("timeframe") == timeframe)
    made = [resample(chosen.where(F.col("timeframe") == source), source, timeframe) for source in MINUTES if source != timeframe and can_resample(source, timeframe)]
    return reduce(DataFrame.unionByName, [own, *(m.select(*own.columns) for m in made)])


def routed(natural: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Symbols that begin with ``SYN-`` from ``synthetic`` alone, all others from ``natural`` alone."""
    made = F.upper("symbol").startswith("SYN-")
    return natural.where(~made).unionByName(synthetic.where(made))


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars as Parquet by timeframe and symbol; only the series that ``bars`` hold are replaced."""
    bars.repartition("timeframe", "symbol").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("timeframe", "symbol").parquet(path)


def read_bars(spark: SparkSession, path: str, symbol: str | None = None, timeframe: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of the store; all conditions reach the scan, those on symbol and timeframe as partitions."""
    bars = spark.read.parquet(path)
    for column, value in (("symbol", symbol), ("timeframe", timeframe)):
        bars = bars.where(F.col(column) == value) if value is not None else bars
    bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz")) if start is not None else bars
    return bars.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz")) if end is not None else bars


def first_of(*sources: DataFrame) -> DataFrame:
    """For each series the bars of the first source that has any."""
    ranked = [s.withColumn("_source", F.lit(k)) for k, s in enumerate(sources)]
    rows = ranked[0]
    for s in ranked[1:]:
        rows = rows.unionByName(s)
    return rows.withColumn("_first", F.min("_source").over(Window.partitionBy("symbol", "timeframe"))).where("_source = _first").drop("_source", "_first")


def reachable(bars: DataFrame) -> DataFrame:
    """(symbol, timeframe, source): the timeframes that a symbol has or can be made from, the coarsest, for each."""
    spark = bars.sparkSession
    pairs = spark.createDataFrame([(b, a, MINUTES[b]) for a in MINUTES for b in MINUTES if a == b or can_resample(b, a)], "source string, timeframe string, minutes int")
    own = bars.select("symbol", F.col("timeframe").alias("source")).distinct()
    return own.join(F.broadcast(pairs), "source").groupBy("symbol", "timeframe").agg(F.max_by("source", "minutes").alias("source"))


def resolve(query: DataFrame, symbols: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query, symbol) of names: by alias, else the symbol itself, else the first symbol whose name contains it, else null.

    ``symbols`` are (ord, symbol, name), ``aliases`` (alias, symbol); both are small tables of what can be traded.
    """
    q = query.select("query", F.upper(F.trim("query")).alias("q")).distinct()
    by_alias = q.join(aliases.select(F.upper("alias").alias("q"), F.col("symbol").alias("a")), "q", "left")
    exact = by_alias.join(symbols.select(F.upper("symbol").alias("q"), F.col("symbol").alias("s")), "q", "left")
    rest = exact.where("a is null and s is null").select("query", "q")
    part = rest.join(F.broadcast(symbols), F.upper("name").contains(F.col("q"))).groupBy("query").agg(F.min_by("symbol", "ord").alias("p"))
    return exact.join(part, "query", "left").select("query", F.coalesce("a", "s", "p").alias("symbol"))
