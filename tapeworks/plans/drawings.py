"""Queries of drawn price paths, their axes and what is claimed of them, over paths that hourly bars give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.operators import matching, patterns
from tapeworks.operators.recursive import recursive, zigzag
from tapeworks.plans.indicators import Query, shown
from tapeworks.plans.oracle import HOURLY, PER
from tapeworks.sources.bars import hourly_events, line_trades

#: Bars of a drawing; every so many stretches of a series one is drawn.
LENGTH, EVERY = 40, 3
# What is said to be on each chart.
CLAIMS = ("Double-Top", "bullish double bottom", "Inverted V top", "Head & Shoulders", "v", "descending triangle")


def drawn(spark, sf_dir) -> DataFrame:
    """Stretches of the hourly bars as pixels: heights from the top of a chart, each a little off."""
    c = F.col
    part = F.floor(c("i") / LENGTH)
    off = ((c("i") * 37) % 11 - 5) * 0.1
    bars = hourly_events(spark, sf_dir).where(part % EVERY == 1).select(F.concat_ws("#", "symbol", part.cast("string")).alias("drawing_id"), (c("i") % LENGTH).alias("k"), *((900 - 4 * c(x) + off).alias(f"y_{x}") for x in ("open", "high", "low", "close")), c("close").alias("price"))
    return bars


def img04(spark, sf_dir) -> DataFrame:
    """Each drawing against all series, by its closes upside up."""
    found = matching.match(drawn(spark, sf_dir).select("drawing_id", "k", (-F.col("y_close")).alias("close")), hourly_events(spark, sf_dir))
    return shown(found, "price_correlation", "return_correlation", "end_i", "n", "matched", keys=("drawing_id", "symbol"))


def img02(spark, sf_dir) -> DataFrame:
    """The axis of each drawing from the prices of its closes, and its candles by that axis."""
    pixels = drawn(spark, sf_dir)
    axes = matching.calibrated(pixels.select("drawing_id", F.col("y_close").alias("y"), "price"))
    return shown(matching.priced(pixels, axes), "open", "high", "low", "close", "uncertainty", keys=("drawing_id", "k"))


def img05(spark, sf_dir) -> DataFrame:
    bars = patterns.context(recursive(line_trades(spark, sf_dir), "scale"))
    found = patterns.detect(bars, zigzag(bars), tuple(i for d in ("double", "v_reversal") for i in patterns.IDS[d]))
    named = found.groupBy(F.col("symbol").alias("drawing_id"), "pattern_id").agg(F.max("quality").alias("quality")).select("drawing_id", F.struct(-F.col("quality"), "pattern_id").alias("place"), F.translate("pattern_id", "_", " ").alias("name"))
    said = spark.createDataFrame(list(enumerate(CLAIMS)), "claim_id int, name string")
    claims = bars.select(F.col("symbol").alias("drawing_id")).distinct().crossJoin(F.broadcast(said))  # six rows
    return matching.supported(claims, named).select("drawing_id", "claim_id", "matched", "supported")


QUERIES: dict[str, Query] = {"img04_match": img04, "img02_03_axes": img02, "img05_claims": img05}

DRAWN = f"""{HOURLY}, drawn AS (SELECT symbol || '#' || (i // {LENGTH}) AS drawing_id, i % {LENGTH} AS k, close AS price, {', '.join(f"900 - 4 * {x} + ((i * 37) % 11 - 5) * 0.1::DOUBLE AS y_{x}" for x in ("open", "high", "low", "close"))} FROM bars WHERE (i // {LENGTH}) % {EVERY} = 1)"""


def sql() -> dict[str, str]:
    match = f"""
WITH {DRAWN}, p AS (SELECT drawing_id, k, -y_close AS x, -y_close - lag(-y_close) OVER (PARTITION BY drawing_id ORDER BY k) AS d, count(*) OVER (PARTITION BY drawing_id) AS n FROM drawn),
b AS (SELECT symbol, i, close AS x, close - lag(close) OVER ({PER}) AS d, count(*) OVER (PARTITION BY symbol) AS bars FROM bars),
c AS (SELECT drawing_id, symbol, i - k + n - 1 AS end_i, any_value(n) AS n, corr(p.x, b.x) AS pc, corr(p.d, CASE WHEN k > 0 THEN b.d END) AS rc FROM p JOIN b ON true GROUP BY 1, 2, 3 HAVING count(*) = any_value(n)),
r AS (SELECT *, row_number() OVER (PARTITION BY drawing_id, symbol ORDER BY round(pc + rc, 9) DESC, end_i) AS place FROM c WHERE pc >= 0.9 AND NOT isnan(pc) AND NOT isnan(rc))
SELECT drawing_id, symbol, round(pc, 6) AS price_correlation, round(rc, 6) AS return_correlation, end_i, n, pc >= 0.95 AND rc >= 0.8 AS matched FROM r WHERE place = 1"""
    axes = f"""
WITH {DRAWN}, f AS (SELECT drawing_id, regr_slope(price, y_close) AS m, regr_intercept(price, y_close) AS s FROM drawn GROUP BY 1 HAVING min(y_close) < max(y_close))
SELECT drawing_id, k, round(m * y_open + s, 6) AS open, round(greatest(m * y_open, m * y_high, m * y_low, m * y_close) + s, 6) AS high, round(least(m * y_open, m * y_high, m * y_low, m * y_close) + s, 6) AS low, round(m * y_close + s, 6) AS close, round(1.5 * abs(m), 6) AS uncertainty
FROM drawn JOIN f USING (drawing_id)"""
    return {"img04_match": match, "img02_03_axes": axes}
