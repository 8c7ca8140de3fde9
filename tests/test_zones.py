"""Times have no zone: rows don't depend on the session's."""

import pytest

import __spark_entry__ as entry

QUERIES = ("src_hourly_bars", "src_daily_bars", "src_streamed_bars", "rsm03_five_to_fifteen_minutes", "rsm03_hours_to_days", "rsm05_days_to_weeks", "rsm06_days_to_months", "ind11_session_vwap", "ind13_rsi", "swg01_zigzag", "val07_clean_bars", "val12_13_freshness", "val14_report", "mtf01_assess")


@pytest.fixture
def zoned(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    yield lambda zone: spark.conf.set("spark.sql.session.timeZone", zone)
    spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("name", QUERIES)
def test_rows_are_those_of_utc(spark, sf_dir, zoned, name):
    found = []
    for zone in ("UTC", "America/New_York", "Asia/Karachi"):
        zoned(zone)
        found.append(sorted(map(str, entry.queries()[name](spark, sf_dir).collect())))
    assert found[0] == found[1] == found[2] != []


def test_recursive_keeps_times_of_a_zone(spark, zoned):
    from tapeworks.operators.recursive import recursive

    zoned("America/New_York")
    bars = spark.sql("SELECT 'a' AS symbol, '1h' AS timeframe, i, timestamp'2024-03-10 01:30:00' + make_interval(0, 0, 0, 0, i) AS ts, 10D + i AS open, 11D + i AS high, 9D AS low, 10D AS close FROM (SELECT explode(sequence(0, 5)) AS i)")
    found = recursive(bars, "scale")
    assert found.schema["ts"].dataType == bars.schema["ts"].dataType
    assert found.select("i", "ts").orderBy("i").collect() == bars.select("i", "ts").orderBy("i").collect()
