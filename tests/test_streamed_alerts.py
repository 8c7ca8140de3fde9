import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tapeworks.operators import alerts
from tapeworks.operators.recursive import recursive, zigzag
from tapeworks.sources.bars import indexed
from tapeworks.streaming import alerts as watched

BAR = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def bars():
    rng, out = random.Random(4), []
    for symbol in ("a", "b"):
        price = 50.0
        for k in range(260):
            price = max(5.0, price + rng.gauss(0, 1.5))
            out.append((symbol, datetime(2024, 10, 27) + timedelta(hours=k), price, price + rng.random(), price - rng.random(), price + rng.gauss(0, 0.2), None if k == 40 else float(rng.randint(1, 60))))
    return out


@pytest.fixture
def new_york(spark):
    """A zone whose clock goes back within the bars."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def part(spark, rows, path, name):
    spark.createDataFrame(rows, BAR).coalesce(1).write.parquet(f"{path}/{name}")


def stream(spark, path):
    return spark.readStream.schema(BAR).parquet(f"{path}/*")


RULES = [(k, s, c, x, None, 50, 200) for s in "ab" for k, (c, x) in enumerate([("price_above", 50.0), ("price_below", 50.0), ("cross_sma50", None), ("ma_crossover", None)])] + [(9, "a", "unusual_volume", None, 1.5, None, None), (10, "gone", "price_above", 1.0, None, None, None)]


def test_stream_equals_batch_after_a_restart(spark, bars, tmp_path, new_york):
    rules = spark.createDataFrame(RULES, alerts.RULE)
    source, folder = str(tmp_path / "bars"), str(tmp_path / "alerts")
    early, late = [b for b in bars if b[1] < datetime(2024, 11, 3, 1)], [b for b in bars if b[1] >= datetime(2024, 11, 3, 1)]
    repeated = late[::-1] + early[:5]  # in any order inside a batch; bars of earlier batches come again
    for name, rows in (("one", early), ("two", repeated)):
        part(spark, rows, source, name)
        watched.start(watched.follow(stream(spark, source)), rules, folder).awaitTermination()
    got = {(r["rule_id"], r["symbol"], r["i"]): round(r["price"], 9) for r in watched.read(spark, folder, "hits", watched.HITS).collect()}
    every = indexed(spark.createDataFrame(bars, BAR).withColumn("timeframe", F.lit("1h"))).cache()
    want = {}
    for last in (28, 29, 60, 100, 199, 200, 201, 230, 259):
        for r in alerts.evaluate(every.where(F.col("i") <= last), rules).where("status = 'hit'").collect():
            want[r["rule_id"], r["symbol"], r["i"]] = round(r["price"], 9)
    assert {k: v for k, v in got.items() if k[2] in (28, 29, 60, 100, 199, 200, 201, 230, 259)} == want != {}
    assert len(got) > 20 and max(i for *_, i in got) > 200


def test_scale_and_swings_follow_the_walk(spark, bars, tmp_path):
    source, out = str(tmp_path / "bars"), str(tmp_path / "out")
    for low in (0, 70, 71, 200):
        part(spark, [b for k, b in enumerate(bars) if low <= k % 260 < {0: 70, 70: 71, 71: 200, 200: 260}[low]], source, f"from{low}")
        watched.follow(stream(spark, source)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination()
    got = spark.read.parquet(out).collect()
    every = recursive(indexed(spark.createDataFrame(bars, BAR).withColumn("timeframe", F.lit("1h"))), "scale").cache()
    scales = {(r["symbol"], r["i"] + 1): round(r["scale"], 9) for r in every.collect()}
    assert {(r["symbol"], r["n"]): round(r["scale"], 9) for r in got} == scales
    turns = {(r["symbol"], r["confirmed_idx"], r["idx"], r["kind"], round(r["price"], 9)) for r in zigzag(every).where("not provisional").collect()}
    assert {(r["symbol"], r["n"] - 1, r["turn_i"], r["turn"], round(r["turn_price"], 9)) for r in got if r["turn"]} == turns != set()


def test_deliveries_and_status(spark, bars, tmp_path):
    import time

    def refuse(hit):
        raise ConnectionError("refused " * 60)

    source, folder = str(tmp_path / "bars"), str(tmp_path / "alerts")
    part(spark, bars, source, "one")
    monitor = watched.Monitor()
    spark.streams.addListener(monitor)
    wanted = spark.createDataFrame([(0, "log"), (0, "hook"), (0, "hook"), (1, "fax")], "rule_id long, channel string")
    query = watched.start(watched.follow(stream(spark, source)), spark.createDataFrame(RULES, alerts.RULE), folder, {"log": lambda hit: f"{hit['condition']} {hit['symbol']}", "hook": refuse}, wanted)
    query.awaitTermination()
    hits = watched.read(spark, folder, "hits", watched.HITS).groupBy("rule_id").count().collect()
    counts = {r["rule_id"]: r["count"] for r in hits}
    told = {(r["channel"], r["ok"]): (r["count"], r["detail"]) for r in watched.read(spark, folder, "deliveries", watched.DELIVERED).groupBy("channel", "ok").agg(F.count("*").alias("count"), F.max("detail").alias("detail")).collect()}
    assert {k: n for k, (n, _) in told.items()} == {("log", True): counts[0], ("hook", False): counts[0], ("fax", False): counts[1]}
    assert told["fax", False][1] == "unknown channel" and told["log", True][1] == "price_above b" and len(told["hook", False][1]) == 200
    for _ in range(50):
        if not monitor.heard.get(str(query.id), {}).get("running", True):
            break
        time.sleep(0.2)
    seen = watched.status(query, monitor)
    assert not seen["running"] and not seen["monitoring"] and seen["last_error"] is None and seen["rows"] >= len(bars) and seen["last_run"] and len(seen["notes"]) == 2
    spark.streams.removeListener(monitor)


def test_failure_is_in_the_status(spark, bars, tmp_path):
    import time

    source = str(tmp_path / "bars")
    part(spark, bars[:40], source, "one")
    monitor = watched.Monitor()
    spark.streams.addListener(monitor)
    broken = spark.createDataFrame(RULES, alerts.RULE).withColumn("level", F.raise_error(F.lit("no level")).cast("double"))
    query = watched.start(watched.follow(stream(spark, source)), broken, str(tmp_path / "alerts"))
    with pytest.raises(Exception, match="no level"):
        query.awaitTermination()
    for _ in range(50):
        if monitor.heard.get(str(query.id), {}).get("last_error"):
            break
        time.sleep(0.2)
    assert watched.status(query, monitor)["last_error"]
    spark.streams.removeListener(monitor)


def test_nothing_to_read(spark, tmp_path):
    assert watched.read(spark, str(tmp_path), "hits", watched.HITS).count() == 0
