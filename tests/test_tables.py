import threading

import pytest

from tapeworks.sources import pages, tables


@pytest.fixture
def lists(spark, tmp_path):
    return tables.watchlists(spark, str(tmp_path))


def rows(table, version=None):
    return sorted(map(tuple, table.read(version).collect()), key=str)


def frame(table, *found):
    return table.spark.createDataFrame(found, table.schema)


def test_versions(lists):
    assert lists.version() == 0 and rows(lists) == []
    assert lists.put(frame(lists, ("tech", "a"), ("tech", "b"), ("tech", "a"), (None, "x"))) == 1
    assert lists.put(frame(lists, ("tech", "c"), (None, "x"))) == 2
    assert lists.remove(frame(lists, ("tech", "a"), ("none", "z"))) == 3
    assert rows(lists) == [("tech", "b"), ("tech", "c"), (None, "x")] and rows(lists, 1) == [("tech", "a"), ("tech", "b"), (None, "x")]


def test_a_key_has_one_row(spark, tmp_path):
    presets = tables.presets(spark, str(tmp_path))
    presets.put(frame(presets, ("p", "scan", "{}"), ("p", "backtest", "{}")))
    presets.put(frame(presets, ("p", "scan", "{1}")))
    assert rows(presets) == [("p", "backtest", "{}"), ("p", "scan", "{1}")]


def test_two_writers_lose_nothing(lists):
    failed = []

    def add(who):
        try:
            for k in range(4):
                lists.put(frame(lists, (who, str(k))))
        except Exception as failure:
            failed.append(failure)

    both = [threading.Thread(target=add, args=(who,)) for who in "ab"]
    [t.start() for t in both]
    [t.join() for t in both]
    assert not failed and lists.version() == 8 and rows(lists) == [(who, str(k)) for who in "ab" for k in range(4)]


def test_the_second_of_a_version_is_turned_down(lists):
    lists.put(frame(lists, ("a", "1")))
    assert not lists._named(1, "rows-other") and rows(lists) == [("a", "1")]


def test_watched_symbols(spark, lists):
    lists.put(frame(lists, ("tech", "abc"), ("tech", "gone")))
    bars = spark.createDataFrame([("ABC", 1), ("Def", 2), ("ghi", 3)], "symbol string, i int")
    seen = lambda *a, **k: sorted(r["i"] for r in tables.watched(bars, lists, *a, **k).collect())
    assert seen("tech") == [1] and seen("tech", ("DEF", "abc")) == [1, 2] and seen(symbols=("ghi",)) == [3] and seen() == [1, 2, 3]
    with pytest.raises(LookupError):
        tables.watched(bars, lists, "other")


def test_audit_trail_and_rules(spark, tmp_path):
    trail = tables.audit(spark, str(tmp_path))
    tables.record(trail, "me", "put", "rule 1")
    tables.record(trail, "me", "put", "rule 1")
    assert trail.read().count() == 2 and trail.read().where("at is null").count() == 0
    rules = tables.alert_rules(spark, str(tmp_path))
    rules.put(spark.createDataFrame([(1, "a", "price_above", 5.0, None, None, None, True)], rules.schema))
    assert rules.read().first()["condition"] == "price_above"


SIDE = "struct<valid:boolean,trigger:string,stop:double,targets:array<struct<price:double>>,primary_rr:double,confidence:double>"
ZONE = "struct<low:double,high:double>"
REPORT = f"symbol string, timeframe string, close double, change_pct double, score double, rating string, coverage double, alignment string, patterns array<struct<pattern_id:string,stage:string,direction:string,level:double,inval:double,target:double,quality:double>>, immediate_support {ZONE}, immediate_resistance {ZONE}, major_support {ZONE}, major_resistance {ZONE}, breakout_trigger double, breakdown_trigger double, long {SIDE}, short {SIDE}, summary string, conflicts array<string>, changes array<string>, conclusion string"


def test_pages_are_escaped_and_one_file_each(spark, tmp_path):
    long = (True, "close > 5 & <b>", 1234.5, [(6.0,)], 2.0, 71.0)
    full = ("A<&>", "1d", 5.0, 1.5, 61.0, "Bullish", 0.9, "mostly_up", [("double_top", "forming", "bearish", 1.0, None, 2.0, 50.0)], (1.0, 2.0), None, None, None, 9.0, None, long, None, "It's <i>\"up\"</i>", ["a < b"], [], "wait")
    empty = ("b", "1d", *[None] * 19)
    made = spark.createDataFrame([full, empty], REPORT)
    shown = {r["symbol"]: r["html"] for r in pages.documents(made).collect()}
    page = shown["A<&>"]
    for part in ("A&lt;&amp;&gt; 1d", "close &gt; 5 &amp; &lt;b&gt;", "It&#x27;s &lt;i&gt;&quot;up&quot;&lt;/i&gt;", "<li>a &lt; b</li>", "1,234.50", "<td>double top</td>", "no valid setup", "mostly up"):
        assert part in page
    assert "<i>" not in page and "None" not in page and "null" not in page
    assert "no current pattern" in shown["b"] and shown["b"].endswith("</html>")
    pages.write(made, str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("symbol=*/timeframe=1d/part-*.txt"))
    assert len(files) == 2 and page in {f.read_text().rstrip("\n") for f in files}
