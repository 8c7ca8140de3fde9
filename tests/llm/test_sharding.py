import zlib
from collections import Counter, defaultdict

from tapeworks.llm import sharding


def test_rows_bytes_and_slots(awkward, documents):
    for docs in (awkward, documents):
        rows = sharding.shard(docs).collect()
        want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
        shards = defaultdict(list)
        for r in rows:
            assert 0 <= r["shard"] < 24 and r["law"] == "bytes" and r["grown_shard"] is None
            shards[r["shard"]].append(r["slot"])
        for slots in shards.values():
            assert sorted(slots) == list(range(len(slots)))


def test_bytes_are_near_equal(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "repeat('x', cast(pmod(id * 7919, 4000) as int)) AS text")
    sizes = [r["b"] for r in sharding.shard(docs).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) < 0.005 * sum(sizes) / 24


def test_rebalance_moves_little(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "repeat('x', 100) AS text")
    stats = sharding.slot_bytes(sharding.slotted(docs))
    old = sharding.slot_map(stats, 24)
    new = sharding.rebalance(old, stats, 25)
    was, now = ({r["vslot"]: (r["shard"], r["bytes"]) for r in m.collect()} for m in (old, new))
    assert was.keys() == now.keys() and {r["version"] for r in new.collect()} == {2}
    moved = sum(b for v, (s, b) in now.items() if was[v][0] != s)
    loads = Counter()
    for s, b in now.values():
        loads[s] += b
    total = sum(loads.values())
    assert len(loads) == 25 and moved < 0.08 * total and max(loads.values()) < 1.05 * total / 25


def test_stored_maps_are_edited_not_replaced(spark, tmp_path):
    path = str(tmp_path / "map")
    docs = spark.range(6000).selectExpr("id AS doc_id", "repeat('x', cast(id % 300 as int)) AS text")
    first = {r["doc_id"]: r for r in sharding.shard(docs.where("doc_id < 4000"), map_path=path).collect()}
    stored = {r["vslot"]: (r["shard"], r["bytes"]) for r in sharding.latest(spark, path).collect()}
    second = {r["doc_id"]: r for r in sharding.shard(docs, map_path=path).collect()}
    assert {r["version"] for r in first.values()} == {1} and {r["version"] for r in second.values()} == {2}
    maps = spark.read.schema(sharding.MAP).parquet(path)
    assert {r["vslot"]: (r["shard"], r["bytes"]) for r in maps.where("version = 1").collect()} == stored
    assert sorted(r["version"] for r in maps.select("version").distinct().collect()) == [1, 2]
    assert sum(second[i]["shard"] != r["shard"] for i, r in first.items()) < 0.25 * len(first)
    loads = Counter()
    for r in second.values():
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) < 1.03 * sum(loads.values()) / 24
    grown = {r["doc_id"]: r for r in sharding.shard(docs, map_path=path, shards=25).collect()}
    assert {r["version"] for r in grown.values()} == {3} and {r["shard"] for r in grown.values()} == set(range(25))
    assert sum(grown[i]["shard"] != r["shard"] for i, r in second.items()) < 0.15 * len(second)


def test_empty_table(nothing):
    assert sharding.shard(nothing).collect() == []
