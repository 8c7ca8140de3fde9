"""Sharding by fixed virtual slots (operator 3), with DataFrame functions only.

Rows are hashed into thousands of slots; only the slots' byte counts decide which shard a slot goes to. The map from
slot to shard is a small versioned table: rebalancing writes a new version that moves as few slots as it needs.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, stored

SLOTS, SHARDS, ROW_BYTES = 4096, 24, 8
MAP = "version int, vslot int, shard int, bytes long, rows long"


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot) of every row; a null text counts as no bytes. Rows alike in all share a slot."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    row = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text).alias("text_crc32"))
    return row.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    """(vslot, bytes, rows): one row for each slot that holds any."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def _assign(items: Column, loads: Column) -> Column:
    """Fold of items (bytes, rows, vslot), largest first, each to the shard with the fewest bytes so far (of equals the first)."""
    start = F.struct(loads.cast("array<bigint>").alias("loads"), F.expr("cast(array() as array<struct<vslot:int,shard:int,bytes:bigint,rows:bigint>>)").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        shard = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        loads = F.transform(acc["loads"], lambda y, i: y + F.when(i == shard, x["bytes"]).otherwise(0))
        return F.struct(loads.alias("loads"), F.concat(acc["at"], F.array(F.struct(x["vslot"].alias("vslot"), shard.alias("shard"), x["bytes"].alias("bytes"), x["rows"].alias("rows")))).alias("at"))

    return F.aggregate(items, start, step, lambda acc: acc["at"])


def _as_map(filled: DataFrame, version: int) -> DataFrame:
    return filled.select(F.explode("at").alias("x")).select(F.lit(version).alias("version"), "x.vslot", "x.shard", "x.bytes", "x.rows")


def slot_map(stats: DataFrame, shards: int = SHARDS, version: int = 1) -> DataFrame:
    """The first map (version, vslot, shard, bytes, rows): slots by falling bytes, each to the lightest shard.

    ``stats`` has at most as many rows as there are slots, so that they fit one row.
    """
    largest = F.sort_array(F.collect_list(F.struct("bytes", "rows", "vslot")), asc=False)
    return _as_map(stats.agg(_assign(largest, F.array_repeat(F.lit(0), shards)).alias("at")), version)


def rebalance(old: DataFrame, stats: DataFrame, shards: int) -> DataFrame:
    """The next version of ``old`` for ``stats`` and ``shards``: a slot stays unless its shard holds more than its share.

    In each shard slots are kept by falling bytes while they fit the mean; the others, those of dropped shards and new
    slots go to the lightest shards.
    """
    version = old.agg(F.max("version").alias("v")).first()["v"]
    have = stats.join(old.select("vslot", "shard"), "vslot", "left").withColumn("mean", F.sum("bytes").over(Window.partitionBy()) / shards)
    run = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot"))
    stays = (F.col("shard") < shards) & (run <= F.col("mean"))
    have = have.withColumn("stays", F.coalesce(stays, F.lit(False)))
    kept = have.where("stays").select(F.lit(version + 1).alias("version"), "vslot", "shard", "bytes", "rows")
    loads = kept.groupBy("shard").agg(F.sum("bytes").alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("shard", "b"))).alias("m"))
    moved = have.where("not stays").agg(F.sort_array(F.collect_list(F.struct("bytes", "rows", "vslot")), asc=False).alias("items"))
    each = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    return kept.unionByName(_as_map(moved.crossJoin(loads).select(_assign(F.col("items"), each).alias("at")), version + 1))  # one row each


def latest(spark: SparkSession, map_path: str) -> DataFrame | None:
    """The last version of the map stored below ``map_path``; None where there is none."""
    try:
        stored_maps = spark.read.schema(MAP).parquet(map_path)
        version = stored_maps.agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if version is None else stored_maps.where(F.col("version") == version)


def versioned_map(spark: SparkSession, stats: DataFrame, shards: int, map_path: str) -> DataFrame:
    """The map of the slots in ``stats``, from what is stored below ``map_path``.

    Without a stored map version 1 is written. Else the last version is edited (see ``rebalance``) into the next one,
    which is written beside it; a version that is there is never written again.
    """
    old = latest(spark, map_path)
    version = 1 if old is None else old.first()["version"] + 1
    made = slot_map(stats, shards) if old is None else rebalance(old, stats, shards)
    path = f"{map_path.rstrip('/')}/version={version}"
    made.coalesce(1).drop("version").write.mode("error").parquet(path)
    return spark.read.schema(MAP.replace("version int, ", "")).parquet(path).withColumn("version", F.lit(version))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Every row with its shard: (doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, version).

    The law is ``bytes``: shards' bytes differ by about the smallest slots. ``slot`` numbers a shard's rows from 0 without
    gaps: the rows of the shard's slots before, plus the number inside the virtual slot, so no shard is one task's. With
    ``map_path`` the map stored there is edited into its next version, so that most slots stay where they are; without
    one, or at a path without a map, rows get version 1. Null ids and texts, empty texts and repeated rows are rows like
    others; an empty table gives no rows (and a map without slots, at which the next call begins anew); other columns
    are unused.
    """
    rows = stored(slotted(docs, id_col, text_col, slots), "slotted")
    kept = versioned_map(docs.sparkSession, slot_bytes(rows), shards, map_path or shared_path(docs.sparkSession, "slot-map"))
    before = kept.select("vslot", "shard", "version", (F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot")) - F.col("rows")).alias("before"))
    number = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        rows.withColumn("number", number)
        .join(F.broadcast(before), "vslot")  # a row for each slot
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("number")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", "version")
    )
