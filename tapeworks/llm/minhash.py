"""Near-duplicate documents by DartMinHash signatures and banded joining (operator 5).

A document is the multiset of its five-word shingles. Over each unit of an element's weight lies a line of darts whose
gaps are exponential in hashes of the element, so that two documents meet the same darts over the weight they share.
Only darts up to a rank set by the total weight are drawn; each dart falls on one coordinate, and the earliest of each
coordinate is kept. Coordinates agree with a chance equal to the weighted Jaccard similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE, SIMILARITY, by_bytes, components, fresh, mix, shingle_hashes, stored, weighted_jaccard, word_hashes

#: At a similarity of 0.8 all bands differ with a chance of (1 - 0.8 ** 5) ** 30, seven in a million.
BANDS, ROWS = 30, 5
#: Candidates are first held against each other by a code of a byte for each of CODES coordinates. Of those with a
#: similarity of 0.8, one in a hundred thousand agrees in fewer than 0.8 less SLACK deviations.
CODES, SLACK = 512, 4.2
#: Classes of a band that one task compares at most (about: they are dealt by hash); larger bands are compared in blocks.
BLOCK = 2048
#: Bands of more classes than SMALL are first compared with their most central class, found by the first CENTRAL codes.
SMALL, CENTRAL = 8, 128
GOLD, SIDE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def darts(elements: np.ndarray, weights: np.ndarray, coordinates: int) -> np.ndarray:
    """The signature of a weighted set: one 64-bit token for each coordinate. Weights are positive, elements distinct."""
    units = np.ceil(weights).astype(np.int64)
    which = np.repeat(np.arange(len(elements)), units)
    floor = np.arange(len(which)) - np.repeat(np.cumsum(units) - units, units)  # the units of weight below
    strips = mix(elements[which] + floor.astype(np.uint64) * SIDE)
    room = np.minimum(1.0, weights[which] - floor)
    rank = coordinates * (math.log(coordinates) + 2) / weights.sum()
    while True:
        ranks, tokens = [], []
        at, live, drawn = np.zeros(len(strips)), np.arange(len(strips)), 0
        while len(live):
            width = int(rank + 2 * math.sqrt(rank)) + 1
            base = mix(strips[live, None] + np.arange(drawn, drawn + width, dtype=np.uint64) * GOLD)
            reach = at[live, None] + np.cumsum(-np.log(((base >> np.uint64(11)) + np.uint64(1)) * 2.0**-53), axis=1)
            hit = reach <= rank
            token, drawn_at = mix(base[hit] ^ SIDE), reach[hit]
            if room.min() < 1:
                inside = ((mix(token) >> np.uint64(11)) + np.uint64(1)) * 2.0**-53 <= np.broadcast_to(room[live, None], hit.shape)[hit]
                token, drawn_at = token[inside], drawn_at[inside]
            ranks.append(drawn_at)
            tokens.append(token)
            at[live] = reach[:, -1]
            live, drawn = live[reach[:, -1] <= rank], drawn + width
        ranks, tokens = np.concatenate(ranks), np.concatenate(tokens)
        tokens = tokens[np.argsort(-ranks)]
        where = (tokens % np.uint64(coordinates)).astype(np.int64)
        signature, met = np.zeros(coordinates, np.uint64), np.zeros(coordinates, bool)
        signature[where] = tokens  # of several the last, the earliest dart, stays
        met[where] = True
        if met.all():
            return signature
        rank *= 2


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    rows = signature.reshape(bands, -1)
    key = np.arange(bands, dtype=np.uint64)
    for i in range(rows.shape[1]):
        key = mix(key * GOLD + rows[:, i])
    return key.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, key, weight, bands): key is the MD5 of the text, weight its number of shingles; no bands without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, 2):
            weights, keys = [], []
            for text in part.column(2).to_pylist():
                shingles = shingle_hashes(word_hashes(text), shingle)
                weights.append(len(shingles))
                elements, counts = np.unique(shingles, return_counts=True)
                keys.append(band_keys(darts(elements, counts.astype(float), bands * rows), bands) if len(shingles) else [])
            yield pa.record_batch([part.column(0), part.column(1), pa.array(weights, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "key", "weight", "bands"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, key binary, weight long, bands array<long>")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("key"), text.alias("text"))


def _coded(texts: DataFrame, shingle: int) -> DataFrame:
    """(key, code): the low bytes of a long signature of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, 1):
            codes = []
            for text in part.column(1).to_pylist():
                elements, counts = np.unique(shingle_hashes(word_hashes(text), shingle), return_counts=True)
                codes.append((mix(darts(elements, counts.astype(float), CODES)) >> np.uint64(56)).astype(np.uint8).tobytes())
            yield pa.record_batch([part.column(0), pa.array(codes, pa.binary())], names=["key", "code"])

    return texts.select("key", "text").mapInArrow(run, "key binary, code binary")


def _bar(similarity: float, codes: int = CODES) -> int:
    """In how many of ``codes`` coordinates two codes must agree for their texts to be compared."""
    return int(codes * (similarity - SLACK * math.sqrt(similarity * (1 - similarity) / codes)))


def _codes(column: pa.Array | pa.ChunkedArray, codes: int = CODES) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, codes)


def _verified(pairs: DataFrame, codes: DataFrame | None, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The ``pairs(a, b)`` whose codes, if given, agree often enough and whose texts have at least ``similarity``."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = (_codes(batch.column(2)) == _codes(batch.column(3))).sum(axis=1) >= _bar(similarity) if batch.num_rows else []
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if x != last:
                    last, known = x, shingle_hashes(word_hashes(x), shingle)
                keep.append(weighted_jaccard(known, shingle_hashes(word_hashes(y), shingle)) >= similarity)
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def both(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
        sides = [of.select(F.col("key").alias(side), F.col(column).alias(name)) for side, name in (("a", "x"), ("b", "y"))]
        return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "x", "y")

    if codes is not None:
        pairs = stored(both(pairs, codes, "code").mapInArrow(agree, "a binary, b binary"), "alike")
    return both(pairs, texts, "text").mapInArrow(compare, "a binary, b binary")


def _blocked(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` with ``blocks``, how many their band is dealt into, and ``own``, the one that a class is in."""
    sizes = rows.groupBy("band").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    return rows.join(sizes, "band").withColumn("own", F.pmod(F.xxhash64("key"), "blocks").cast("int"))


def _to_centre(inside: DataFrame, codes: DataFrame, similarity: float, block: int) -> DataFrame:
    """Pairs (a, b) of each class with the class of its band (or block of it) that agrees most with what most of them hold."""

    def run(table: pa.Table) -> pa.Table:
        keys, found = table["key"].to_pylist(), _codes(table["code"], CENTRAL)
        usual = np.array([np.bincount(x, minlength=256).argmax() for x in found.T], np.uint8)
        order = sorted(range(len(keys)), key=lambda i: (-int((found[i] == usual).sum()), keys[i]))
        centre = order[0]
        near = np.flatnonzero((found == found[centre]).sum(axis=1) >= _bar(similarity, CENTRAL))
        pairs = [(min(keys[i], keys[centre]), max(keys[i], keys[centre])) for i in near.tolist() if i != centre]
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.binary()), "b": pa.array([b for _, b in pairs], pa.binary())})

    large = _blocked(inside.where(F.col("n") > SMALL).select("band", "key"), block)
    coded = large.join(codes.select("key", F.substring("code", 1, CENTRAL).alias("code")), "key")
    return coded.select("band", "own", "key", "code").groupBy("band", "own").applyInArrow(run, "a binary, b binary")


def _across(left: DataFrame, codes: DataFrame, similarity: float, block: int) -> DataFrame:
    """The pairs (a, b) of ``left(band, key, weight, component)`` in one band but in different components that may be similar.

    A band's classes meet in one task, or in one for each two blocks of a large band; only pairs whose codes agree
    often enough leave it, and only from the first band that they share.
    """

    def run(table: pa.Table) -> pa.Table:
        numbers: dict[bytes, int] = {}
        component = np.array([numbers.setdefault(x, len(numbers)) for x in table["component"].to_pylist()])
        keys, weights, own, found = table["key"].to_pylist(), table["weight"].to_numpy(), table["own"].to_numpy(), _codes(table["code"])
        bands = np.array(table["bands"].to_pylist(), np.int64)
        at = int(np.flatnonzero(bands[0] == table["band"][0].as_py())[0])
        order = np.argsort(weights, kind="stable")
        keys, weights, own, found, bands, component = [keys[i] for i in order], weights[order], own[order], found[order], bands[order][:, :at], component[order]
        crossed = table["i"][0].as_py() != table["j"][0].as_py()
        out: list[tuple[bytes, bytes]] = []
        ends = np.searchsorted(weights * similarity, weights, "right")  # the first that is too heavy
        for i in range(len(keys)):
            near = np.arange(i + 1, ends[i])
            near = near[component[near] != component[i]]
            near = near[own[near] != own[i]] if crossed else near
            for start in range(0, len(near), 1024):
                part = near[start : start + 1024]
                hits = part[(found[part] == found[i]).sum(axis=1) >= _bar(similarity)]
                hits = hits[~(bands[hits] == bands[i]).any(axis=1)]
                out += [(min(keys[i], keys[k]), max(keys[i], keys[k])) for k in hits.tolist()]
        return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})

    placed = _blocked(left, block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "weight", "component")
    return placed.join(codes, "key").groupBy("band", "i", "j").applyInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, cluster_id, cluster_size, kept, key): a row for each document; cluster_id is the smallest doc_id of its group.

    Equal texts are one class. Classes that share a band are first compared with its most central class (in small bands
    with the smallest and the largest key); then, where a band still joins several components, with all classes of the
    others. So most of a group of copies costs a few comparisons each, and every pair that shares a band is either held
    against each other or joined already. A class is linked if the weighted Jaccard similarity of its shingles is at least ``similarity``.

    Texts of fewer words than a shingle are one shingle; texts without words (null, empty) are each a group of their
    own. Rows that repeat are counted each and share their kept flag. A null id takes no part in the smallest; a group
    of null ids alone has a null cluster_id. Of several classes with the group's smallest id (or with null ids alone) that
    with the smallest key is kept. An empty table gives no rows; other columns are unused.
    """
    rows_of = stored(signatures(docs, id_col, text_col, bands, rows, shingle), "signatures")
    classes = rows_of.where("weight > 0").groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.any_value("weight").alias("weight"), F.any_value("bands").alias("bands"))
    member = stored(classes, "classes")
    banded = member.select(F.explode("bands").alias("band"), "key", "weight")
    shared = banded.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n")).where("low < high")
    inside = stored(banded.join(shared, "band"), "bands")  # only bands with several classes
    keys = inside.select("key").distinct()
    texts = stored(_keyed(docs, id_col, text_col).select("key", "text").join(keys, "key", "left_semi").dropDuplicates(["key"]), "texts")
    codes = stored(_coded(texts, shingle), "codes")

    like = F.least("v", "weight") >= F.greatest("v", "weight") * F.lit(similarity)
    ends = inside.where(F.col("n") <= SMALL).select(F.explode(F.array("low", "high")).alias("a"), F.col("key").alias("b"), "weight").where("a != b").distinct()
    ends = ends.join(member.select(F.col("key").alias("a"), F.col("weight").alias("v")), "a").where(like).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tried = stored(ends.unionByName(_to_centre(inside, codes, similarity, BLOCK)).distinct(), "tried")
    links = stored(_verified(tried, codes, texts, similarity, shingle), "links")

    of = stored(components(links), "components")
    placed = inside.select("band", "key", "weight").join(of.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    several = placed.groupBy("band").agg(F.min("component").alias("l"), F.max("component").alias("h")).where("l < h").select("band")
    left = stored(placed.join(several, "band", "left_semi"), "left")
    more = stored(_across(left, codes.join(member.select("key", "bands"), "key"), similarity, BLOCK).join(tried, ["a", "b"], "left_anti"), "more")
    found = stored(_verified(more, None, texts, similarity, shingle), "links")
    joined = components(links.unionByName(found)) if found.take(1) else of

    group = member.select("key", "first", "copies").join(joined.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    best = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "key"))
    tops = group.groupBy("component").agg(best.alias("best"), F.sum("copies").alias("cluster_size"))
    group = group.join(tops, "component").select("key", F.col("best.first").alias("cluster_id"), "cluster_size", (F.col("key") == F.col("best.key")).alias("top"))
    worded = F.col("weight") > 0
    return rows_of.join(group, "key", "left").select(
        "doc_id",
        F.when(worded, F.col("cluster_id")).otherwise(F.col("doc_id")).alias("cluster_id"),
        F.when(worded, F.col("cluster_size")).otherwise(1).alias("cluster_size"),
        F.when(worded, F.col("top") & F.col("doc_id").eqNullSafe(F.col("cluster_id"))).otherwise(True).alias("kept"),
        "key",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id; all columns stay. See ``near_duplicates``."""
    one, other, own = (fresh(docs, name) for name in ("kept_id", "kept_key", "text_key"))
    near = near_duplicates(docs, id_col, text_col).where("kept").groupBy(F.col("doc_id").alias(one), F.col("key").alias(other))
    kept = stored(near.agg(F.count("*").alias("rows")), "kept")
    keyed = docs.withColumn(own, F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))
    several = kept.where("rows > 1").take(1)
    stay = keyed.join(kept.select(one, other), F.col(id_col).cast("long").eqNullSafe(F.col(one)) & (F.col(own) == F.col(other)), "left_semi")
    if several:  # rows that repeat in id and text; else no second shuffle of the texts
        stay = stay.dropDuplicates([id_col, own])
    return stay.drop(own)
