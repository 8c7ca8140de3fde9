"""Near-duplicate embeddings by HNSW graphs, one per shard (operator 6).

Equal vectors of a label are one class. Classes of a label are dealt into shards of bounded size, each of which gets a
graph whose beam is widened until an audit against brute force passes. Classes are also dealt into query blocks; every
block is searched in every shard of its label, and what is found counts if the cosine, in double precision, is high
enough. A beam that a large group would widen to a good part of the graph becomes the whole of it, compared as one
product. A search returns counts and a spanning forest of its links, not pairs, so that a large group stays small.
Classes are named so that the smallest of a component holds its smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, mix, stored
from .hnsw import Graph

COSINE = 0.98
#: Classes in a shard at most, and in a query block at least (about: they are dealt by hash); audited queries of a shard, and the recall they need.
SHARD, BLOCK, AUDITED, RECALL = 20_000, 2_000, 64, 0.99
#: Query blocks grow with the label, so that graphs are sent BLOCKS times at most, but not over BLOCK_BYTES.
BLOCKS, BLOCK_BYTES = 64, 64_000_000
#: Queries that are compared with all of a shard at once.
DENSE = 256
GROUP = ["label", "size"]
#: A class: whether its smallest id is null, that id so that bytes order as it does, and a digest of label and vector.
NODE = 25


def _units(vectors: list[list[float]]) -> np.ndarray:
    x = np.array(vectors, float)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


GRAPH = pa.schema([("label", pa.string()), ("size", pa.int32()), ("shard", pa.int32()), ("graph", pa.binary()), ("nodes", pa.binary()), ("copies", pa.binary())])
FOUND = pa.schema([("node", pa.binary()), ("other", pa.binary()), ("n", pa.int64())])


def _build(table: pa.Table, cosine: float) -> pa.Table:
    """A shard's audited graph, with the classes (NODE bytes each) and their copies in the order of the graph's nodes."""
    table = table.sort_by("node")
    nodes = table["node"].to_pylist()
    chances = ((mix(np.array([int.from_bytes(k[-8:], "little") for k in nodes], np.uint64)) >> np.uint64(11)) + np.uint64(1)) * 2.0**-53
    graph = Graph(_units(table["vector"].to_pylist()), chances)
    graph.audit(cosine, RECALL, AUDITED)
    one = {c: [table[c][0].as_py()] for c in ("label", "size", "shard")}
    return pa.table(one | {"graph": [graph.dump()], "nodes": [b"".join(nodes)], "copies": [np.array(table["copies"].to_pylist(), np.int64).tobytes()]}, schema=GRAPH)


def _hits(graph: Graph, vectors: np.ndarray, cosine: float) -> Iterator[tuple[int, np.ndarray]]:
    """(query, graph nodes linked with it), those whose beams would take a good part of the graph last and many at once."""
    wide = []
    for q, x in enumerate(vectors):
        found = graph.search(x, cosine)
        if found is None:
            wide.append(q)
        else:
            yield q, found
    for low in range(0, len(wide), DENSE):
        part = wide[low : low + DENSE]
        alike = graph.vectors @ vectors[part].T >= cosine
        for k, q in enumerate(part):
            yield q, np.flatnonzero(alike[:, k])


def _search(queries: pa.Table, shards: pa.Table, cosine: float) -> pa.Table:
    """For each query (node, null, vectors of other classes linked in this shard), and (node, other, 0) for a forest that joins what is linked."""
    if not queries.num_rows or not shards.num_rows:
        return FOUND.empty_table()
    graph, raw = Graph.load(shards["graph"][0].as_py()), shards["nodes"][0].as_py()
    copies = np.frombuffer(shards["copies"][0].as_py(), np.int64)
    nodes, number = queries["node"].to_pylist(), {raw[NODE * i : NODE * (i + 1)]: i for i in range(len(copies))}
    tree = np.arange(len(copies))  # graph nodes that the queries so far join have one number
    rows: list[tuple] = []
    for q, linked in _hits(graph, _units(queries["vector"].to_pylist()), cosine):
        own = number.get(nodes[q], -1)
        rows.append((nodes[q], None, int(copies[linked].sum()) - (int(copies[own]) if own in linked else 0)))
        trees = np.unique(tree[linked if own < 0 else np.append(linked, own)])
        rows += [(nodes[q], raw[NODE * i : NODE * (i + 1)], 0) for i in trees.tolist() if own < 0 or i != tree[own]]
        if len(trees) > 1:
            tree[np.isin(tree, trees)] = trees[0]
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FOUND, strict=True)], schema=FOUND)


def _ordered(first: Column) -> Column:
    """An id, or null behind all of them, as 9 bytes that order as it does."""
    shown = F.lpad(F.hex(first.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.unhex(F.coalesce(F.concat(F.lit("00"), shown), F.lit("01" + "0" * 16)))


def _first(node: Column) -> Column:
    shown = F.hex(F.substring(node, 1, 9))
    return F.when(F.left(shown, F.lit(2)) == "00", F.conv(F.right(shown, F.lit(16)), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63))))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for each row of ``vectors``.

    Vectors are linked if their labels are equal and not null, their lengths are equal and their cosine is at least
    ``cosine``. ``n_links`` counts the other vectors that a vector is linked with, ``component_id`` is the smallest id
    that links reach, ``kept`` says that it is the vector's own. Vectors that are null, empty, zero or hold null or
    non-finite components are linked with nothing. Repeated rows are vectors each; null ids are not the smallest,
    and kept where a component has no other. An empty table gives no rows; other columns are unused.
    """
    x = F.col("vector")
    finite = F.forall(x, lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False)))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).cast("string").alias("label"))
    label, places = F.col("label"), F.col("vector").cast("array<string>")
    rows = rows.withColumn("key", F.when(usable, F.unhex(F.md5(F.concat_ws(",", F.length(label), label, places)))))
    classes = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.any_value("label").alias("label"), F.any_value("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    classes = classes.withColumn("size", F.size("vector")).withColumn("node", F.concat(_ordered(F.col("first")), "key"))
    classes = stored(classes.drop("first"), "classes")
    n = F.count("*")
    rows_of_block = F.greatest(F.lit(block), F.least(n / BLOCKS, F.lit(BLOCK_BYTES / 8) / F.col("size")))
    counts = classes.groupBy(*GROUP).agg(F.ceil(n / shard).cast("int").alias("shards"), F.ceil(n / rows_of_block).cast("int").alias("blocks"))
    dealt = classes.join(counts, GROUP).withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int")).withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int"))
    graphs = dealt.select(*GROUP, "shard", "node", "vector", "copies").groupBy(*GROUP, "shard").applyInArrow(lambda t: _build(t, cosine), "label string, size int, shard int, graph binary, nodes binary, copies binary")
    graphs = stored(graphs, "graphs").join(counts, GROUP).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("shards", "blocks")
    queries = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select(*GROUP, "shard", "block", "node", "vector")
    by = [*GROUP, "shard", "block"]
    found = stored(queries.groupBy(*by).cogroup(graphs.groupBy(*by)).applyInArrow(lambda q, g: _search(q, g, cosine), "node binary, other binary, n long"), "found")

    linked = found.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    of = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = classes.join(of, "node", "left").join(linked, "node", "left")
    known = known.select("key", _first(F.coalesce("component", "node")).alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    placed = rows.select("vec_id", "key").join(known, "key", "left").withColumn("component_id", F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")))
    return placed.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
