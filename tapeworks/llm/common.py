"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores; none for a null text."""
    return WORD.findall(text.lower()) if text else []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Where that is unset a local session, as in tests, takes a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_MADE: list[list[str]] = []


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables that are no longer read."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside are deleted at its end, apart from those that are kept. What is read later must be kept."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield
    finally:
        _MADE.remove(made)
        remove(spark, *made)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, with no lineage to replay if an executor goes."""
    path = shared_path(df.sparkSession, name)
    if _MADE and not keep:
        _MADE[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as (node, component): the smallest node that can be reached.

    Alternating large-star and small-star rounds. A node's least neighbour is a partial aggregate and its other
    neighbours stay rows, never a list, so that a task streams them; all rows of a hub are read by one task of the join,
    unless adaptive execution splits its partition. Each round is a written table, deleted when the next but one is.
    Rows with a null end and loops are left out.
    """
    edges = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges"
    )

    def star(both: DataFrame, keep: str) -> DataFrame:
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        moved = both.join(least, "u").where(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))
        hub = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(hub).where("a > b").distinct()

    def mark(e: DataFrame) -> tuple:
        row = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        return tuple(row)

    seen = mark(edges)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        large = star(down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))), "v > u")
        small = stored(star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), "true"), "edges")
        now = mark(small)
        edges, same, seen = small, now == seen, now
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    tops = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices whose strings in ``column`` hold at most ``most`` bytes (or that are one row)."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, for arrays of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash; forgotten when there are many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


WORD_HASHES = WordHashes()
#: Words in a shingle, and from which weighted Jaccard similarity on texts are near duplicates.
SHINGLE, SIMILARITY = 5, 0.8


def word_hashes(text: str | None) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(WORD_HASHES.__getitem__, found), np.uint64, len(found))


def shingle_hashes(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of each run of ``size`` words; of all words if there are fewer, of none if there are none."""
    size = min(size, len(hashes))
    if not size:
        return np.zeros(0, np.uint64)
    n = len(hashes) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return mix(out)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of the multisets of two arrays: shared over all, counted with their multiplicities; 0 if both are empty."""
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = int(np.minimum(n[i], m[j]).sum())
    return shared / max(1, len(a) + len(b) - shared)
