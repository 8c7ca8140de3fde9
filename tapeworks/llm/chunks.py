"""Substring dedup by content-defined chunks (operator 2).

A gear hash rolls over the bytes of each text. A chunk ends where the hash is the largest within REACH bytes to either
side, so that cuts depend on nearby bytes alone and come back right after an insertion. Chunks with the same digest are
the same; runs of neighbouring chunks that occur elsewhere are the repeated passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, mix, stored

#: The hash covers 16 bytes; chunks hold REACH + 1 bytes at least and about 2 * REACH on average. A passage of 50 words
#: holds several. Runs of repeated chunks count from LEAST bytes or from WORDS words: cuts near the ends of a passage depend
#: on what stands around it, so that of 50 short words a run may hold a third.
REACH, LEAST, WORDS = 16, 120, 12
#: A stretch whose hashes tie has no cut of its own: one over TIED bytes is cut each STEP bytes from its beginning.
TIED, STEP = 2048, 1024
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
CHUNKS = "doc_id long, chunks array<struct<digest:long,start:int,end:int,bytes:int,words:int,again:boolean>>"


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The hash of the (up to) 16 bytes that end at each place: two bits of shift for each byte, summed by doubling."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        shifted = h[:-k] << np.uint32(2 * k)
        h = h.copy()
        h[k:] += shifted
    return h


def cuts(data: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Where chunks begin, apart from the first: after each place whose hash is larger than all within ``reach`` before it and none within ``reach`` after it is larger."""
    n = len(data)
    if n < 16 + 2 * reach:
        return np.zeros(0, np.int64)
    h = gear_hash(data).astype(np.int64)
    h[:-1][(data[1:] & 0xC0) == 0x80] = -1  # not inside a character
    top = h
    for k in (1, 2, 4, 8):
        top = np.maximum(top[:-k], top[k:])  # of 16 places from each
    at = np.arange(15 + reach, n - reach)
    found = (h[at] > top[at - reach]) & (h[at] >= top[at + 1]) & (h[at] >= 0)
    return at[found] + 1


def _untied(data: np.ndarray, edges: list[int]) -> list[int]:
    """``edges`` with those inside stretches that have none, each before the beginning of a character."""
    if max(b - a for a, b in zip(edges, edges[1:], strict=False)) <= TIED:
        return edges
    out = edges[:1]
    for a, b in zip(edges, edges[1:], strict=False):
        if b - a > TIED:
            for at in range(a + STEP, b - STEP, STEP):
                while (data[at] & 0xC0) == 0x80:
                    at -= 1
                out.append(at)
        out.append(b)
    return out


def split(text: str) -> list[dict]:
    """The chunks of a text: digest, code points from ``start`` to ``end``, bytes, words that begin in it, and whether the text had it before."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    edges = _untied(data, [0, *cuts(data).tolist(), len(raw)])
    places = edges if len(raw) == len(text) else np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[edges].tolist()
    blank = np.concatenate([[True], data <= 32])
    begun = np.concatenate([[0], np.cumsum(blank[:-1] & ~blank[1:])])[edges].tolist()
    out, met = [], set()
    for a, b, x, y, w, v in zip(edges, edges[1:], places, places[1:], begun, begun[1:], strict=False):
        digest = xxhash.xxh3_64_intdigest(raw[a:b]) - (1 << 63)
        out.append((digest, x, y, b - a, v - w, digest in met))
        met.add(digest)
    return out


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunks) of every text; none for a null or empty one."""
    kind = pa.list_(pa.struct([("digest", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("bytes", pa.int32()), ("words", pa.int32()), ("again", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, 1):
            found = [split(t) if t else [] for t in part.column(1).to_pylist()]
            sizes = np.cumsum([0, *map(len, found)])
            columns = list(zip(*(c for chunks in found for c in chunks), strict=True)) or [()] * 6
            flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind.value_type, strict=True)], fields=list(kind.value_type))
            yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)], names=["doc_id", "chunks"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, CHUNKS)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, words: int = WORDS, within: bool = False) -> DataFrame:
    """The repeated passages: (doc_id, start, end, n_chunks, n_bytes, n_first, kept).

    A row for each longest run of neighbouring chunks of a text that all occur in other rows too, from ``least`` bytes or ``words`` words.
    With ``within``, chunks that occur again in the same text alone count as well.
    ``start`` and ``end`` are code points, end exclusive. ``n_first`` of the chunks are here for the first time (in the
    document of the smallest id, and there before any other place); ``kept`` says that all are, so that the passage stays.
    Rows with one id count as one document as to what is first; a null id comes last. Null and empty texts and those
    that share nothing have no row; an empty table gives none; other columns are unused.
    """
    rows = stored(chunked(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "chunks")
    order = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    each = rows.select("row", order.alias("order"), F.posexplode("chunks").alias("k", "c")).select("row", "order", "k", F.col("c.digest").alias("digest"), F.col("c.again").alias("again"))
    shared = (each if within else each.where("not again")).groupBy("digest").agg(F.count("*").alias("n"), F.min("order").alias("first")).where("n > 1").select("digest", "first")
    packed = each.select("digest", "row", (F.col("k") * 2 + F.col("again").cast("int")).alias("p"))  # all chunks go through one exchange
    held = packed.join(shared, "digest").select("row", F.expr("p div 2").cast("int").alias("k"), F.when(F.col("p") % 2 == 0, F.col("first")).alias("first"))
    marks = held.withColumn("run", F.col("k") - F.row_number().over(Window.partitionBy("row").orderBy("k"))).join(rows.select("row", order.alias("order")), "row")
    runs = marks.groupBy("row", "run").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count_if(F.col("first") == F.col("order")).alias("n_first"))
    placed = runs.join(rows, "row").withColumn("n_chunks", (F.col("high") - F.col("low") + 1).cast("long"))
    total = lambda field: F.aggregate(F.expr("slice(chunks, low + 1, high - low + 1)"), F.lit(0).cast("long"), lambda s, c: s + c[field])
    return placed.withColumns({"n_bytes": total("bytes"), "n_words": total("words")}).where((F.col("n_bytes") >= least) | (F.col("n_words") >= words)).select(
        "doc_id", F.expr("chunks[low].start").cast("long").alias("start"), F.expr("chunks[high].end").cast("long").alias("end"), "n_chunks", "n_bytes", "n_first", (F.col("n_first") == F.col("n_chunks")).alias("kept")
    )
