"""Hard-negative mining by a secondary-sort shuffle (operator 12).

Pairs of an anchor and a row are packed into keys (anchor, falling score, kind, id) that order as bytes. They are dealt
by anchor and sorted within partitions, so that one iterator streams over all of them: an anchor's first rows of its own
label open windows of scores, and the rows of other labels behind them fall into the windows until these are full. It
holds a few open windows, never an anchor's rows.

Anchors meet all rows, in blocks, each as one product of whole numbers. Before the shuffle a block combines: it hands on
only the first rows of an anchor's label, and, once the windows are known, only the first rows of each window. What a
block leaves out has enough rows before it in that block alone, so that nothing is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Positives of an anchor, negatives of a positive, and the shares of the positive's score (in hundredths) between which a negative's lies.
POSITIVES, NEGATIVES, LEAST, MOST = 5, 3, 50, 95
#: An anchor's id is divisible by it.
EVERY = 50
#: Bytes of vectors in a block of rows, and in one of anchors, at most (about: they are dealt by hash); row blocks of a small table.
BLOCK_BYTES, SPREAD = 32_000_000, 24
#: Scores that are held at once.
CELLS = 2_000_000
#: ``number`` keeps repeated anchors apart, ``kind`` is 0 for the anchor's own label, ``null`` is 1 for a row without an id.
KEY = np.dtype([("anchor", ">u8"), ("number", ">u8"), ("score", ">u8"), ("kind", "u1"), ("null", "u1"), ("id", ">u8")])
OF_ANCHOR = 16
SIGN, TOP = np.uint64(1 << 63), np.uint64((1 << 63) - 1)
PAIRS = pa.schema([("key", pa.binary())])


def _packed(anchor: np.ndarray, number: np.ndarray, score: np.ndarray, kind: int, null: np.ndarray, ids: np.ndarray) -> pa.Array:
    keys = np.empty(len(score), KEY)
    keys["anchor"], keys["number"], keys["score"] = anchor.astype(np.uint64) ^ SIGN, number, TOP - score.astype(np.uint64)
    keys["kind"], keys["null"], keys["id"] = kind, null, ids.astype(np.uint64) ^ SIGN
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(np.arange(len(keys) + 1, dtype=np.int32) * KEY.itemsize), pa.py_buffer(keys.tobytes())])


def _unpacked(keys: np.ndarray) -> tuple[list[int], ...]:
    """(anchor, number, score, kind, null, id) of keys."""
    signed = lambda x: (x.astype(np.uint64)).astype(np.int64)
    return tuple(x.tolist() for x in (signed(keys["anchor"] ^ SIGN), keys["number"], signed(TOP - keys["score"]), keys["kind"], keys["null"], signed(keys["id"] ^ SIGN)))


def window(positive: int) -> tuple[int, int]:
    """The least and the largest score of a negative of a positive with this score."""
    return -(-LEAST * positive // 100), MOST * positive // 100


def _wholes(vectors: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.floor(256 * flat).reshape(len(vectors), dim)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``b``, exact; beyond the range of a long they are its ends."""
    if a.shape[1] * (np.abs(a).max(initial=0) + 1) * (np.abs(b).max(initial=0) + 1) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in v] for v in a], object).reshape(a.shape) @ np.array([[int(x) for x in v] for v in b], object).reshape(b.shape).T
    return np.clip(exact, -(1 << 63) + 1, (1 << 63) - 1).astype(np.int64)


def _first(order: np.ndarray, mask: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` cells of each row with the largest ``order`` among those of ``mask``."""
    lowest = order.min(initial=0) - 1
    values = np.where(mask, order, lowest)
    if values.shape[1] > k:
        last = np.argsort(values, axis=1)[:, -k:] if values.dtype == object else np.argpartition(values, -k, axis=1)[:, -k:]
    else:
        last = np.broadcast_to(np.arange(values.shape[1]), values.shape)
    at = np.arange(len(values))[:, None].repeat(last.shape[1], 1)
    known = values[at, last] > lowest
    return at[known], last[known]


def _block(anchors: pa.Table, rows: pa.Table, own: bool) -> pa.Table:
    """Keys of the first rows of each anchor in a block: of its label (``own``), or of other labels in the windows of its positives."""
    if not anchors.num_rows or not rows.num_rows:
        return PAIRS.empty_table()
    null = rows["id"].is_null().to_numpy()
    ids = rows["id"].fill_null(0).to_numpy()
    sort = np.lexsort((ids, null))
    null, ids, b = null[sort], ids[sort], _wholes(rows["vector"], rows["dim"][0].as_py())[sort]
    a = _wholes(anchors["vector"], anchors["dim"][0].as_py())
    names, codes = np.unique(np.array(anchors["label"].to_pylist() + rows["label"].to_pylist()), return_inverse=True)
    label, labels = codes[: len(a)], codes[len(a) :][sort]
    anchor, number = anchors["id"].to_numpy(), anchors["number"].to_numpy()
    windows = []
    if not own:
        for found in anchors["found"].to_pylist():
            scored = _unpacked(np.frombuffer(b"".join(found), KEY))[2]
            windows.append(sorted({window(p) for p in scored if p >= 0}))
    n, out = len(b), []
    place = np.arange(n - 1, -1, -1)
    for low in range(0, len(a), max(1, CELLS // n)):
        part = slice(low, low + max(1, CELLS // n))
        found = scores(a[part], b)
        order = found.astype(object) * n + place if np.abs(found.astype(float)).max() > 2.0**62 / n else found * n + place
        alike = label[part, None] == labels
        picked = []
        if own:
            picked.append(_first(order, alike & ((ids != anchor[part, None]) | null), POSITIVES))
        else:
            of = windows[part]
            for k in range(max(map(len, of))):
                ends = np.array([w[k] if k < len(w) else (1, 0) for w in of], np.int64)
                picked.append(_first(order, ~alike & (found >= ends[:, :1]) & (found <= ends[:, 1:]), NEGATIVES))
        if picked:
            at = np.unique(np.concatenate([x * n + y for x, y in picked]))
            x, y = at // n, at % n
            out.append(_packed(anchor[part][x], number[part][x], found[x, y], 0 if own else 1, null[y], ids[y]))
    return pa.Table.from_arrays([pa.chunked_array(out, pa.binary())], schema=PAIRS)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, tuple]]:
    for batch in batches:
        raw = batch.column(0).to_pylist()
        yield from zip(raw, zip(*_unpacked(np.frombuffer(b"".join(raw), KEY)), strict=True), strict=True)


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(number, found): the keys of the first POSITIVES pairs of each anchor in sorted keys of its own label."""
    numbers: list[int] = []
    found: list[list[bytes]] = []
    for raw, (_, number, *_) in _keys(batches):
        if not numbers or numbers[-1] != number:
            if len(numbers) >= 10_000:
                yield pa.record_batch([pa.array(numbers, pa.int64()), pa.array(found, pa.list_(pa.binary()))], names=["number", "found"])
                numbers, found = [], []
            numbers.append(number)
            found.append([])
        if len(found[-1]) < POSITIVES:
            found[-1].append(raw)
    yield pa.record_batch([pa.array(numbers, pa.int64()), pa.array(found, pa.list_(pa.binary()))], names=["number", "found"])


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
MINED = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32()), ("negative_id", pa.int64()), ("positive_score", pa.int64()), ("negative_score", pa.int64())])


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positives open windows, the negatives behind them fall into those that aren't full."""
    rows: list[tuple] = []
    now, seen, opened = None, 0, []
    for _, (anchor, number, score, kind, null, row) in _keys(batches):
        if number != now:
            now, seen, opened = number, 0, []
        row = None if null else row
        if kind == 0:
            if seen < POSITIVES:
                seen += 1
                opened.append([*window(score), row, score, 0])
            continue
        for w in opened:
            if w[4] < NEGATIVES and w[0] <= score <= w[1]:
                w[4] += 1
                rows.append((anchor, w[2], w[4], row, w[3], score))
        if len(rows) >= 10_000:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), MINED, strict=True)], schema=MINED)
            rows = []
    if rows:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), MINED, strict=True)], schema=MINED)


def _streamed(keys: DataFrame, run: Callable, schema: str) -> DataFrame:
    """The secondary sort: ``keys`` dealt by anchor, sorted inside partitions, then passed to ``run`` as one stream each."""
    return keys.repartition(F.substring("key", 1, OF_ANCHOR)).sortWithinPartitions("key").mapInArrow(run, schema)


def mine(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = EVERY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors, whose id is divisible by ``every``.

    Components become floor(256 x); a pair's score is the inner product of these whole numbers. Higher scores come first,
    ties by smaller id, a null id last. An anchor's positives are its first POSITIVES rows of the same label and another id;
    a positive's negatives are the first NEGATIVES rows of other labels whose score lies between LEAST and MOST hundredths
    of its own. Rows with a null label, a null vector, or a component that is null or not finite (also times 256) take no
    part; vectors of different lengths have no score. Repeated rows are rows each, anchors too. Empty tables, and anchors
    without positives or negatives, give no rows; other columns are unused.
    """
    x = F.col("vector")
    finite = F.forall(x, lambda v: F.coalesce((F.abs(256 * v) < float("inf")) & ~F.isnan(v), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))).withColumn("dim", F.size("vector"))
    anchors = stored(rows.where(F.col("id") % every == 0).withColumn("number", F.monotonically_increasing_id()), "anchors")

    size = 8 * F.greatest(F.col("dim"), F.lit(1))
    counts = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("a"))
    counts = counts.where("a > 0").select("dim", F.greatest(F.ceil(F.col("n") * size / block_bytes), F.least(F.lit(SPREAD), F.ceil(F.col("n") / 256))).cast("int").alias("row_blocks"), F.ceil(F.col("a") * size / block_bytes).cast("int").alias("anchor_blocks"))
    counts = stored(counts, "blocks")
    by = ["dim", "anchor_block", "row_block"]
    dealt = rows.withColumn("at", F.xxhash64(F.monotonically_increasing_id())).join(counts, "dim")
    dealt = dealt.select("dim", F.explode(F.sequence(F.lit(0), F.col("anchor_blocks") - 1)).alias("anchor_block"), F.pmod("at", "row_blocks").cast("int").alias("row_block"), "id", "label", "vector")

    def met(anchors: DataFrame, own: bool) -> DataFrame:
        some = anchors.join(counts, "dim").withColumn("anchor_block", F.pmod(F.xxhash64("number"), "anchor_blocks").cast("int"))
        some = some.withColumn("row_block", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1))).drop("row_blocks", "anchor_blocks")
        return some.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(lambda a, r: _block(a, r, own), "key binary")

    found = stored(_streamed(met(anchors, True), _open, "number long, found array<binary>"), "positives")
    negatives = met(anchors.join(found, "number"), False)
    return _streamed(found.select(F.explode("found").alias("key")).unionByName(negatives), _mine, RESULT)
