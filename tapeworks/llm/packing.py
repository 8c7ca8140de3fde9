"""Best-fit packing of tokenised documents after a Martello-Toth dominance reduction (operator 9).

Pieces of one length can stand for each other, so the packing is decided on the histogram of lengths: at most
``capacity`` rows, however large the corpus. Its answer is a short list of runs (so many pieces of this length, from
this rank on, go into these sequences at this offset). Each piece finds its run by its rank within its length, which
comes from counts per (length, bucket) and a row number inside the bucket, so no length is ever one task's.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, stored

CAPACITY, EOS = 1024, 2
#: Pieces of one length that one task numbers at most, about; fewer while all pieces are dealt into fewer than SPREAD parts.
BUCKET, SPREAD = 500_000, 512
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def as_bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def load_encoder(path: str) -> tuple[Callable[[str], list[int]], bool, list[str]]:
    """(encode, byte level, special): the function from a text to the ids that the tokenizer file ``path`` gives, without special tokens around them.

    A byte-level BPE whose ids follow its merges (then ``byte level`` is true) is run by tiktoken, which gives the same ids
    several times sooner. A text that holds a string of ``special``, the file's added tokens, goes to the tokenizer itself.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    special = [t["content"] for t in read.get("added_tokens") or []]
    tokenizer = Tokenizer.from_file(path)

    def plainly(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    model = read["model"]
    vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    if not merges or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return plainly, False, special
    import tiktoken
    from public_tokenizers import PATTERN

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # these bytes stand for themselves, the others follow 255
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*printable}))}
    ranks = {bytes(map(byte.__getitem__, token)): i for token, i in vocab.items() if i < 256 + len(merges)}
    ordinary = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: plainly(text) if any(t in text for t in special) else ordinary(text), True, special


@cache
def batch_encoder(path: str, most: int = 500_000) -> Callable[[list[str]], list[bytes]]:
    """From texts to the bytes of their ids; a worker keeps up to ``most`` words, and those of a batch, from task to task.

    Where lines hold words with one blank between them, pre-tokens begin at each blank and line break, so words are
    looked up. The new ones of a batch go to the tokenizer as one text, whose ids are cut before each id that begins
    with a blank. A text with any other white space, or with the string of an added token, goes to the tokenizer whole.
    """
    encode, byte_level, special = load_encoder(path)
    if not byte_level:
        return lambda texts: [as_bytes(encode(t)) for t in texts]
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    begins = np.zeros(max(vocab.values()) + 1, bool)
    begins[[i for token, i in vocab.items() if token[0] == "\u0120"]] = True  # how the file writes a blank
    first, later, line_end = {}, {}, as_bytes(encode("\n"))

    def run(texts: list[str]) -> list[bytes]:
        if len(first) + len(later) > most:
            first.clear()
            later.clear()
        cut: list[list[list[str]] | None] = []
        new: set[str] = set()
        for text in texts:
            lines = [line.split() for line in text.split("\n")]
            plain = all(lines) and "\n".join(map(" ".join, lines)) == text and not any(t in text for t in special)
            cut.append(lines if plain else None)
            if plain:
                for line in lines:
                    new.update(line[1:])
                    if line[0] not in first:
                        first[line[0]] = as_bytes(encode(line[0]))
        if unmet := list(new.difference(later)):
            ids = np.array(encode(" " + " ".join(unmet)), "<u4")
            raw, at = ids.tobytes(), [*(4 * np.flatnonzero(begins[ids])).tolist(), 4 * len(ids)]
            later.update(zip(unmet, map(raw.__getitem__, map(slice, at, at[1:])), strict=True))
        return [
            as_bytes(encode(text)) if lines is None else line_end.join([first[x[0]] + b"".join(map(later.__getitem__, x[1:])) for x in lines])
            for text, lines in zip(texts, cut, strict=True)
        ]

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, eos: int = EOS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of the ids of every whole text and ``eos``; a null text counts as empty.

    Only documents over ``capacity`` are cut: into pieces of ``capacity``, the first of which takes the remainder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = batch_encoder(tokenizer_path)
        end, width = int(eos).to_bytes(4, "little"), 4 * capacity
        for part in by_bytes(batches, 1):
            out: list[list] = [[], [], [], [], []]
            for doc, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                ids += end
                edges = [0, *range((len(ids) - 1) % width + 1, len(ids) + 1, width)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    for column, x in zip(out, (doc, k, a // 4, (b - a) // 4, zlib.crc32(ids[a:b])), strict=True):
                        column.append(x)
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, pieces a sequence, offset) that place ``histogram``.

    Reduction: a set with the longest piece j is fixed while it dominates all others that hold j. That is so for j and
    a k that fills the sequence, and, if no two pieces fit beside j, for j and the largest k that fits, or j alone.
    What remains is packed best fit, longest first; alike sequences are handled as one group.
    """
    left = {n: c for n, c in histogram.items() if c}
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    free = 0

    def place(n: int, count: int, base: int, each: int, offset: int) -> None:
        runs.append((n, rank[n], count, base, each, offset))
        rank[n] += count
        left[n] -= count
        if not left[n]:
            del left[n]

    def fix(j: int, k: int | None, times: int) -> None:
        nonlocal free
        if k == j:
            place(j, 2 * times, free, 2, 0)
        else:
            place(j, times, free, 1, 0)
            if k is not None:
                place(k, times, free, 1, j)
        free += times

    def fits(j: int, k: int) -> int:
        return left[j] // 2 if j == k else min(left[j], left.get(k, 0))

    for j in sorted(left, reverse=True):
        if j in left and 2 * j >= capacity and capacity - j in left and (times := fits(j, capacity - j)):
            fix(j, capacity - j, times)
    moved = True
    while moved:
        moved = False
        for j in sorted(left, reverse=True):
            others = [k for n in sorted(left)[:3] for k in [n] * min(2, left[n] - (n == j))][:2]
            if len(others) == 2 and sum(others) <= capacity - j:
                break  # shorter ones leave still more room
            k = max((n for n in left if n <= capacity - j and (n != j or left[n] > 1)), default=None)
            fix(j, k, left[j] if k is None else fits(j, k))
            moved = True
            break
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first sequence, sequences)
    for n in sorted(left, reverse=True):
        while n in left:
            room = next((r for r in range(n, capacity) if rooms[r]), capacity)
            each, new = room // n, room == capacity
            base, many = (free, max(1, left[n] // each)) if new else rooms[room].pop()
            used = min(many, left[n] // each)
            each, used = (each, used) if used else (left[n], 1)
            place(n, used * each, base, each, capacity - room)
            rooms[room - each * n].append((base, used))
            if new:
                free += used
            elif many > used:
                rooms[room].append((base + used, many - used))
    return runs


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, eos: int = EOS, bucket: int = BUCKET) -> DataFrame:
    """Each piece of every document with its sequence_id and offset; a sequence holds at most ``capacity`` ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is one piece of ``eos``
    alone; repeated rows are packed each; an empty table gives no rows; a null id stays null; other columns are unused.
    Pieces of one length are dealt into buckets of about ``bucket`` rows (fewer in small tables), which one task numbers.
    """
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, tokenizer_path, id_col, text_col, capacity, eos), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    bucket = max(1, min(bucket, sum(histogram.values()) // SPREAD))
    many = spark.createDataFrame([(length, -(-n // bucket)) for length, n in histogram.items()], "length long, buckets long")
    dealt = pieces.join(F.broadcast(many), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "buckets")).drop("buckets")
    counts = stored(dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")  # a row for each bucket
    runs = spark.createDataFrame(plan(histogram, capacity), "length long, first long, pieces long, base long, each long, shift long")
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    # counts are a row for each ``bucket`` pieces: Spark broadcasts them while they are small, else both sides are dealt by bucket already
    ranked = dealt.withColumn("rank", F.row_number().over(order).cast("long") - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    at = F.col("rank") - F.col("first")
    return (
        ranked.join(F.broadcast(runs), (ranked["length"] == runs["length"]) & (ranked["rank"] >= runs["first"]) & (ranked["rank"] < runs["first"] + runs["pieces"]))
        .select("doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("base") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"), (F.col("shift") + at % F.col("each") * ranked["length"]).cast("long").alias("offset"))
    )
