"""Benchmark decontamination by SimHash windows (operator 1).

Windows as long as an item slide over a document from word to word. A window whose shingles are for the most part not
those of any item can't reach the similarity and is skipped; all others get a SimHash, rolled from start to start.
Fingerprints are looked up in a multi-index over the items' own: of ``BLOCKS`` blocks of 16 bits one must differ in
FLIPS bits at most if the fingerprints are within RADIUS, so all blocks with so many flipped bits are looked up. The
items found are compared exactly, by the weighted Jaccard similarity of their shingles with the window's.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE, SIMILARITY, by_bytes, mix, shingle_hashes, word_hashes

#: At a similarity of 0.8 fingerprints differ in 38 bits of 256 on average, with a deviation of 5.7: 63 is 4.4 above. If
#: no block of the 16 differed in FLIPS bits or fewer, 64 or more would differ.
BITS, BLOCKS, FLIPS = 256, 16, 3
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Rows of the multi-index at most: as many flips as fit are stored with the items, the others are tried by the queries.
ENTRIES = 8_000_000
#: Bytes of items that go to every executor at once; beyond it the items are taken in several passes.
PASS_BYTES = 16_000_000
MASKS = [np.array(sorted(sum(1 << i for i in on) for n in range(flips + 1) for on in combinations(range(16), n)), np.uint16) for flips in range(FLIPS + 1)]
#: Window starts, and of a long window, whose projections are held at once.
STEP = 1024


def projections(shingles: np.ndarray) -> np.ndarray:
    """For each shingle its odd number from -255 to 255 in each of ``BITS`` directions."""
    words = mix(shingles[:, None] + np.arange(1, BITS // 8 + 1, dtype=np.uint64))
    return 2 * words.view(np.uint8).astype(np.int32) - 255


def simhashes(shingles: np.ndarray, wanted: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For each width, in shingles, the fingerprints of the windows at its ascending starts: rows of ``BLOCKS`` numbers of 16 bits.

    Sums of projections up to each place, STEP places at a time and as many as the widest window holds beyond them, are
    shared by all widths. Windows over 8 * STEP are summed and rolled on one by one width, so that no more is held for them.
    """
    out = {width: np.zeros((len(starts), BLOCKS), np.uint16) for width, starts in wanted.items()}
    narrow = {width: starts for width, starts in wanted.items() if width <= 8 * STEP}
    at = min((int(s[0]) for s in narrow.values() if len(s)), default=-1)
    while at >= 0:
        parts = {width: slice(*np.searchsorted(starts, (at, at + STEP))) for width, starts in narrow.items()}
        end = max((int(narrow[width][p][-1]) + width for width, p in parts.items() if p.start < p.stop))
        sums = np.zeros((end - at + 1, BITS), np.int32)
        np.cumsum(projections(shingles[at:end]), axis=0, out=sums[1:])
        for width, p in parts.items():
            low = narrow[width][p] - at
            out[width][p] = np.packbits(sums[low + width] > sums[low], axis=1).view(np.uint16)
        at = min((int(starts[parts[width].stop]) for width, starts in narrow.items() if parts[width].stop < len(starts)), default=-1)
    for width, starts in wanted.items():
        for i, start in enumerate(starts.tolist() if width > 8 * STEP else ()):
            move = start - int(starts[i - 1]) if i else width
            total = np.zeros(BITS, np.int64) if move >= width else total
            for low in range(0, min(move, width), STEP):  # what comes in, less what the window before alone held
                high = min(low + STEP, move, width)
                total = total + projections(shingles[start + width - min(move, width) :][low:high]).sum(axis=0)
                if move < width:
                    total = total - projections(shingles[start - move :][low:high]).sum(axis=0)
            out[width][i] = np.packbits(total > 0).view(np.uint16)
    return out


def simhash(shingles: np.ndarray) -> np.ndarray:
    """The fingerprint of a multiset of shingles, as one row."""
    return simhashes(shingles, {len(shingles): np.zeros(1, np.int64)})[len(shingles)]


class MultiIndex:
    """Finds all of ``prints`` within RADIUS of a fingerprint."""

    def __init__(self, prints: np.ndarray, entries: int = ENTRIES):
        self.prints = np.ascontiguousarray(prints)
        self.words = list(np.ascontiguousarray(self.prints.view(np.uint64).T))
        stored = max((f for f in range(FLIPS + 1) if len(prints) * BLOCKS * len(MASKS[f]) <= entries), default=0)
        own, self.tried = MASKS[stored], MASKS[FLIPS - stored]
        rows, starts = [], [np.zeros(1, np.int64)]
        for b in range(BLOCKS):
            values = (self.prints[:, b, None] ^ own).ravel()
            order = np.argsort(values, kind="stable")
            rows.append((order // len(own)).astype(np.int32))
            starts.append(starts[-1][-1] + np.cumsum(np.bincount(values, minlength=1 << 16)))
        self.rows, self.starts = np.concatenate(rows), np.concatenate(starts)
        self.first = (np.arange(BLOCKS, dtype=np.int64) << 16)[:, None]
        self.compared = 0

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all that are within RADIUS, by query, then row."""
        found = [(np.zeros(0, np.int64),) * 2]
        step = max(1, min(500_000 // (BLOCKS * len(self.tried)), 1_000_000 // max(1, len(self.prints))))
        for low in range(0, len(queries) if len(self.prints) else 0, step):
            part = np.ascontiguousarray(queries[low : low + step])
            cell = ((part[:, :, None] ^ self.tried).astype(np.int64) + self.first).reshape(len(part), -1)
            a, n = self.starts[cell], self.starts[cell + 1] - self.starts[cell]
            hit = np.flatnonzero(n)
            a, n = a.ravel()[hit], n.ravel()[hit]
            row = self.rows[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            met = np.zeros(len(part) * len(self.prints), bool)
            met[np.repeat(hit // cell.shape[1] * len(self.prints), n) + row] = True
            query, row = np.divmod(np.flatnonzero(met), len(self.prints))
            self.compared += len(row)
            distance = np.zeros(len(row), np.uint16)
            for mine, asked in zip(self.words, np.ascontiguousarray(part.view(np.uint64).T), strict=True):
                distance += np.bitwise_count(mine[row] ^ asked[query])
            close = distance <= RADIUS
            found.append((query[close] + low, row[close]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Items:
    """Benchmark items: their shingles, and the multi-index of their fingerprints, by the words in a shingle."""

    def __init__(self, items: list[tuple[int | None, str]], shingle: int, similarity: float):
        self.similarity = similarity
        hashed = [(i, word_hashes(text)) for i, text in items]
        hashed = [(i, h) for i, h in hashed if len(h)]
        self.ids, self.words = [i for i, _ in hashed], np.array([len(h) for _, h in hashed], np.int64)
        self.size = np.minimum(self.words, shingle)
        self.shingles = [shingle_hashes(h, shingle) for _, h in hashed]
        self.counts = np.array([len(s) for s in self.shingles], np.int64)
        self.tables, self.index, self.own, self.widths = {}, {}, {}, {}
        for k in map(int, np.unique(self.size)):
            self.own[k] = own = np.flatnonzero(self.size == k)
            self.widths[k] = np.unique(self.counts[own])
            self.tables[k] = self._table(own)
            self.index[k] = MultiIndex(np.concatenate([simhash(self.shingles[i]) for i in own]))

    def _table(self, own: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sorted hashes with an item and how often it holds them, and a bit for each value of their top 20 bits."""
        distinct = [np.unique(self.shingles[i], return_counts=True) for i in own]
        hashes, times = (np.concatenate(x) for x in zip(*distinct, strict=True))
        item = np.repeat(own, [len(h) for h, _ in distinct])
        order = np.argsort(hashes, kind="stable")
        top = np.zeros(1 << 20, bool)
        top[(hashes >> np.uint64(44)).astype(np.int64)] = True
        return hashes[order], item[order], times[order], top

    def windows(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, similarities, starts) of the windows, as long as some item, that are similar enough to an item."""
        for k, (hashes, item, times, top) in self.tables.items():
            if len(words) < k:
                continue
            own = shingle_hashes(words, k)
            at = np.flatnonzero(top[(own >> np.uint64(44)).astype(np.int64)])
            low, high = np.searchsorted(hashes, own[at], "left"), np.searchsorted(hashes, own[at], "right")
            at, low, n = at[high > low], low[high > low], (high - low)[high > low]
            widths = np.unique(np.minimum(self.widths[k], len(own)))
            if len(at) < self.similarity * widths[0]:  # too few for the shortest item
                continue
            held = np.zeros(len(own) + 1, np.int64)
            held[at + 1] = 1
            held = np.cumsum(held)  # shingles before each place that some item holds
            row = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            place = np.repeat(at, n)
            by_item = np.lexsort((place, row, item[row]))
            row, place = row[by_item], place[by_item]
            edge = np.searchsorted(item[row], np.arange(len(self.ids) + 1))
            inside = {w: held[w:] - held[: len(own) - w + 1] for w in widths.tolist()}
            wanted = {w: starts for w, n in inside.items() if len(starts := np.flatnonzero(n >= self.similarity * w - 1e-9))}
            if not wanted:
                continue
            which, near = self.index[k].near(np.concatenate(list(simhashes(own, wanted).values())))
            ends = np.cumsum([len(starts) for starts in wanted.values()])
            for (width, starts), end in zip(wanted.items(), ends.tolist(), strict=True):
                found = slice(*np.searchsorted(which, (end - len(starts), end)))
                asked_of, rows = which[found] - (end - len(starts)), near[found]
                for j in np.unique(rows).tolist():
                    i = int(self.own[k][j])
                    mine = slice(edge[i], edge[i + 1])
                    asked = starts[asked_of[rows == j]]
                    alike = self._similarity(i, width, row[mine], place[mine], times, asked)
                    enough = alike >= self.similarity
                    if enough.any():
                        yield i, alike[enough], asked[enough]

    def _similarity(self, i: int, width: int, row: np.ndarray, place: np.ndarray, times: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of item ``i`` with the windows at ``starts``; its shingles in rows ``row`` of the table stand at ``place``."""
        # a shingle that the item holds c times counts in a window if fewer than c of it stand before it there
        last = np.arange(len(row)) - times[row]
        after = np.where((last >= 0) & (row[last] == row), place[last] + 1, 0)
        # of the windows from the ``low``-th to before the ``high``-th start it is a shared shingle
        low, high = np.searchsorted(starts, np.maximum(after, place - width + 1)), np.searchsorted(starts, place, "right")
        ok = low < high
        shared = np.cumsum(np.bincount(low[ok], minlength=len(starts) + 1) - np.bincount(high[ok], minlength=len(starts) + 1))[:-1]
        return shared / (self.counts[i] + width - shared)

    def match(self, text: str | None) -> dict[int, tuple[float, int]]:
        """Item -> (similarity, first word) of the most similar window, of several the first."""
        best: dict[int, tuple[float, int]] = {}
        for i, alike, starts in self.windows(word_hashes(text)):
            j = int(alike.argmax())
            best[i] = max(best.get(i, (0.0, 0)), (float(alike[j]), -int(starts[j])))
        return {i: (s, -start) for i, (s, start) in sorted(best.items())}


_BUILT: dict[str, Items] = {}


def _built(name: str, items, shingle: int, similarity: float) -> Items:
    """The index of a broadcast list of items: a worker builds it once and keeps the last one."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Items(items.value, shingle, similarity)
    return _BUILT[name]


def _passes(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple]:
    """A name and a broadcast list, of about ``PASS_BYTES`` at most, for each part of the distinct items."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = total // PASS_BYTES + 1
    for i in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == i).collect()
        yield uuid.uuid4().hex, benchmark.sparkSession.sparkContext.broadcast([(r["item"], r["text"]) for r in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): a row for each row of ``docs`` and item that a window of it is like.

    Windows are as long as any item that has as many words in a shingle, or the whole text if that is shorter.
    Items of fewer words than a shingle are one shingle, and matched as such; items and texts that are null or hold no
    words match nothing. Repeated rows match each, repeated items once, ids may be null, other columns are unused.
    """
    out = None
    for name, shared in _passes(benchmark, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], name=name, shared=shared) -> Iterator[pa.RecordBatch]:
            index = _built(name, shared, shingle, similarity)
            for part in by_bytes(batches, 1):
                rows = [(doc, index.ids[i], s, start, int(index.words[i])) for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for i, (s, start) in index.match(text).items()]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        found = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, item_id long, similarity double, first_word long, n_words long")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; rows and columns that stay are unchanged. See ``contaminated``."""
    at = docs.columns.index(text_col)
    for name, shared in _passes(benchmark, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], name=name, shared=shared) -> Iterator[pa.RecordBatch]:
            index = _built(name, shared, shingle, similarity)
            for part in by_bytes(batches, at):
                yield part.filter(pa.array([not index.match(t) for t in part.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
