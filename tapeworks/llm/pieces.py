"""SentencePiece encoding and decoding by a table of distinct chunks (operator 11).

The mark of a blank only begins pieces, so no merge crosses from a letter to a mark: each marked word of a normalised
text is cut into pieces by itself, and so are its parts where no piece of the vocabulary holds both letters beside a cut.
A task segments each distinct one once, keeps its ids in a table, and joins the ids back by the chunks' positions.
Decoding has nothing to search and is the library's own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, fresh

MARK = "▁"
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: A letter that no piece holds beside another. What the library puts before a text then stays apart from the chunk behind it.
GUARD = "\n"
#: Chunks, and letters in them, that a task's table may have before it is begun anew. Chunks over LONG letters are cut further.
MOST, MOST_LETTERS, LONG = 600_000, 8_000_000, 40
#: Words are cut before these signs too, and those that stand before one of them inside a piece, unless the latter are too many.
SIGNS, MOST_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", 64
#: Texts on which words by themselves must give what the library gives for the whole; a model that fails is run on whole texts.
PROBES = ("", " ", "a  b ", "  a", "\n x\t y \r\n", "née 漢字 😀\x00", f"{MARK}a {MARK}", "</s> <0x41> <unk>", "x" * 100, "ＡＢ ﬁ　x", "漢" * 50 + " 漢")


class Segmenter:
    """Ids of texts, equal to those of the SentencePiece model in ``path``."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.whole = sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [p for i, p in enumerate(pieces) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        #: Neighbours inside some piece: between any others no merge is possible.
        self.pairs = {p[i : i + 2] for p in plain for i in range(len(p) - 1)}
        beside = {letter for pair in self.pairs for letter in pair}
        alone = "".join(c for c in GUARD + "\t0123456789" if c not in beside)
        signs = set(SIGNS)
        while len(signs) <= MOST_SIGNS and (more := {p[0] for p in self.pairs if p[1] in signs and p[0] != MARK} - signs):
            signs |= more
        shown = re.escape("".join(sorted(signs)))
        other = f"[^{shown}{MARK}{alone}]"
        parts = rf"[{alone}]|{MARK}+[{shown}]*{other}*|[{shown}]+{other}*|{other}+"
        self.chunk = re.compile(parts) if alone and len(signs) <= MOST_SIGNS else WORD
        self.clear()
        self.by_chunk = any(sp.is_byte(i) for i in range(n)) and not any(sp.is_unused(i) for i in range(n)) and all(MARK not in p.lstrip(MARK) for p in plain)
        self.by_chunk = self.by_chunk and all(GUARD not in p for p in plain)
        self.guard = len(sp.encode(GUARD))
        if self.by_chunk:
            ids, ends = self.encode(list(PROBES), end=False)
            self.by_chunk = [x.tolist() for x in np.split(ids, ends[:-1])] == [sp.encode(t) for t in PROBES]

    def clear(self) -> None:
        self.table: dict[str | None, int] = {}
        self.pool, self.starts, self.letters = np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def _parts(self, chunk: str) -> list[str]:
        """A long chunk, cut wherever no piece holds both neighbours."""
        at = [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in self.pairs]
        return [chunk[a:b] for a, b in zip([0, *at], [*at, len(chunk)], strict=True)]

    def _segment(self, chunks: list[str]) -> None:
        """Put chunks into the table; the end id is there from the beginning, under None."""
        if not self.table:
            self.table[None] = 0
            self.pool, self.starts = np.array([self.whole.eos_id()], np.int32), np.array([0, 1])
        parts = [[c] if len(c) <= LONG else self._parts(c) for c in chunks]
        encoded = iter(self.whole.encode([GUARD + x for part in parts for x in part], num_threads=1))
        ids = [list(chain.from_iterable(next(encoded)[self.guard :] for _ in part)) for part in parts]
        known = len(self.table)
        self.table.update(zip(chunks, range(known, known + len(chunks)), strict=True))
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(ids), np.int32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(list(map(len, ids)), dtype=np.int64)])
        self.letters += sum(map(len, chunks))

    def encode(self, texts: list[str], end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where those of each end), the end id behind each text if ``end``."""
        if not self.by_chunk:
            ids = [self.whole.encode(t) + [self.whole.eos_id()] * end for t in texts]
            return np.fromiter(chain.from_iterable(ids), np.int32), np.cumsum([len(x) for x in ids], dtype=np.int64)
        if len(self.table) > MOST or self.letters > MOST_LETTERS:
            self.clear()
        if not self.table:
            self._segment([])
        chunks: list[str | None] = []
        places = []
        for text in texts:
            chunks += self.chunk.findall(self.whole.normalize(text))
            if end:
                chunks.append(None)
            places.append(len(chunks))
        which = np.fromiter(map(self.table.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(which < 0)
        if len(missing):
            absent = [chunks[i] for i in missing.tolist()]
            self._segment(list(set(absent)))
            which[missing] = [self.table[c] for c in absent]
        first, n = self.starts[which], self.starts[which + 1] - self.starts[which]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)
        return self.pool[at], np.concatenate([[0], ends])[np.array(places, np.int64)]


@cache
def segmenter(path: str) -> Segmenter:
    return Segmenter(path)


def _by_ids(batch: pa.RecordBatch, column: int, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in slices that hold at most ``most`` ids (or are one row)."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy())
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """(doc_id, ids): a row for each of ``docs``, with the ids that the library gives for the whole text, and an end id.

    A null text counts as an empty one, which has the end id alone; rows may repeat, a null id stays null, other columns
    are unused; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = segmenter(model_path)
        for part in by_bytes(batches, 1, 2_000_000):
            ids, ends = found.encode([t or "" for t in part.column(1).to_pylist()], end)
            yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``rows`` and the text that the library gives for their ids; null for null ids, nulls among them are passed over.

    The column takes ``name``, or that with underscores behind it if ``rows`` has it. Ids that the model has not are an
    error.
    """
    name, at = fresh(rows, name), rows.columns.index(ids_col)
    rows = rows.withColumn(ids_col, F.col(ids_col).cast("array<int>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = segmenter(model_path).whole
        for batch in batches:
            for part in _by_ids(batch, at):
                ids = part.column(at).to_pylist()
                texts = sp.decode([[i for i in x or () if i is not None] for x in ids], num_threads=1)
                texts = pa.array([None if x is None else t for x, t in zip(ids, texts, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())]))


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, encoded with an end id and decoded again."""
    both = decode(encode(docs, model_path, id_col, text_col), model_path)
    shown = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(shown, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
