"""Secret scans by a trigram inverted index (operator 7).

From each rule's expression a Boolean trigram query is derived. Each slice of a partition is an index segment: the
postings (ascending row numbers) of every trigram that some query reads are built in one pass over its bytes, the
queries are answered by intersecting and uniting postings, and the expression runs on the rows that remain. A rule
whose expression forces no trigram scans all rows. Segments need no shuffle and are rebuilt wherever a task is retried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import regex_trigrams
from .common import by_bytes


@dataclass(frozen=True)
class Rule:
    """``least``: characters that the match, or ``group`` of it, must have; shorter matches are dropped."""

    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0


# The three kinds that the contract names, in its order, and forms of tokens that their issuers publish.
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the same as all runs of 24 or more
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.expressions = [re.compile(r.pattern, r.flags) for r in rules]
        self.queries = [regex_trigrams.query(r.pattern, r.flags) for r in rules]
        self.read = sorted({t for q in self.queries for any_of in q for all_of in any_of for t in all_of})
        self.lower = np.arange(256, dtype=np.uint32)
        self.lower[65:91] += 32
        self.number = np.zeros(1 << 24, np.uint8 if len(self.read) < 256 else np.uint16)  # of the trigram; 0: not read
        for i, t in enumerate(self.read):
            a, b, c = t.encode("ascii")
            self.number[a << 16 | b << 8 | c] = i + 1

    def postings(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Trigram -> the rows that hold it, ascending."""
        raw = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts.cast(pa.binary())), b"\n\n")[0].as_buffer() if len(texts) else b""
        data = self.lower[np.frombuffer(raw, np.uint8)]
        if len(data) < 3:
            return {}
        number = self.number[data[:-2] << 16 | data[1:-1] << 8 | data[2:]]
        at = np.flatnonzero(number)
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False) + 2)  # no trigram holds two line breaks
        pairs = np.unique(number[at].astype(np.int64) * len(texts) + np.searchsorted(ends, at, "right"))
        number, row = np.divmod(pairs, len(texts))
        edges = np.searchsorted(number, np.arange(1, len(self.read) + 2))
        return {t: row[edges[i] : edges[i + 1]] for i, t in enumerate(self.read)}

    def candidates(self, query: regex_trigrams.Query, postings: dict[str, np.ndarray], rows: int) -> np.ndarray:
        every = np.arange(rows)
        none = np.zeros(0, np.int64)
        meet = lambda found: reduce(lambda x, y: np.intersect1d(x, y, assume_unique=True), sorted(found, key=len), every)
        return meet([reduce(np.union1d, (meet([postings.get(t, none) for t in all_of]) for all_of in any_of), none) for any_of in query])

    def scan(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """For each text, which holds no null, its sorted (start, rule, end)."""
        postings, plain = self.postings(texts), texts.to_pylist()
        found: list[list[tuple[int, int, int]]] = [[] for _ in plain]
        for i, (rule, expression, query) in enumerate(zip(self.rules, self.expressions, self.queries, strict=True)):
            rows = self.candidates(query, postings, len(plain)).tolist() if query else range(len(plain))
            for row in rows:
                for m in expression.finditer(plain[row]):
                    a, b = m.span(rule.group)
                    if b - a >= rule.least:
                        found[row].append((m.start(), i, m.end()))
        for spans in found:
            spans.sort()
        return found


def _texts(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.string()), "")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, found array<struct<kind, start, end>>): a row for each of ``docs``, spans by start, then rule.

    Positions are code points, ``end`` exclusive. A null or empty text has no spans, rows may repeat, a null id stays
    null, other columns are unused.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for part in by_bytes(batches, 1):
            found = [[{"kind": rules[i].kind, "start": a, "end": b} for a, i, b in spans] for spans in scanner.scan(_texts(part.column(1)))]
            yield pa.record_batch([part.column(0), pa.array(found, kind)], names=["doc_id", "found"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, found array<struct<kind:string,start:long,end:long>>")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``scan`` as (doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    from .spans import joined

    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return scan(docs, id_col, text_col).select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each secret in the text replaced by ``[SECRET]``, and the length column (if there is one) set anew.

    Spans that touch or overlap become one. Texts without secrets, nulls and all other columns stay as they are.
    """
    names, schema = docs.columns, docs.schema
    at = names.index(text_col)

    def clean(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, done = [], 0
        for a, _, b in spans:
            if a >= done:
                out += [text[done:a], "[SECRET]"] if a > done or not done else []
            done = max(done, b)
        return "".join(out) + text[done:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for part in by_bytes(batches, at):
            column = part.column(at)
            found = scanner.scan(_texts(column))
            if any(found):
                texts = [clean(t, s) if s else t for t, s in zip(column.to_pylist(), found, strict=True)]
                part = part.set_column(at, part.schema.field(at), pa.array(texts, column.type))
            yield part

    out = docs.mapInArrow(run, schema)
    if length_col in names:
        out = out.withColumn(length_col, F.coalesce(F.length(text_col).cast(schema[length_col].dataType), F.col(length_col)))
    return out
