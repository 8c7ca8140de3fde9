"""Conversation structure repair by a run-length dynamic program (operator 13).

A conversation's rows become symbols: the role's initial and the row's fault. Runs of equal symbols advance at once, by
binary powers of the symbol's transition in the min-plus algebra over the four states of a well-formed conversation;
powers are cached. Costs to the end are kept between runs, and the choices inside a run are unrolled from halves.

Rows meet their conversation twice, each time dealt by it and sorted within partitions, as a stream. The first time they
are slim (no texts) and give the audit. The second time the audit comes first, as a header, and the rows behind it are
edited as they pass. So a task holds one letter for each row of a conversation, and one batch of texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: White space: blank, tab to carriage return.
SPACE = " \t\n\x0b\f\r"
ROLES = {"u": "user", "a": "assistant"}
#: States: nothing yet, behind a system row, behind a user row, behind an assistant row. A conversation may end in the first and the last.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEVER = 1 << 60
Vector = tuple[int, int, int, int]
#: Rows that are unrolled one by one, and rows whose costs are held at once.
STRETCH, BLOCK = 32, 1 << 16


def turn_to(state: int) -> str:
    """The initial that a row is given in a state when its role is chosen."""
    return "a" if state == 2 else "u"


def _inserted(v: Vector) -> Vector:
    """Costs to the end if rows may be inserted first."""
    out = list(v)
    for _ in range(3):
        out = [min(out[q], INSERT + out[NEXT[q][turn_to(q)]]) for q in range(4)]
    return tuple(out)


END = _inserted((0, NEVER, NEVER, 0))


def choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done with a row. A symbol is 0 for a row that must go, else 1 + 2 * (place of the initial in "sua", 3 for others), one more if truncated."""
    out = [("D", DELETE, state)]
    if symbol:
        kind, cut = divmod(symbol - 1, 2)
        after = NEXT[state].get("sua"[kind]) if kind < 3 else None
        if after is not None:
            out.append(("K", TRUNCATED * cut, after))
        out.append(("R", REROLE + TRUNCATED * cut, NEXT[state][turn_to(state)]))
    return out


@cache
def power(symbol: int, k: int) -> tuple[Vector, ...]:
    """The min-plus transition of 2**k rows of a symbol: the cost from each state to each."""
    if k:
        half = power(symbol, k - 1)
        return tuple(tuple(min(half[p][r] + half[r][q] for r in range(4)) for q in range(4)) for p in range(4))
    columns = []
    for q in range(4):
        reached = [min([c for _, c, after in choices(symbol, p) if after == q], default=NEVER) for p in range(4)]
        columns.append(_inserted(tuple(reached)))
    return tuple(tuple(columns[q][p] for q in range(4)) for p in range(4))


def back(symbol: int, n: int, v: Vector) -> Vector:
    """Costs to the end before ``n`` rows of a symbol, from those behind them."""
    k = 0
    while n:
        if n & 1:
            m = power(symbol, k)
            v = tuple(min(row[0] + v[0], row[1] + v[1], row[2] + v[2], row[3] + v[3]) for row in m)
        n >>= 1
        k += 1
    return v


def _unroll(symbol: int, n: int, v: Vector, state: int, letters: bytearray) -> int:
    """Append the letters of ``n`` rows, ``v`` the costs behind them; the state they lead to."""
    while n > STRETCH:
        half = 1 << ((n - 1).bit_length() - 1)
        state = _unroll(symbol, n - half, back(symbol, half, v), state, letters)
        n = half
        if n > STRETCH:
            state = _unroll(symbol, n // 2, back(symbol, n // 2, v), state, letters)
            n //= 2
    costs = [v]
    for _ in range(n):
        costs.append(back(symbol, 1, costs[-1]))
    for j in range(n, 0, -1):
        while True:
            here, behind = costs[j][state], costs[j - 1]
            best = {letter: after for letter, cost, after in choices(symbol, state) if cost + behind[after] == here}
            into = NEXT[state][turn_to(state)]
            if "D" not in best and INSERT + costs[j][into] == here:
                letters += b"I"
                state = into
                continue
            letter = min(best)
            letters += letter.encode()
            state = best[letter]
            break
    return state


def runs_of(symbols: bytes | bytearray) -> Iterator[tuple[int, int]]:
    """(symbol, length) of the runs of equal symbols."""
    at = 0
    while at < len(symbols):
        rest = symbols[at : at + 64].lstrip(symbols[at : at + 1])
        end = at + min(64, len(symbols) - at) - len(rest)
        while not rest and end < len(symbols) and symbols[end] == symbols[at]:
            end += 1
        yield symbols[at], end - at
        at = end


def repair_of(symbols: bytes | bytearray) -> tuple[int, str]:
    """(cost, audit): the least cost and, of the edits that have it, the letters that are least as ASCII."""
    blocks = range(0, len(symbols), BLOCK)

    def runs_at(k: int) -> list[tuple[int, int]]:
        return list(runs_of(symbols[blocks[k] : blocks[k] + BLOCK]))

    def costs_of(runs: list[tuple[int, int]], v: Vector) -> list[Vector]:
        out = [v]
        for symbol, n in reversed(runs):
            out.append(back(symbol, n, out[-1]))
        return out

    ends = [END]
    for k in range(len(blocks) - 1, 0, -1):
        ends.append(costs_of(runs_at(k), ends[-1])[-1])
    state, letters, cost = 0, bytearray(), END[0]
    for k in range(len(blocks)):
        runs = runs_at(k)
        costs = costs_of(runs, ends[len(blocks) - 1 - k])
        cost = cost if k else costs[-1][0]
        for (symbol, n), v in zip(runs, reversed(costs[:-1]), strict=True):
            state = _unroll(symbol, n, v, state, letters)
    while END[state]:
        letters += b"I"
        state = NEXT[state][turn_to(state)]
    return cost, letters.decode()


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, gone): rows as they come in practice, by crc32 of ``conv_id:turn`` modulo 20.

    0 loses the row (``gone``: it only names its conversation), 1 empties its text, 2 takes its ``.``, ``!`` and ``?``
    away, 3 repeats it, 4 makes it the user's. Null roles and texts are one blank, and so are nulls in the hash.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", shown(conv_col), shown(turn_col)).cast("binary")) % 20
    found = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), shown(role_col).alias("role"), shown(text_col).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    found = found.withColumn("copies", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))))
    return found.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"))


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with a digest of role and text, by which those of one turn are ordered."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), gone.alias("gone"))
    return rows.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))


AUDIT = [T.StructField(n, T.LongType(), False) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [T.StructField("audit", T.StringType(), False)]


class _Conversation:
    """What the first pass gathers of one conversation."""

    def __init__(self) -> None:
        self.symbols = bytearray()
        self.faults = [0, 0, 0]
        self.illegal = self.turns = 0
        self.low = self.high = self.before = None

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        if fault:
            self.faults[fault - 1] += 1
        self.symbols.append(0 if fault in (1, 2) else 1 + 2 * ("sua".index(initial) if initial and initial in "sua" else 3) + (fault == 3))
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)
        return (gaps, *self.faults, self.illegal, *repair_of(self.symbols))


def audit(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit): a row for each conversation of ``rows(conv_id, turn, role, text)``.

    Rows follow their turn, nulls first, those of one turn a digest of role and text. A row's first fault counts: blank
    (white space alone), a duplicate (role and text occurred before in its conversation), truncated (no ``.``, ``!`` or
    ``?`` at its end). ``gaps`` counts the turns that are missing between the first and the last; ``illegal`` neighbours
    that no order of roles allows. The audit has a letter for each edit of the cheapest repair: Keep, Rerole, Delete, Insert.
    Counts beyond a long are its largest. Null roles and texts are one blank; a null ``conv_id`` is a conversation; rows that are ``gone`` (if there is such a
    column) only name theirs. An empty table gives no rows; other columns are unused.
    """
    marked = _marked(rows)
    kept = F.rtrim(F.col("text"), F.lit(SPACE))
    shape = F.when(kept == "", 1).when(F.right(kept, F.lit(1)).isin(".", "!", "?"), 0).otherwise(3)
    slim = marked.select("conv_id", "turn", "digest", "gone", F.left("role", F.lit(1)).alias("initial"), shape.alias("shape")).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "digest").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(F.col("shape") == 1, 1).when(again, 2).otherwise(F.col("shape"))
    slim = slim.select("conv_id", "turn", "gone", "digest", "initial", fault.alias("fault")).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "digest")
    schema = T.StructType([rows.schema["conv_id"], *AUDIT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [to_arrow_type(f.dataType) for f in schema]
        done: list[tuple] = []
        now, found = None, None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * len(kinds)
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=schema.names)

        for part in batches:
            for conv, turn, gone, initial, fault in zip(*(part.column(c).to_pylist() for c in ("conv_id", "turn", "gone", "initial", "fault")), strict=True):
                if found is None or conv != now:
                    if found is not None:
                        done.append((now, *found.row()))
                    if len(done) >= 1_000:
                        yield batch()
                        done = []
                    now, found = conv, _Conversation()
                if not gone:
                    found.add(turn, initial, fault)
        if found is not None:
            done.append((now, *found.row()))
        yield batch()

    return slim.mapInArrow(run, schema)


def _edited(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[tuple[object, dict | None, str, str]]:
    """(conv_id, head, role, text) of sorted heads and rows: a head as it is, then the repaired rows, whose head is null."""
    conv, letters, at, state = None, "", 0, 0

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while letters[at : at + 1] == "I":
            initial = turn_to(state)
            yield conv, None, ROLES[initial], ""
            at, state = at + 1, NEXT[state][initial]

    for part in batches:
        for low in range(0, part.num_rows, size):
            few = part.slice(low, size)
            for name, head, role, text in zip(*(few.column(c).to_pylist() for c in ("conv_id", "head", "role", "text")), strict=True):
                yield from inserted()
                if head is not None:
                    conv, letters, at, state = name, head["audit"], 0, 0
                    yield conv, head, "", ""
                    continue
                letter, at = letters[at], at + 1
                if letter != "D":
                    initial = turn_to(state) if letter == "R" else role[0]
                    state = NEXT[state][initial]
                    yield conv, None, ROLES[initial] if letter == "R" else role, text
    yield from inserted()


def _with_heads(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, head, role, text): the row of ``audits`` as the head of each conversation, its rows behind it."""
    null = F.lit(None)
    fields = [c for c in audits.columns if c != "conv_id"]
    heads = audits.select("conv_id", F.lit(0).alias("part"), null.cast("long").alias("turn"), null.cast("binary").alias("digest"), F.struct(*fields).alias("head"), null.cast("string").alias("role"), null.cast("string").alias("text"))
    texts = _marked(rows).where("not gone").select("conv_id", F.lit(1).alias("part"), "turn", "digest", null.cast(heads.schema["head"].dataType).alias("head"), "role", "text")
    both = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "part", F.asc_nulls_first("turn"), "digest")
    return both.select("conv_id", "head", "role", "text")


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the rows of ``rows`` after the edits of ``audits``, counted from 0 in each conversation."""
    schema = T.StructType([rows.schema["conv_id"], T.StructField("place", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, out, place, held = to_arrow_type(schema[0].dataType), [], 0, 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 4
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.string(), pa.string()), strict=True)], names=schema.names)

        for conv, head, role, text in _edited(batches):
            if head is not None:
                place = 0
                continue
            out.append((conv, place, role, text))
            place, held = place + 1, held + len(text)
            if len(out) >= 1_000 or held > 4_000_000:
                yield batch()
                out, held = [], 0
        yield batch()

    return _with_heads(rows, audits).mapInArrow(run, schema)


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``audits`` and ``repaired_sha256``: of the repaired rows as ``role:text``, joined by newlines; of nothing where there are none."""
    schema = T.StructType([*audits.schema.fields, T.StructField("repaired_sha256", T.StringType())])
    names = [c for c in audits.columns if c != "conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        kinds = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
        row: dict = {}
        sha, first = hashlib.sha256(), True

        for conv, head, role, text in _edited(batches):
            if head is None:
                sha.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                first = False
                continue
            if row:
                out.append(row | {"repaired_sha256": sha.hexdigest()})
            if len(out) >= 1_000:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out = []
            row, sha, first = {"conv_id": conv} | {c: head[c] for c in names}, hashlib.sha256(), True
        if row:
            out.append(row | {"repaired_sha256": sha.hexdigest()})
        yield pa.RecordBatch.from_pylist(out, kinds)

    return _with_heads(rows, audits).mapInArrow(run, schema)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Damage, audit and repair of all ``conversations``: the audit's columns and ``repaired_sha256`` for each."""
    rows = damage(conversations)
    return digests(rows, audit(rows))
