import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from tapeworks.llm import conversations as C

ROLES = ["system", "user", "assistant", "tool"]
GOOD = re.compile(r"(s?(ua)+)?")


def least(symbols):
    """(cost, audit) by trying every edit; at most two rows are inserted at a place, as more are never needed."""

    @cache
    def rest(i, state, inserted):
        found = []
        if i == len(symbols) and state in (0, 3):
            found.append((0, ""))
        into = 3 if state == 2 else 2
        if inserted < 3:
            cost, audit = rest(i, into, inserted + 1)
            found.append((cost + 5, "I" + audit))
        if i < len(symbols):
            role, fault = symbols[i]
            cost, audit = rest(i + 1, state, 0)
            found.append((cost + 2, "D" + audit))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                cost, audit = rest(i + 1, into, 0)
                found.append((cost + 1 + more, "R" + audit))
                after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, role))
                if after:
                    cost, audit = rest(i + 1, after, 0)
                    found.append((cost + more, "K" + audit))
        return min(found, default=(1 << 40, ""))

    return rest(0, 0, 0)


def code(role, fault):
    return 0 if fault in ("blank", "duplicate") else 1 + 2 * ("sua".index(role) if role in "sua" else 3) + (fault == "truncated")


def test_cheapest_edits_and_ties():
    rng = random.Random(3)
    for _ in range(3000):
        runs = [(rng.choice("suato"), rng.choice(["", "", "truncated", "blank"]), rng.choice([1, 1, 2, 5])) for _ in range(rng.randint(0, 6))]
        rows = [(role, fault) for role, fault, n in runs for _ in range(n)]
        assert C.repair_of(bytes(code(*r) for r in rows)) == least(tuple(rows)), rows


@pytest.mark.parametrize("symbols", [bytes([3]) * 1000, bytes([3, 5]) * 700, bytes([0]) * 999, bytes([1]) + bytes([5]) * 333 + bytes([4]) * 450 + bytes([3, 6, 8])])
def test_long_runs_and_blocks(monkeypatch, symbols):
    whole = C.repair_of(symbols)
    monkeypatch.setattr(C, "BLOCK", 37)
    assert C.repair_of(symbols) == whole
    monkeypatch.setattr(C, "STRETCH", 5000)
    monkeypatch.setattr(C, "BLOCK", 5000)
    assert C.repair_of(symbols) == whole


def test_a_conversation_of_a_million_rows():
    cost, audit = C.repair_of(bytes([3]) * 1_000_000)
    assert (cost, audit.count("R"), len(audit)) == (500_000, 500_000, 1_000_000)


def brute(rows):
    """The query's rows by plain loops."""
    found = {}
    for conv, turn, role, text in rows:
        kept = found.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        kind = zlib.crc32(":".join(shown).encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, kept in found.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        turns = {t for t, _, _ in kept if t is not None}
        counts, seen, symbols = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}, set(), []
        for _, role, text in kept:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            symbols.append((role[:1], fault))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        cost, audit = least(tuple(symbols))
        repaired, before, rest = [], "", iter(kept)
        for letter in audit:
            role = {"u": "assistant"}.get(before, "user")
            if letter == "I":
                repaired.append((role, ""))
            else:
                _, own, text = next(rest)
                if letter == "D":
                    continue
                repaired.append((role if letter == "R" else own, text))
            before = repaired[-1][0][0]
        assert GOOD.fullmatch("".join(r[:1] for r, _ in repaired))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        gaps = min(max(turns) - min(turns) + 1 - len(turns), (1 << 63) - 1) if turns else 0
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest, repaired)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = ["Yes.", "No", "why?\n", "", " \t", None, "fine!", "é漢。", "a b c.", "x" * 200_000, "\x1f", "ends. \r\n"]
    out = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(1, 12)):
            if rng.random() < 0.9:
                out.append((conv, None if rng.random() < 0.05 else turn + 3 * (rng.random() < 0.1), rng.choice([*ROLES, None, "", "User"] if rng.random() < 0.4 else ROLES[1 + turn % 2 : 2 + turn % 2]), rng.choice(texts) if rng.random() < 0.5 else f"text {turn}."))
    return out + out[5:9] + [(777, t, ROLES[1 + t % 2], f"turn {t}.") for t in range(120)] + [(778, 1 << 62, "user", "a."), (778, -(1 << 62) - (1 << 61), "user", "b.")]


SCHEMA = "conv_id long, turn long, role string, text string, digest string, gone boolean, kind int, audit string"


def test_query_equals_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, "d", True, 1, "KK") for r in rows], SCHEMA).repartition(5)
    damaged = C.damage(df)
    audits = C.audit(damaged).cache()
    got = {r["conv_id"]: r for r in C.digests(damaged, audits).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for conv, w in want.items():
        assert tuple(got[conv])[1:] == w[:8], conv
    shown = {}
    for r in sorted(C.repaired(damaged, audits).collect(), key=lambda r: r["place"]):
        shown.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert shown == {conv: w[8] for conv, w in want.items() if w[8]}
    assert C.repair_damaged(df).count() == len(want)


def test_empty_table(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert C.repair_damaged(nothing).count() == 0 and C.repaired(nothing, C.audit(nothing)).count() == 0


def test_one_exchange_for_faults_and_order(spark, rows):
    plan = C.audit(C.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
