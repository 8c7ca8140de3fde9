import math
import random

import numpy as np
import pytest

from tapeworks.llm import negatives as N

SCHEMA = "vec_id long, embedding array<double>, label string, number long, dim int, key binary"


def brute(rows, every=50):
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(256 * x) for x in v)

    rows = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if lab is not None and usable(v)]
    out = []
    for i, v, lab in rows:
        if i is None or i % every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), j, other) for j, w, other in rows if len(w) == len(v) and j != i]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for p, j, _ in [s for s in scored if s[2] == lab][:5]:
            good = [s for s in scored if s[2] != lab and 50 * p <= 100 * s[0] <= 95 * p][:3]
            out += [(i, j, k, m, p, n) for k, (n, m, _) in enumerate(good, 1)]
    return sorted(out, key=str)


def mined(df, **options):
    return sorted((tuple(r) for r in N.mine(df, **options).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    nan, inf = float("nan"), float("inf")
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    out = [(i, [round(x + rng.gauss(0, 0.4), 1) for x in rng.choice(base)], rng.choice("abc")) for i in range(260)]
    out += [(300, None, "a"), (350, [1.0, None, 2.0, 0.0, 0.0, 0.0], "a"), (400, [nan] * 6, "b"), (450, [inf] + [0.0] * 5, "b"), (500, base[0], None), (None, base[1], "a"), (None, base[1], "b")]
    out += [(550, [0.0] * 6, "a"), (600, [], "a"), (601, [], "a"), (602, [], "b"), (650, [1.0, 2.0], "a"), (651, [1.0, 1.0], "a"), (652, [1.0, 0.5], "b"), (-50, base[2], "c")]
    return out + out[50:54] + [out[100]] * 3


def test_equals_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, b"k") for r in rows], SCHEMA).repartition(3)
    want = brute(rows)
    assert len(want) > 60
    assert mined(df) == want
    assert mined(df, block_bytes=1_000) == want  # many blocks of anchors and of rows


def test_huge_components_are_exact(spark):
    rng = random.Random(4)
    rows = [(i * 10, [rng.choice([1, 2, 3]) * 2.0**k for k in (20, 19, 3)], rng.choice("ab")) for i in range(40)]
    assert mined(spark.createDataFrame([(*r, 1, 2, b"k") for r in rows], SCHEMA)) == brute(rows) != []


def test_scores_beyond_a_long_are_its_ends():
    a = np.array([[2.0**40, 1.0]])
    assert N.scores(a, np.array([[2.0**40, 0.0], [-(2.0**40), 0.0], [2.0**20, 3.0]])).tolist() == [[(1 << 63) - 1, -(1 << 63) + 1, 2**60 + 3]]


def test_keys_order_as_pairs_do():
    rng = random.Random(5)
    pairs = [(rng.choice([-50, 0, 50]), 7, rng.choice([-5, 0, 5, 1 << 40]), rng.choice([0, 1]), rng.choice([0, 1]), rng.choice([-3, 0, 9])) for _ in range(200)]
    keys = [N._packed(np.array([a]), np.array([n]), np.array([s]), k, np.array([u]), np.array([i]))[0].as_py() for a, n, s, k, u, i in pairs]
    assert [x for _, x in sorted(zip(keys, pairs, strict=True))] == sorted(pairs, key=lambda x: (x[0], x[1], -x[2], *x[3:]))
    assert list(zip(*N._unpacked(np.frombuffer(b"".join(keys), N.KEY)), strict=True)) == pairs


def test_empty_and_no_anchors(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, [1.0], "a", 1, 1, b"")], SCHEMA)) == []


def test_keys_are_dealt_and_sorted_once(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    plan = N.mine(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [key") == 1 and "Window" not in plan
