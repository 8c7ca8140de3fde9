import math

import numpy as np
import pytest

from tapeworks.llm import embeddings
from tapeworks.llm.hnsw import Graph


def brute(rows):
    """vec_id -> (links, smallest id reached)."""
    usable = [(i, np.array(v, float), k) for i, v, k in rows if v and k is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: 0 for i, _, _ in rows}
    parent = {i: i for i, _, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x, k) in enumerate(usable):
        for j, y, m in usable[:a]:
            if k == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[i] += 1
                links[j] += 1
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: (links[i], root(i)) for i in links}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    rows = []
    for label in (1, 2):
        for centre in rng.normal(size=(12, 16)):
            rows += [((centre + rng.normal(size=16) * 0.08).tolist(), label) for _ in range(12)]
        rows += [(x.tolist(), label) for x in rng.normal(size=(80, 16))]
    rows += [([1.0] * 16, 1)] * 9 + [([2.0] * 16, 1)] * 3 + [([1.0] * 16, 2), ([1.0] * 16, None), ([1.0] * 8, 1), ([1.5] * 8, 1)]
    rows += [([0.0] * 16, 1)] * 2 + [(None, 1), ([], 1), ([None] * 16, 1), ([float("nan")] * 16, 1), ([float("inf")] + [1.0] * 15, 1), ([float("nan")] * 16, 1)]
    rows += [([1e30] * 16, 2)]
    order = rng.permutation(len(rows))
    return [(int(i), *rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize(("shard", "block"), [(20000, 2000), (60, 50)])
def test_links_and_components(spark, vectors, shard, block):
    df = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<double>, label int, key string")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, shard=shard, block=block).collect()}
    want = brute(vectors)
    assert got.keys() == want.keys()
    assert all(got[i]["n_links"] <= n for i, (n, _) in want.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * sum(n for n, _ in want.values()) > 1000
    assert sum(got[i]["component_id"] == c and got[i]["kept"] == (i == c) for i, (_, c) in want.items()) >= 0.99 * len(want)


def test_repeats_nulls_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    df = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (None, [5.0, -2.0], 3)], schema)
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in embeddings.near_duplicates(df).collect()) == [("1", 2, "1", True), ("1", 2, "1", True), ("None", 0, "None", True), ("None", 2, "1", False)]
    assert embeddings.near_duplicates(df.limit(0)).collect() == []


def test_labels_with_commas_and_numbers_are_not_mixed_up(spark):
    rows = [(1, [2.0, 3.0], "1"), (2, [3.0], "1,2.0"), (3, [6.0], "1,2.0"), (4, [3.0], "1"), (5, [4.0, 6.0], "1"), (-7, [2.0, 3.0], "1")]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: (2, -7), 5: (2, -7), -7: (2, -7), 2: (1, 2), 3: (1, 2), 4: (0, 4)}


def test_extreme_ids_are_the_smallest(spark):
    ids = [(1 << 63) - 1, 0, -(1 << 63), None]
    df = spark.createDataFrame([(i, [1.0, 0.1 * k]) for i in ids for k in (0, 1)], "vec_id long, embedding array<double>").selectExpr("*", "1 AS label")
    assert {r["component_id"] for r in embeddings.near_duplicates(df).collect()} == {-(1 << 63)}
    assert {r["component_id"] for r in embeddings.near_duplicates(df.where("vec_id > 0 or vec_id is null")).collect()} == {(1 << 63) - 1}


def test_audit_counts_each_query_alike_and_not_itself():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 12))
    x[:1000] = x[0] + 0.02 * rng.normal(size=(1000, 12))
    x[2000:2400] = x[1000:1400] + 0.05 * rng.normal(size=(400, 12))  # sparse pairs beside a large group
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Graph(x, 1 - rng.random(len(x)))
    graph.beam = 1
    graph.audit(0.98, 0.99, 64)
    pairs = [(i, int(j)) for i in range(1000, 1400) for j in np.flatnonzero(x @ x[i] >= 0.98) if j != i]
    assert sum(j in graph.within(x[i], 0.98) for i, j in pairs) >= 0.97 * len(pairs) > 0


def test_graph_finds_large_groups_and_survives_storing():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(600, 24)), rng.normal(size=24) + 0.05 * rng.normal(size=(500, 24))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[rng.permutation(len(x))]
    graph = Graph(x, 1 - rng.random(len(x)))
    graph.audit(0.98, 0.99, 64)
    again = Graph.load(graph.dump())
    true = found = 0
    for v in x:
        want = np.flatnonzero(x @ v >= 0.98)
        got = again.within(v, 0.98)
        assert set(got) <= set(want)
        true, found = true + len(want), found + len(got)
    assert found >= 0.99 * true
