import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tapeworks.llm import minhash
from tapeworks.llm.common import components, shingle_hashes, weighted_jaccard, word_hashes

from .conftest import text_of


def groups(rows):
    """id -> smallest id of its group, by comparing all pairs that share a shingle."""
    shingles = {i: shingle_hashes(word_hashes(t)) for i, t in rows}
    holders, parent = defaultdict(set), {i: i for i in shingles}
    for i, s in shingles.items():
        for x in set(s.tolist()):
            holders[x].add(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}:
        if weighted_jaccard(shingles[a], shingles[b]) >= 0.8:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in shingles}


def near_copies(rng, base, n, edits):
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = text_of(rng, 1)
        yield " ".join(words)


@pytest.fixture(scope="module")
def grouped(spark):
    rng = random.Random(3)
    shared = text_of(rng, 60)
    rows = [t for n in (40, 150) for t in near_copies(rng, text_of(rng, n), 60, 4)]
    rows += [f"{text_of(rng, rng.randint(10, 60))} {shared} {text_of(rng, 20)}" for _ in range(60)] + [text_of(rng, rng.randint(1, 90)) for _ in range(60)]
    rng.shuffle(rows)
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)


def test_equals_all_pairs(grouped, documents):
    for docs in (grouped, documents.select("doc_id", "text")):
        want = groups([(r["doc_id"], r["text"]) for r in docs.collect()])
        got = {r["doc_id"]: (r["cluster_id"], r["cluster_size"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
        sizes = Counter(want.values())
        assert got == {i: (g, sizes[g], i == g) for i, g in want.items()}
        assert docs is not grouped or max(sizes.values()) > 5


def test_awkward_rows(awkward, nothing):
    rows = minhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert all(r["cluster_id"] == 1 and r["cluster_size"] == 5 for i in (1, 2, 3) for r in by[i])
    assert [r["kept"] for i in (4, 5, 6, 7) for r in by[i]] == [True] * 5  # without words each is alone
    assert minhash.near_duplicates(nothing).collect() == []
    kept = minhash.deduplicate(awkward)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and not {2, 3} & set(ids) and {4, 5, 6, 7, 8, 9, 10, 11, 12} <= set(ids)
    assert minhash.deduplicate(nothing).collect() == []


def test_one_class_of_a_group_stays_whatever_its_ids(spark):
    rng = random.Random(11)
    nulls, same, mixed = ([f"{base} {text_of(rng, 1)}x{i}" for i in range(4)] for base in (text_of(rng, 80) for _ in range(3)))
    rows = [(None, t) for t in nulls + nulls[:1]] + [(7, t) for t in same + same[:1]] + list(zip((None, 9, 9, 12), mixed, strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash.near_duplicates(docs).collect()
    assert Counter((r["cluster_id"], r["cluster_size"]) for r in found) == {(None, 5): 5, (7, 5): 5, (9, 4): 4}
    kept = minhash.deduplicate(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["7", "9", "None"]
    assert {r["key"] for r in found if r["kept"]} == {hashlib.md5(r["text"].encode()).digest() for r in kept}


def test_signatures_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    for weights, other in ((np.ones(400), np.r_[np.ones(320), np.zeros(80)]), (rng.integers(1, 6, 400).astype(float), rng.integers(1, 6, 400).astype(float)), (rng.random(400) + 0.1, rng.random(400) + 0.1)):
        a, b = minhash.darts(x, weights, 4000), minhash.darts(x[other > 0], other[other > 0], 4000)
        want = np.minimum(weights, other).sum() / np.maximum(weights, other).sum()
        assert abs((a == b).mean() - want) < 0.04
    for n in (1, 2, 7):
        assert len(set(minhash.darts(x[:n], np.ones(n), 240).tolist())) > 100


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(5, 5), (None, 3)]
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: root(v) for v in parent}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_deduplicate_takes_columns_named_as_its_own(spark):
    names = ("_own", "_id", "_key", "kept_id", "kept_key", "text_key", "KEY", "rows", "bands")
    base = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, t, *range(len(names))) for i, t in ((3, base), (1, base + " x"), (1, base + " x"), (2, "other text"), (None, base))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(1, base + " x", *range(len(names))), (2, "other text", *range(len(names)))]
