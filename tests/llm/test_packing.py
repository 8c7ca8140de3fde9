import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path

from tapeworks.llm import packing

FILE = path("byte_bpe_50k.json")


def placed(histogram, capacity):
    """The sequences that plan() fills; fails if a piece is missing, moved twice, or runs over."""
    sequences, ranks = defaultdict(list), Counter()
    for n, first, count, base, each, shift in packing.plan(histogram, capacity):
        assert first == ranks[n]
        ranks[n] += count
        for i in range(count):
            sequences[base + i // each].append((shift + i % each * n, n))
    assert ranks == Counter({n: c for n, c in histogram.items() if c})
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
    return len(sequences)


def best_fit(histogram, capacity):
    rooms = []
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            i = min((i for i in range(len(rooms)) if rooms[i] >= n), key=lambda i: rooms[i], default=None)
            if i is None:
                rooms.append(capacity - n)
            else:
                rooms[i] -= n
    return len(rooms)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(0, 9), max_size=12))))
def test_plan_is_complete_and_no_worse_than_best_fit(case):
    capacity, histogram = case
    assert placed(histogram, capacity) <= best_fit(histogram, capacity)


def fewest(items, capacity):
    """Fewest sequences for a few items, by trying all."""
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= items[i]:
                go(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(4, 10), max_size=8))
def test_reduction_reaches_the_fewest_where_it_fixes_all(items):
    # two pieces of 4 to 10 fit a sequence of 11 at most, so every set is fixed by dominance
    assert placed(dict(Counter(items)), 11) == fewest(sorted(items, reverse=True), 11)


@pytest.mark.parametrize("text", ["", " ", " a", "a  b", "a   b\n c \n d ", "\ta b", "<|endoftext|> a", "a <|endoftext|>b <|endoftext|>\n c", "<|endoftext", "a \x1c b c", "Ça 'tis I'll 12 34% ²³ ½ x", "a\nb c.\nd", "\n", "a\n", "x" * 5000, "漢字 😀 b", "a Ġb"])
def test_ids_equal_the_tokenizers(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(FILE)
    assert np.frombuffer(packing.batch_encoder(FILE)([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_pack_is_whole(spark, awkward, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(FILE)
    for docs in (awkward, documents):
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
            edges = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                want[r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
        rows = packing.pack(docs, FILE).collect()
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
        sequences = defaultdict(list)
        for r in rows:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for pieces in sequences.values():
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
            assert at <= 1024


def test_special_tokens_have_their_own_ids(spark):
    assert np.frombuffer(packing.batch_encoder(FILE)(["<|endoftext|> x"])[0], "<u4").tolist() == [50256, 2124]
    assert packing.pack(spark.createDataFrame([(1, "<|endoftext|> x")], "doc_id long, text string"), FILE).first()["length"] == 3


def test_other_files_go_through_the_tokenizer():
    from tokenizers import Tokenizer

    file = path("word_bpe_49k.json")
    text = "A plain Text, <|endoftext|> and more"
    assert np.frombuffer(packing.batch_encoder(file)([text])[0], "<u4").tolist() == Tokenizer.from_file(file).encode(text, add_special_tokens=False).ids


def test_small_buckets_number_pieces_alike(spark, documents):
    whole = documents.orderBy("doc_id").limit(150)
    rows = packing.pack(whole, FILE, bucket=3).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    used = Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 1024 and len(used) == len({r["sequence_id"] for r in packing.pack(whole, FILE).collect()})


def test_empty_table(nothing):
    assert packing.pack(nothing, FILE).collect() == []
