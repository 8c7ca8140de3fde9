import hashlib
import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from tapeworks.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def test_the_model_goes_by_chunks():
    found = pieces.Segmenter(PATH)
    assert found.by_chunk and found.chunk is not pieces.WORD


def test_random_texts(library):
    rng, found = random.Random(1), pieces.Segmenter(PATH)
    for _ in range(3000):
        text = "".join(rng.choice(" ▁ab\n\té漢😀<s>/0x1eth\x00.,²’”!1") for _ in range(rng.randint(0, 120)))
        assert found.encode([text], end=False)[0].tolist() == library.encode(text)


def test_small_tables_and_whole_texts_give_the_same(monkeypatch, library):
    texts = [f"w{i} {'漢字' * i} {'ab' * i}  {i}" for i in range(200)]
    want = [library.encode(t) + [2] for t in texts]
    small, whole = pieces.Segmenter(PATH), pieces.Segmenter(PATH)
    monkeypatch.setattr(pieces, "MOST", 50)
    whole.by_chunk = False
    for found in (small, whole):
        for low in range(0, 200, 20):
            ids, ends = found.encode(texts[low : low + 20])
            assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)] == want[low : low + 20]


def test_awkward_rows(spark, awkward, nothing, library):
    got = sorted(pieces.digests(awkward, PATH).collect(), key=str)
    want = []
    for r in awkward.collect():
        ids = library.encode(r["text"] or "") + [2]
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert [tuple(r) for r in got] == [tuple(r) for r in sorted(want, key=lambda w: str(spark.createDataFrame([w], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string").collect()[0]))]
    assert pieces.digests(nothing, PATH).count() == 0


def test_decode_of_any_ids(spark, library):
    rows = spark.createDataFrame([(1, [264, 1867, 2], "x"), (2, None, "y"), (3, [], None), (4, [264, None, 1867], "z")], "doc_id long, ids array<int>, decoded string")
    got = {r["doc_id"]: r["decoded_"] for r in pieces.decode(rows, PATH).collect()}
    assert got == {1: library.decode([264, 1867]), 2: None, 3: "", 4: library.decode([264, 1867])}


def test_documents_round_trip(documents):
    both = pieces.decode(pieces.encode(documents, PATH), PATH)
    assert {(r["doc_id"], r["decoded"]) for r in both.select("doc_id", "decoded").collect()} == {(r["doc_id"], r["text"] or "") for r in documents.select("doc_id", "text").collect()}
