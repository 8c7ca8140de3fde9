import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F

from tapeworks.llm import chunks, decontamination, language_id, token_counts
from tapeworks.llm.common import shingle_hashes, weighted_jaccard, word_hashes

from .conftest import text_of

MODEL = path("piece_bpe_32k.model")


# decontamination


def all_windows(docs, items, similarity=0.8):
    """(doc, item) -> (similarity, first word) of the best of all windows as long as any item with as many words in a shingle."""
    hashed = {i: word_hashes(text) for i, text in items}
    found = {}
    for d, text in docs:
        words = word_hashes(text)
        for i, wanted in hashed.items():
            size = min(5, len(wanted))
            if not size or len(words) < size:
                continue
            target = shingle_hashes(wanted, size)
            best = (0.0, 0)
            for n in {min(len(h), len(words)) for h in hashed.values() if min(5, len(h)) == size}:
                for s in range(len(words) - n + 1):
                    best = max(best, (weighted_jaccard(shingle_hashes(words[s : s + n], size), target), -s))
            if best[0] >= similarity:
                found[d, i] = best[0], -best[1]
    return found


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(2)
    items = [(i, text_of(rng, n)) for i, n in enumerate([14, 20, 37, 59, 59, 3, 1])] + [(7, None), (8, ""), (3, None), (None, text_of(rng, 30))]
    docs = []
    for k in range(120):
        words = text_of(rng, rng.randint(0, 150)).split()
        item = items[k % 5][1].split()
        if k % 3:
            for _ in range(k % 4):  # changes at its ends, or one inside
                item = item[1:] if k % 2 else item[:-1] + [text_of(rng, 1)]
            words[len(words) // 2 : len(words) // 2] = item
        docs.append((k, " ".join(words), "x"))
    docs += [(500, None, "x"), (501, "", "x"), (502, items[5][1], "x"), (None, f"A {items[-1][1]} b", "x"), (503, items[1][1].upper() + "!", "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items + items[:1], "item_id long, text string")


def matched(docs, items):
    return {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"]) for r in decontamination.contaminated(docs, items).collect()}


def test_leaks_equal_all_windows(leaks):
    docs, items = leaks
    want = all_windows([(d["doc_id"], d["text"]) for d in docs.collect()], [(i["item_id"], i["text"]) for i in items.where("text is not null").distinct().collect()])
    assert matched(docs, items) == want and len(want) > 40
    kept = decontamination.decontaminate(docs, items)
    flagged = {d for d, _ in want}
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] not in flagged)


def test_leaks_in_another_order_equal_all_windows(spark):
    rng = random.Random(8)
    items, docs = [], []
    for k in range(6):
        item = text_of(rng, rng.choice((60, 75, 100))).split()
        if k % 4 == 3:
            item = (item[:20] * 5)[:75]  # shingles that repeat
        cut = (20, len(item) // 2, len(item) - 20)[k % 3]
        around = text_of(rng, 40).split()
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(around[:20] + item[cut:] + item[:cut] + around[20:])))  # no shingle keeps its offset
        docs.append((100 + k, " ".join(item[cut:] + item[:cut])))
        docs.append((200 + k, " ".join(around[:20] + item[: len(item) // 2] + around[20:])))
        docs.append((300 + k, " ".join(item + around[:3] + item)))  # two places
    columns = "doc_id long, text string", "item_id long, text string"
    want = all_windows(docs, items)
    assert matched(spark.createDataFrame(docs, columns[0]), spark.createDataFrame(items, columns[1])) == want and len(want) >= 15
    kept = decontamination.decontaminate(spark.createDataFrame(docs, columns[0]), spark.createDataFrame(items, columns[1]))
    assert not {r["doc_id"] for r in kept.collect()} & {d for d, _ in want}


def test_leaks_in_passes_and_empty_tables(leaks, nothing, monkeypatch):
    docs, items = leaks
    one = sorted(tuple(r)[:3] for r in decontamination.contaminated(docs.where("doc_id is not null"), items).collect())
    monkeypatch.setattr(decontamination, "PASS_BYTES", 300)
    assert sorted(tuple(r)[:3] for r in decontamination.contaminated(docs.where("doc_id is not null"), items).collect()) == one
    assert decontamination.contaminated(nothing, items).collect() == []
    assert decontamination.contaminated(docs, items.limit(0)).collect() == []
    assert decontamination.decontaminate(docs, items.limit(0)).count() == docs.count()


@pytest.mark.parametrize("entries", [8_000_000, 1_000_000, 100_000, 1])
def test_index_finds_all_within_the_radius_and_compares_fewer_than_a_scan(entries):
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 16, (600, decontamination.BLOCKS), dtype=np.uint16)
    index = decontamination.MultiIndex(prints, entries)
    asked = prints[rng.integers(600, size=80)]
    for x in asked:
        for bit in rng.choice(decontamination.BITS, rng.integers(0, 75), replace=False):
            x[bit // 16] ^= np.uint16(1 << (bit % 16))
    distance = np.bitwise_count(prints[None] ^ asked[:, None]).sum(axis=2, dtype=int)
    want = np.nonzero(distance <= decontamination.RADIUS)
    assert all((a == b).all() for a, b in zip(index.near(asked), want, strict=True)) and len(want[0]) > 50
    assert index.compared < 0.25 * len(asked) * len(prints)


def test_rolled_fingerprints_equal_direct_ones(monkeypatch):
    rng = np.random.default_rng(5)
    shingles = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    starts = np.sort(rng.choice(2900, 200, replace=False))
    for step in (decontamination.STEP, 7, 3):  # then the windows are long ones, rolled
        monkeypatch.setattr(decontamination, "STEP", step)
        found = decontamination.simhashes(shingles, {60: starts, 13: starts[::3]})
        for width, at in ((60, starts), (13, starts[::3])):
            assert (found[width] == np.concatenate([decontamination.simhash(shingles[s : s + width]) for s in at])).all()


def test_fingerprints_of_similar_bags_are_within_the_radius():
    rng = np.random.default_rng(6)
    for shared, more, other in ((4, 1, 0), (8, 1, 1), (32, 4, 4)):  # similarity 0.8
        far = 0
        for _ in range(500):
            x = rng.integers(0, 1 << 63, shared + more + other).astype(np.uint64)
            a, b = decontamination.simhash(x[: shared + more]), decontamination.simhash(np.concatenate([x[:shared], x[shared + more :]]))
            far += int(np.bitwise_count(a ^ b).sum()) > decontamination.RADIUS
        assert far <= 1


# chunks


def test_chunks_cover_the_text_and_come_back_after_an_insertion():
    rng = random.Random(1)
    text = text_of(rng, 3000) + " née 漢字😀 " * 20
    found = chunks.split(text)
    assert found[0][1] == 0 and found[-1][2] == len(text)
    assert all(a[2] == b[1] for a, b in zip(found, found[1:], strict=False)) and sum(c[3] for c in found) == len(text.encode())
    assert 25 < sum(c[3] for c in found[:200]) / 200 < 45 and min(c[3] for c in found[:-1]) > chunks.REACH
    digests = {c[0] for c in found}
    moved = [c[0] for c in chunks.split("inserted " + text[:5000] + "?" + text[5000:])]
    assert sum(d not in digests for d in moved) < 8
    assert chunks.split("x" * 2000)[0][3] == 2000


def shared_docs(rows, n):
    held = defaultdict(set)
    for k, t in enumerate(rows):
        words = (t or "").split()
        for i in range(len(words) - n + 1):
            held[" ".join(words[i : i + n])].add(k)
    return {k for ks in held.values() if len(ks) > 1 for k in ks}


def test_repeats_hold_all_long_passages_and_no_clean_text(documents, awkward, nothing):
    rows = documents.select("doc_id", "text").collect()
    got = chunks.repeats(documents).collect()
    found = {r["doc_id"] for r in got}
    index = {k: r["doc_id"] for k, r in enumerate(rows)}
    assert {index[k] for k in shared_docs([r["text"] for r in rows], 50)} <= found
    assert found <= {index[k] for k in shared_docs([r["text"] for r in rows], 10)}
    assert all(r["end"] - r["start"] <= r["n_bytes"] for r in got)
    found = chunks.repeats(awkward).collect()
    assert {r["doc_id"] for r in found} == {1, 2, 3, None}
    assert all(r["kept"] == (r["doc_id"] == 1) for r in found)
    assert {r["doc_id"] for r in chunks.repeats(awkward, within=True).collect()} >= {1, 2, 3, None}
    assert chunks.repeats(nothing).collect() == []


# token counts


def counted(scores, text):
    """Pieces of the best cut, by plain dynamic programming over each pre-token."""
    unknown = 2 * min(scores.values())
    total = 0
    for word in (text or "").split():
        word = token_counts.SPACE + word
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            ways = [(best[j][0] - scores[word[j:i]], best[j][1] + 1) for j in range(max(0, i - 60), i) if word[j:i] in scores]
            best.append(min(ways) if ways else (best[-1][0] - unknown, best[-1][1] + len(word[i - 1].encode())))
        total += best[-1][1]
    return total


def test_token_counts_equal_plain_programming(documents, awkward, nothing):
    scores = token_counts.scores_of(MODEL)
    for docs in (documents, awkward):
        want = Counter((r["doc_id"], len((r["text"] or "").split()), counted(scores, r["text"])) for r in docs.collect())
        assert Counter(tuple(r) for r in token_counts.token_counts(docs, MODEL).collect()) == want
    assert token_counts.token_counts(nothing, MODEL).collect() == []


def test_trie_shares_prefixes_and_is_bounded():
    trie = token_counts.Trie({"a": -1.0, "ab": -1.5, "b": -1.0, "▁a": -1.2})
    trie.insert(["ab", "abb", "abc"])
    assert trie.nodes == 5 and trie.terminal == {"ab": 2, "abb": 3, "abc": 3}


def test_long_pretokens_have_no_nodes_and_the_same_count(monkeypatch):
    scores = token_counts.scores_of(MODEL)
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeé漢 ﬁ"[:8]) for _ in range(rng.randint(150, 600))) for _ in range(40)]
    words = [w.replace(" ", "") for w in words]
    rolled, stored = token_counts.Trie(scores), token_counts.Trie(scores, most=500)
    rolled.insert(words)
    monkeypatch.setattr(token_counts, "LONG", 10_000)
    stored.insert(words)
    assert rolled.terminal == stored.terminal == {w: counted(scores, w) for w in words}
    assert rolled.nodes <= 200 * len(words) and stored.nodes <= 500 + 600


def test_a_run_of_five_million_letters_stays_small():
    trie = token_counts.Trie(token_counts.scores_of(MODEL))
    tracemalloc.start()
    trie.insert(["ab" * 250_000 + "x" * 4_500_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert trie.nodes == 0 and peak < 40_000_000 and sum(trie.terminal.values()) > 500_000


@pytest.mark.parametrize("within", [False, True])
def test_repeats_equal_brute_force(spark, within):
    rng = random.Random(12)
    shared = [text_of(rng, 60) for _ in range(4)]
    docs = []
    for d in range(40):
        parts = [text_of(rng, rng.randint(5, 60)) for _ in range(4)]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, 4), rng.choice(shared))
        docs.append((rng.choice([d, d, None, 7]), " ".join(parts)))
    docs += docs[:2] + [(50, None), (51, ""), (52, "x" * 3000), (53, "x" * 3000)]
    split = [(i if i is not None else 1 << 63, chunks.split(t) if t else []) for i, t in docs]
    holders, first = Counter(), {}
    for order, found in split:
        for c in found if within else {c[0]: c for c in found}.values():
            holders[c[0]] += 1
            first[c[0]] = min(first.get(c[0], order), order)
    want = Counter()
    for (i, _), (order, found) in zip(docs, split, strict=True):
        k = 0
        while k < len(found):
            end = k
            while end < len(found) and holders[found[end][0]] > 1:
                end += 1
            size = sum(c[3] for c in found[k:end])
            if end > k and (size >= chunks.LEAST or sum(c[4] for c in found[k:end]) >= chunks.WORDS):
                n_first = sum(first[c[0]] == order and not c[5] for c in found[k:end])
                want[i, found[k][1], found[end - 1][2], end - k, size, n_first, n_first == end - k] += 1
            k = max(end, k + 1)
    got = chunks.repeats(spark.createDataFrame(docs, "doc_id long, text string"), within=within)
    assert Counter(tuple(r[c] for c in ("doc_id", "start", "end", "n_chunks", "n_bytes", "n_first", "kept")) for r in got.collect()) == want and len(want) > 10


@pytest.mark.parametrize(("most", "share"), [(3, 0.95), (2, 0.8), (1, 0.5)])
def test_passages_of_fifty_short_words(spark, most, share):
    """Words of up to so many letters; what is lost has cuts near its ends only. Figures as the README states them."""
    rng = random.Random(most)
    letters = "abcdefghijklmnopqrstuvwxyz"
    passages = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, most))) for _ in range(50)) for _ in range(200)]
    docs = [(2 * k + j, f"{text_of(rng, 40)} {passage} {text_of(rng, 40)}") for k, passage in enumerate(passages) for j in (0, 1)]
    found = {r["doc_id"] // 2 for r in chunks.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(found) >= share * len(passages)


def test_periodic_text_is_cut(spark):
    for period in ("x", "abc def ", "漢"):
        one, two = period * 40_000, "Another beginning. " + period * 41_000 + " and end"
        found = chunks.split(one)
        assert max(c[3] for c in found) <= 3 * chunks.STEP and "".join(one[c[1] : c[2]] for c in found) == one
        rows = chunks.repeats(spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")).collect()
        covered = {i: sum(r["end"] - r["start"] for r in rows if r["doc_id"] == i) for i in (1, 2)}
        assert covered[1] > 0.9 * len(one) and covered[2] > 0.9 * len(two)


# language


def test_language_of_held_out_rows(documents, awkward, nothing):
    import zlib

    rows = {r["doc_id"]: r for r in language_id.identify(documents).collect()}
    lang = {r["doc_id"]: r["lang"] for r in documents.collect()}
    assert rows.keys() == lang.keys()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    out = [i for i, r in rows.items() if r["held_out"]]
    assert sum(rows[i]["lang_pred"] == lang[i] for i in out) >= 0.95 * len(out) and all(0 <= r["score"] <= 1 for r in rows.values())
    got = language_id.identify(awkward).collect()
    assert len(got) == awkward.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (4, 5, 6, 7, 11))
    assert all(r["lang_pred"] in ("en", "fr") for r in got if r["doc_id"] in (1, 2, 3, 8, 9, 10, 12))
    assert language_id.identify(nothing).collect() == []
    unlabelled = awkward.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in language_id.identify(unlabelled).collect()} == {"und"}


def test_fit_equals_plain_ftrl(monkeypatch):
    monkeypatch.setattr(language_id, "FEATURES", 40)
    monkeypatch.setattr(language_id, "L1", 2.0)
    rng = np.random.default_rng(3)
    rows = [(lang, rng.poisson(np.where(np.arange(40) % 3 == k, 2.0, 0.4)) + (np.arange(40) == 0)) for _ in range(30) for k, lang in enumerate(("de", "en", "fr"))]
    idf = rng.uniform(1, 3, 40)
    model = language_id.fit(rows, idf)
    fitted, left = [r for i, r in enumerate(rows) if i // 3 % 5 != 4], [r for i, r in enumerate(rows) if i // 3 % 5 == 4]
    z, n, weight = np.zeros((40, 3)), np.zeros((40, 3)), np.zeros((40, 3))

    def tfidf(counts):
        x = [np.log(1 + c) * f for c, f in zip(counts, idf, strict=True)]
        norm = sum(v * v for v in x) ** 0.5
        return [v / norm for v in x]

    def chances(x, t=1.0):
        logits = [sum(x[i] * weight[i, k] for i in range(40)) / t for k in range(3)]
        e = [np.exp(v - max(logits)) for v in logits]
        return [v / sum(e) for v in e]

    for epoch in range(language_id.EPOCHS):
        for r in np.random.default_rng(epoch).permutation(len(fitted)):
            lang, counts = fitted[r]
            x = tfidf(counts)
            for i in range(40):
                for k in range(3):
                    rate = (language_id.BETA + n[i, k] ** 0.5) / language_id.ALPHA + language_id.L2
                    weight[i, k] = 0 if abs(z[i, k]) <= language_id.L1 else (np.sign(z[i, k]) * language_id.L1 - z[i, k]) / rate
            p = chances(x)
            for i in range(40):
                for k in range(3):
                    g = x[i] * (p[k] - (model.languages[k] == lang))
                    z[i, k] += g - ((n[i, k] + g * g) ** 0.5 - n[i, k] ** 0.5) / language_id.ALPHA * weight[i, k]
                    n[i, k] += g * g
    for i in range(40):
        for k in range(3):
            rate = (language_id.BETA + n[i, k] ** 0.5) / language_id.ALPHA + language_id.L2
            weight[i, k] = 0 if abs(z[i, k]) <= language_id.L1 else (np.sign(z[i, k]) * language_id.L1 - z[i, k]) / rate
    assert model.languages == ["de", "en", "fr"] and np.allclose(model.weights, weight, atol=1e-9) and (weight == 0).any()
    doubt = 1 / (len(left) + 2)

    def loss(t):
        ps = [(model.languages.index(lang), chances(tfidf(counts), t)) for lang, counts in left]
        return -sum((1 - doubt) * np.log(p[k]) + doubt / 2 * sum(np.log(p[j]) for j in range(3) if j != k) for k, p in ps)

    assert loss(model.temperature) <= min(loss(model.temperature * f) for f in (0.8, 0.9, 1.1, 1.25)) + 1e-9


def test_letters_of_all_planes():
    assert language_id.ngram_counts(chr(0x30010)) is not None and language_id.ngram_counts("12 !") is None


def test_six_hundred_languages_are_learned(spark, monkeypatch):
    rng = random.Random(6)
    stems = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(5)] for k in range(600)}
    rows, i = [], 0
    for k, (lang, words) in enumerate(stems.items()):
        for _ in range(2 if k == 7 else 8):  # a rare one too
            while zlib.crc32(str(i).encode()) % 4 == 2:
                i += 1
            rows.append((i, " ".join(rng.choice(words) for _ in range(12)), lang))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "ROWS", 600)
    model = language_id.train(docs)
    assert model.languages == sorted(stems) and model.weights.any(axis=0).all()
    told = [model.predict(" ".join(words))[0] == lang for lang, words in stems.items()]
    assert sum(told) >= 540 and told[7]


def test_nothing_learned_keeps_texts_with_letters(awkward):
    lettered = sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in awkward.collect() if any(map(str.isalpha, r["text"] or "")))
    unlabelled = awkward.withColumn("lang", F.lit(None).cast("string"))
    held_only = awkward.withColumn("lang", F.when(language_id.held_out(), "en"))
    for docs in (unlabelled, held_only):
        kept = language_id.keep_known(docs, 0.4)
        assert kept.columns == docs.columns
        assert sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in kept.collect()) == lettered


def test_predictions_use_the_text_alone(documents):
    plain = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(documents).collect()}
    model = language_id.train(documents)
    other = documents.selectExpr("doc_id", "text", "'zz' as lang", "'zz' as source")
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.predict(other, model).collect()} == plain
