"""Language identification (operator 10): sparse multinomial logistic regression on TF-IDF of character n-grams.

Document frequencies come from all labelled rows. The weights are fitted on a bounded sample of them, by
follow-the-regularised-leader with elastic-net penalties, one document at a time; a temperature, fitted on a part of the
sample that the weights have not seen, makes the scores probabilities. The model's size does not depend on the corpus.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, mix

#: Buckets of hashed n-grams of 1 to 3 characters, labelled rows of each language that the weights and the temperature are fitted on at most.
FEATURES, LONGEST, SAMPLE = 1 << 14, 3, 600
#: Labelled rows of all languages together that the fit takes at most: where there are many languages each has an equal part of
#: them, but LEAST at least, so that none is left out. The model takes 128 KB for each language.
ROWS, LEAST = 24_000, 5
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.02, 3
UNKNOWN = "und"
LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])


def ngram_counts(text: str | None) -> np.ndarray | None:
    """How often each bucket's n-grams occur in the lower-case letters of a text, other runs as one blank; None without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = LETTER[codes]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    kept = np.concatenate([[32], np.where(letter, codes, 32)[keep], [32]]).astype(np.uint64)
    hashes, parts = np.zeros(len(kept), np.uint64), []
    for n in range(1, LONGEST + 1):
        hashes = hashes[: len(kept) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + kept[n - 1 :] + np.uint64(n)
        parts.append((mix(hashes) >> np.uint64(32)).astype(np.int64) % FEATURES)
    return np.bincount(np.concatenate(parts), minlength=FEATURES)


def weigh(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, TF-IDF): logarithmic term frequencies, of length 1."""
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    return at, x / max(np.sqrt(x @ x), 1e-12)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        at, x = weigh(counts, self.idf)
        return x @ self.weights[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = ngram_counts(text) if self.languages else None
        if counts is None:
            return UNKNOWN, 0.0
        chances = softmax(self.logits(counts) / self.temperature)
        best = int(chances.argmax())
        return self.languages[best], float(chances[best])


def fit(rows: Iterable[tuple[str, np.ndarray]], idf: np.ndarray) -> Model:
    """The model of (language, counts) rows, in their order; every fifth of a language is left for the temperature."""
    sparse = [(lang, *weigh(counts, idf)) for lang, counts in rows]
    languages = sorted({lang for lang, *_ in sparse})
    if not languages:
        return Model([], idf, np.zeros((FEATURES, 0)))
    known = {lang: k for k, lang in enumerate(languages)}
    z = np.zeros((FEATURES, len(languages)))
    n = np.zeros_like(z)
    data = [(known[lang], at, x) for lang, at, x in sparse]
    place = np.zeros(len(languages), np.int64)
    fitted, left = [], []
    for d in data:
        place[d[0]] += 1
        (left if place[d[0]] % 5 == 0 else fitted).append(d)
    fitted, left = (fitted, left) if len(left) >= 10 else (data, data)

    def weights_at(at: np.ndarray | slice) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(fitted)):
            label, at, x = fitted[i]
            w = weights_at(at)
            error = softmax(x @ w)
            error[label] -= 1
            g = x[:, None] * error
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    weights = weights_at(slice(None))
    logits, labels = np.array([x @ weights[at] for _, at, x in left]), np.array([label for label, _, _ in left])
    doubt = 1 / (len(labels) + 2)  # a little on the other languages, so that rows without an error don't make the scores 0 and 1

    def loss(t: float) -> float:
        logs = np.log(np.maximum(softmax(logits / t), 1e-300))
        right = logs[np.arange(len(labels)), labels]
        return -((1 - doubt) * right + doubt * (logs.sum(axis=1) - right) / max(1, len(languages) - 1)).mean()

    return Model(languages, idf, weights, min(np.geomspace(0.02, 20, 121), key=loss))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """The model of the rows of ``docs`` that have an id, a text and a language and are not held out.

    All languages are learned. Of each the ``sample`` rows (fewer where they are many, see ROWS) with the smallest hashes
    of id and text fit the weights; rows come to the driver as bucket counts, so that it holds ROWS short arrays, or LEAST
    for each language. Without such rows nothing is learned.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("id"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts = np.zeros(FEATURES, np.int64), 0
        for part in by_bytes(batches, 0):
            for text in part.column(0).to_pylist():
                counts = ngram_counts(text)
                if counts is not None:
                    held += counts > 0
                    texts += 1
        at = np.flatnonzero(held)
        yield pa.record_batch([pa.array([-1, *at], pa.int32()), pa.array([texts, *held[at]], pa.int64())], names=["bucket", "n"])

    frequency = {r["bucket"]: r["n"] for r in rows.select("text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    texts = frequency.pop(-1, 0)
    idf = np.full(FEATURES, np.log(1 + texts) + 1)
    idf[list(frequency)] = np.log((1 + texts) / (1 + np.array(list(frequency.values()), float))) + 1

    sizes = rows.groupBy("lang").count().collect()
    sample = min(sample, max(LEAST, ROWS // max(1, len(sizes))))
    sizes = docs.sparkSession.createDataFrame(sizes, "lang string, size long")
    likely = F.least(F.lit(1 << 31), F.lit((1 << 31) * 3 * sample) / F.col("size") + 1)
    order = F.pmod(F.xxhash64("id"), F.lit(1 << 31))
    few = rows.join(F.broadcast(sizes), "lang").withColumn("order", order).where(F.col("order") < likely)
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("order", "id", F.xxhash64("text")))).where(F.col("k") <= sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, 2):
            found = [(k, lang, c) for k, lang, text in zip(*(x.to_pylist() for x in part.columns), strict=True) if (c := ngram_counts(text)) is not None]
            at = [np.flatnonzero(c) for _, _, c in found]
            yield pa.record_batch([pa.array([k for k, _, _ in found], pa.int32()), pa.array([x for _, x, _ in found], pa.string()), pa.array([a.astype(np.int32).tobytes() for a in at], pa.binary()), pa.array([c[a].astype(np.int32).tobytes() for a, (_, _, c) in zip(at, found, strict=True)], pa.binary())], names=["k", "lang", "at", "counts"])

    def dense(r) -> np.ndarray:
        counts = np.zeros(FEATURES, np.int32)
        counts[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["counts"], np.int32)
        return counts

    fetched = few.select("k", "lang", "text").mapInArrow(count, "k int, lang string, at binary, counts binary").collect()
    return fit(((r["lang"], dense(r)) for r in sorted(fetched, key=lambda r: (r["k"], r["lang"]))), idf)  # one dense array at a time


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): a row for each of ``docs``. ``und`` with a score of 0 if the text is null or has no letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, 1):
            found = [model.predict(t) for t in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``, by the model that the rows that aren't held out give.

    Repeated rows are predicted each; a null id is not held out and not learned from; an empty table gives no rows.
    """
    return predict(docs, train(docs, id_col, text_col, lang_col), id_col, text_col).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without those whose language is ``und`` or has a score under ``least``; rows and columns that stay are unchanged.

    Where no row could be learned from (no languages, or only on rows that are held out), only texts without letters go.
    """
    model, at = train(docs, id_col, text_col, lang_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, at):
            if model.languages:
                found = [model.predict(t) for t in part.column(at).to_pylist()]
                kept = [lang != UNKNOWN and score >= least for lang, score in found]
            else:
                kept = [ngram_counts(t) is not None for t in part.column(at).to_pylist()]
            yield part.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
