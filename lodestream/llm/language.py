"""Language ID: averaged hashed subword embeddings with a linear softmax.

A word's subwords are its byte n-grams of 2 to 4 bytes, with marks for its begin and end, and the whole word; each is
hashed to one of BUCKETS rows of an embedding table. A text is the average of its subwords' embeddings, and a linear layer with
softmax gives the languages. Both are trained by stochastic gradient descent in numpy on segments of a bounded sample of
labelled rows (PER_LANGUAGE rows a language, SEGMENTS segments each, from all over the text). A part kept aside sets the temperature
that calibrates the scores, and the least score at which at least PRECISION of the predictions are right; below it a
prediction is marked as rejected.

The average of embeddings is linear, so a word's share of the logits is computed once and remembered.

Defined results: null text and text without a letter are `und` with score 0 and rejected; without labelled rows
everything is `und`. Whole texts are read; a text in several languages gets the one with the largest average.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.sampling import held_out, sample_by
from lodestream.session import table, tune

BUCKETS = 1 << 15
DIMENSIONS = 16
PER_LANGUAGE = 1500
SEGMENTS = 8
EPOCHS = 4
PRECISION = 0.99
CACHE_WORDS = 500_000

#: ASCII letters and all bytes of other characters stay; everything else separates words.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_LETTERS).split()


def subwords(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of all words, and the number of the word each belongs to."""
    raw = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    # a bucket depends on the n-gram's bytes and its length
    rolling, buckets, owners = raw + np.uint64(1), [], []
    for n in range(2, 5):
        if len(raw) < n:
            break
        rolling = rolling[:-1] * np.uint64(257) + raw[n - 1 :] + np.uint64(1)
        inside = owner[: len(rolling)] == owner[n - 1 :]
        h = (rolling[inside] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        buckets.append((h >> np.uint64(40)) % np.uint64(BUCKETS))
        owners.append(owner[: len(rolling)][inside])
    if len(words):
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        place = np.arange(len(raw)) - np.repeat(starts, sizes)
        power = np.uint64(0x100000001B3) ** (place % 64).astype(np.uint64)
        whole = np.add.reduceat((raw + np.uint64(1)) * power, starts) * np.uint64(0x9E3779B97F4A7C15)
        buckets.append((whole >> np.uint64(40)) % np.uint64(BUCKETS))
        owners.append(np.arange(len(words)))
    return np.concatenate(buckets).astype(np.int64) if buckets else np.zeros(0, np.int64), np.concatenate(owners) if owners else np.zeros(0, np.int64)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: What each bucket adds to the logits, embeddings times softmax weights.
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(rows: list[tuple[str, list[bytes]]], seed: int = 5) -> LanguageModel:
    """Train on (language, words) segments by mini-batch gradient descent."""
    languages = tuple(sorted({r[0] for r in rows}))
    if not languages:
        return LanguageModel((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    rows = [rows[k] for k in rng.permutation(len(rows))]
    y = np.array([languages.index(r[0]) for r in rows])
    feats = [subwords(r[1])[0] for r in rows]
    aside = max(1, len(rows) // 10) if len(rows) > 20 else 0
    table_ = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w = np.zeros((DIMENSIONS, len(languages)), np.float32)
    w += rng.normal(0, 0.1, w.shape).astype(np.float32)
    b = np.zeros(len(languages), np.float32)

    def average(part: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(feats[k]) for k in part])
        return np.concatenate([feats[k] for k in part]), np.repeat(np.arange(len(part)), sizes), sizes

    train = np.arange(aside, len(rows))
    steps, total = 0, max(1, EPOCHS * -(-len(train) // 32))
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(train), max(1, -(-len(train) // 32))):
            at, owner, sizes = average(part)
            mean = np.zeros((len(part), DIMENSIONS), np.float32)
            np.add.at(mean, owner, table_[at])
            mean /= sizes[:, None]
            grad = _softmax(mean @ w + b)
            grad[np.arange(len(part)), y[part]] -= 1
            rate = 0.5 * (1 - steps / total) + 0.01
            back = grad @ w.T
            w -= rate * mean.T @ grad / len(part) * 4
            b -= rate * grad.mean(0)
            np.add.at(table_, at, (-rate * back / sizes[:, None]).astype(np.float32)[owner] * 4)
            steps += 1
    logits = (table_ @ w).astype(np.float32)
    temperature, least = 1.0, 0.0
    if aside:
        z = np.stack([logits[feats[k]].mean(0) + b for k in range(aside)])
        grid = np.geomspace(0.1, 10, 41)
        loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(aside), y[:aside]], 1e-9)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(z / temperature)
        top, right = p.max(1), p.argmax(1) == y[:aside]
        order = np.argsort(-top)
        good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, aside + 1) >= PRECISION)
        least = float(top[order][good[-1]]) if len(good) else 1.0
    return LanguageModel(languages, logits, b, temperature, least)


def segments(rows: DataFrame) -> DataFrame:
    """(lang, segment): pieces of 1 to 16 words from all over each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, parts = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                for k in range(min(SEGMENTS, len(words))):
                    at = k * len(words) // SEGMENTS
                    part = words[at : at + (1, 2, 3, 4, 6, 8, 12, 16)[k % 8]]
                    if part:
                        langs.append(lang)
                        parts.append(b" ".join(part).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.string())], ["lang", "segment"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, segment string")


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """A model from labelled rows that are not held out: at most about per_language * SEGMENTS segments a language."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    return fit(sorted((r.lang, r.segment.encode().split()) for r in segments(sample_by(rows, "lang", per_language)).collect()))


class _Scorer:
    """Adds up remembered words' shares of the logits."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.row: dict[bytes, int] = {}
        self.shares = np.zeros((0, len(model.languages) + 1), np.float32)

    def learn(self, words: list[bytes]) -> None:
        at, owner = subwords(words)
        k = len(self.model.languages)
        new = np.empty((len(words), k + 1), np.float32)
        for j in range(k):
            new[:, j] = np.bincount(owner, weights=self.model.logits[at, j], minlength=len(words))
        new[:, k] = np.bincount(owner, minlength=len(words))
        self.row.update(zip(words, range(len(self.row), len(self.row) + len(words)), strict=True))
        self.shares = np.concatenate([self.shares, new])

    def logits(self, texts: list[list[bytes]]) -> np.ndarray:
        used = set().union(*texts) if texts else set()
        new = [w for w in used if w not in self.row]
        if len(self.row) + len(new) > CACHE_WORDS:
            self.row.clear()
            self.shares = self.shares[:0]
            new = list(used)
        if new:
            self.learn(sorted(new))
        out = np.zeros((len(texts), len(self.model.languages)), np.float64)
        get = self.row.__getitem__
        for k, words in enumerate(texts):
            if words:
                s = self.shares[np.fromiter(map(get, words), np.int64, len(words))].sum(0, dtype=np.float64)
                out[k] = s[:-1] / s[-1]
        return (out + self.model.bias) / self.model.temperature


_SCORERS: dict[str, _Scorer] = {}


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every whole text; nothing but the text is looked at."""
    shared, tag = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tag not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[tag] = _Scorer(shared.value)
        scorer, languages = _SCORERS[tag], shared.value.languages
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            for at in range(0, len(texts), 200):
                some = texts[at : at + 200]
                lettered = [k for k, t in enumerate(some) if t and languages and any(c.isalpha() for c in t)]
                if lettered:
                    p = _softmax(scorer.logits([words_of(some[k]) for k in lettered]))
                    for k, best, score in zip(lettered, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                        names[at + k], scores[at + k] = languages[best], score
            least = shared.value.least
            rejected = [n == "und" or s < least for n, s in zip(names, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, lang_pred string, score double, rejected boolean")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the language of every whole text of documents, learned from the rows that are not held out."""
    docs = table(tune(spark), sf_dir, "documents")
    out = predict(docs, learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
