"""A quality classifier from subword embeddings learned with the labels.

A document is the mean of the vectors of its words, of their character n-grams and of the bigrams of a
word with itself (in one slot, whatever the word), all hashed into one table; a softmax over two classes
follows. ``rest`` zero vectors are part of each mean, so that a few words alone decide little. Vectors and weights are trained together by stochastic
gradient descent in numpy, on a bounded sample: at most ``per_class`` labelled documents of each class,
of at most ``max_bytes`` bytes (longer ones don't train; every text is scored whole). Both classes count
alike in training; ``prior`` sets the share of label 1 that scores assume.

Since the mean is linear, each hashed feature comes down to one number for scoring, and each word to a
sum of such numbers; tasks remember them by word.

Defined results: a null or empty text, or one without words, has the score of the bias alone; without
labelled documents every score is the prior; labels other than 0 and 1, or null, don't train; a doc_id
with several labels trains once for each; rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import adding, batches, bounded_sample, train_fold, without, words_of


@dataclass(frozen=True)
class SubwordClassifier:
    per_class: int = 1500
    max_bytes: int = 100_000
    table: int = 1 << 16
    dim: int = 12
    grams: tuple[int, int] = (2, 4)
    rest: int = 60
    epochs: int = 8
    rate: float = 4.0
    prior: float = 0.5
    threshold: float = 0.3
    seed: int = 7


def word_features(word: bytes, p: SubwordClassifier) -> list[int]:
    """Slots of a word and of the n-grams of ``<word>``, which are bytes of UTF-8; case is kept."""
    marked = b"<" + word + b">"
    out = [zlib.crc32(word, 1) % p.table]
    for n in range(p.grams[0], p.grams[1] + 1):
        out += [zlib.crc32(marked[k : k + n]) % p.table for k in range(len(marked) - n + 1)]
    return out


def repeats(words: list[bytes]) -> int:
    """Bigrams of a word with itself."""
    return sum(map(eq, words, words[1:]))


def repeat_slot(p: SubwordClassifier) -> int:
    return zlib.crc32(b"a bigram of a word with itself") % p.table


@dataclass(frozen=True)
class Trained:
    """What scoring needs: a number for each slot, and the bias; both for class 1 against class 0."""

    slots: np.ndarray
    bias: float


def train(texts: list[str], labels: list[int], p: SubwordClassifier = SubwordClassifier()) -> Trained:
    shift = float(np.log(p.prior / (1 - p.prior)))
    if len(set(labels)) < 2:
        return Trained(np.zeros(p.table), shift)
    known: dict[bytes, np.ndarray] = {}
    bags = []
    for text in texts:
        words = words_of(text)
        for w in words:
            if w not in known:
                known[w] = np.array(word_features(w, p), np.int32)
        found = np.concatenate([np.full(repeats(words), repeat_slot(p), np.int32), *(known[w] for w in words)])
        slot, n = np.unique(found, return_counts=True)
        bags.append((slot, (n / (n.sum() + p.rest)).astype(np.float32)[:, None]))
    del known
    rng = np.random.default_rng(p.seed)
    vectors = rng.uniform(-1 / p.dim, 1 / p.dim, (p.table, p.dim))
    out, bias = np.zeros((p.dim, 2)), np.zeros(2)
    share = np.bincount(labels, minlength=2) / len(labels)
    weight = 0.5 / share
    steps, done = p.epochs * len(bags), 0
    for _ in range(p.epochs):
        for k in rng.permutation(len(bags)):
            slot, part = bags[k]
            rate = p.rate * (1 - done / steps)
            done += 1
            if not len(slot):
                continue
            mean = (vectors[slot] * part).sum(axis=0)
            z = mean @ out + bias
            e = np.exp(z - z.max())
            grad = e / e.sum()
            grad[labels[k]] -= 1
            grad *= weight[labels[k]] * rate
            vectors[slot] -= part * (out @ grad)
            out -= np.outer(mean, grad)
            bias -= 0.1 * grad
    return Trained((vectors @ (out[:, 1] - out[:, 0])), float(bias[1] - bias[0]) + shift)


class _WordValues(dict):
    """word -> (sum of its slots' numbers) + (how many) j, so that one sum gives both."""

    def __init__(self, model: Trained, p: SubwordClassifier, limit: int = 400_000):
        super().__init__()
        self.slots, self.p, self.limit = model.slots.tolist(), p, limit

    def __missing__(self, word: bytes) -> complex:
        f = word_features(word, self.p)
        value = complex(sum(map(self.slots.__getitem__, f)), len(f))
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value


def score_texts(docs: DataFrame, model: Trained, p: SubwordClassifier = SubwordClassifier(), names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with score and predicted, under these names; they replace columns with such names in any case."""
    kept = without(docs.columns, *names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, twice = _WordValues(model, p), complex(model.slots[repeat_slot(p)], 1)
        for batch in it:
            z = np.empty(batch.num_rows)
            for k, text in enumerate(batch.column("text")):
                words = words_of(text.as_py())
                total = sum(map(values.__getitem__, words), 0j) + twice * repeats(words)
                z[k] = total.real / (total.imag + p.rest) + model.bias
            score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            cols = [*(batch.column(c) for c in kept), pa.array(score), pa.array((score >= p.threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, [*kept, *names])

    return batches(docs, run, adding(docs, [c for c in docs.columns if c not in kept], f"`{names[0]}` double, `{names[1]}` int"))


def fit(docs: DataFrame, labels: DataFrame, p: SubwordClassifier = SubwordClassifier(), parts: int = 5, held: int = 0) -> Trained:
    """Train on a bounded sample of the labelled documents that are not in the held-out fold."""
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").filter(train_fold("doc_id", parts) != held)
    chosen = bounded_sample(known.select("doc_id", "quality"), "quality", p.per_class)
    texts = docs.filter(F.octet_length("text") <= p.max_bytes).select("doc_id", "text")
    # of several texts under one id the one with the least hash: no more texts than chosen labels, each of max_bytes at most
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(one).toPandas()
    rows = rows.sort_values(["doc_id", "quality", "text"])
    return train(rows.text.tolist(), rows.quality.tolist(), p)


def classify(docs: DataFrame, labels: DataFrame, p: SubwordClassifier = SubwordClassifier(), parts: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    fold = F.coalesce(train_fold("doc_id", parts) == held, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold, "text")
    return score_texts(rows, fit(docs, labels, p, parts, held), p).select("doc_id", "held_out", "score", "predicted")
