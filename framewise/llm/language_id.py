"""Language identification by prediction by partial matching.

Each language has a byte context tree of order ORDER, as counts of byte runs. A byte's probability is
taken from its longest context in which it was seen, after an escape from each longer context that was
seen without it (method C: a context with n occurrences of d different bytes escapes with d/(n+d)). The
statistics are frozen after training, so a byte's code length depends on its last ORDER bytes only, and
the code length of a whole text is an exact sum, over all its bytes, for every language.

The trees are learned from a bounded sample: at most ``per_language`` texts of each language, of at most
``max_bytes`` bytes each (longer ones don't train; every text is classified whole). Counts are added up
by Spark. ASCII capitals are lower-cased.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if nothing was learned;
on equal code lengths the first language by name wins; repeated rows each get a row; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches, bounded_sample, few, train_fold

ORDER = 4
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes scored at once, and slots of the table of recent byte runs.
CHUNK, SLOTS = 1 << 20, 1 << 18


@dataclass(frozen=True)
class LanguageSample:
    per_language: int = 400
    max_bytes: int = 200_000
    max_languages: int = 200  # more values of lang than that are an error
    language_bytes: int = 4_000_000  # of the chosen texts of a language
    total_bytes: int = 16_000_000  # of those of all languages, which share it; a tree has no more runs than bytes


def _runs(raw: bytes) -> np.ndarray:
    """For each byte of ``raw`` after the first ORDER: it and its ORDER predecessors as one number, itself lowest."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    n = len(b) - ORDER
    code = b[ORDER:].copy()
    for k in range(1, ORDER + 1):
        code |= b[ORDER - k : ORDER - k + n] << np.uint64(8 * k)
    return code


def _padded(text: str) -> bytes:
    return bytes(ORDER) + text.encode("utf-8", "surrogatepass").lower()


class ContextTree:
    """Frozen counts of one language, by order: runs with their counts, contexts with n and d."""

    def __init__(self, runs: np.ndarray, counts: np.ndarray):
        self.orders = []
        for k in range(ORDER + 1):
            kept = runs & np.uint64((1 << (8 * (k + 1))) - 1)
            gram, inv = np.unique(kept, return_inverse=True)
            n = np.bincount(inv, counts, len(gram))
            context, at = np.unique(gram >> np.uint64(8), return_inverse=True)
            self.orders.append((gram, n, context, np.bincount(at, n, len(context)), np.bincount(at, minlength=len(context))))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code lengths in bits of the last byte of each run."""
        p = np.full(len(codes), 1 / 256)
        for k, (gram, n, context, total, kinds) in enumerate(self.orders):
            own = codes & np.uint64((1 << (8 * (k + 1))) - 1)
            c = np.minimum(np.searchsorted(context, own >> np.uint64(8)), len(context) - 1)
            seen = context[c] == own >> np.uint64(8)
            g = np.minimum(np.searchsorted(gram, own), len(gram) - 1)
            room = total[c] + kinds[c]
            here = np.where(gram[g] == own, n[g] / room, p * kinds[c] / room)
            p = np.where(seen, here, p)
        return -np.log2(p)


def learn(docs: DataFrame, sample: LanguageSample = LanguageSample(), parts: int = 5, held: int = 0) -> dict[str, ContextTree]:
    """A tree for each value of ``lang``, from documents that are not in the held-out fold; ValueError if there are too many."""
    languages = docs.select("lang").filter("lang IS NOT NULL").distinct()
    if not few(languages, sample.max_languages):
        raise ValueError(f"lang has more than {sample.max_languages} values")

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                by.setdefault(lang, []).append(_runs(_padded(text.as_py())))
            for lang, found in by.items():
                run, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(run)), pa.array(run.view(np.int64)), pa.array(n)], ["lang", "run", "n"])

    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").filter(train_fold("doc_id", parts) != held)
    known = known.filter(F.octet_length("text").between(1, sample.max_bytes)).select("doc_id", "lang", "text")
    chosen = bounded_sample(known, "lang", sample.per_language)
    share = min(sample.language_bytes, sample.total_bytes // max(1, languages.count()))
    # in the sample's order, as many texts as have room; the sample's bound is the window's
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "text"))
    chosen = chosen.withColumn("upto", upto).filter(F.col("upto") <= share).select("lang", "text")
    counts = batches(chosen, count, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))
    table = counts.toPandas()  # no more rows than total_bytes
    return {k: ContextTree(g.run.to_numpy().view(np.uint64), g.n.to_numpy(float)) for k, g in table.sort_values("lang").groupby("lang")}


class CodeLengths:
    """Code lengths of whole texts in every language; recent byte runs are remembered in a fixed table."""

    def __init__(self, trees: dict[str, ContextTree]):
        self.trees = list(trees.values())
        self.keys = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
        self.bits = np.zeros((SLOTS, len(self.trees)), np.float32)

    def of_runs(self, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            slot = (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)
        missed = np.flatnonzero(self.keys[slot] != codes)
        out = None
        if len(missed):
            new, inv = np.unique(codes[missed], return_inverse=True)
            bits = np.stack([t.bits(new) for t in self.trees], 1).astype(np.float32)
            with np.errstate(over="ignore"):
                at = (new * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)
            out = self.bits[slot]
            out[missed] = bits[inv]
            self.keys[at], self.bits[at] = new, bits
            # two new runs may share a slot: numpy keeps the last row of both assignments
            return out
        return self.bits[slot]

    def texts(self, texts: list[str]) -> np.ndarray:
        """(text, language) code lengths in bits."""
        out = np.zeros((len(texts), len(self.trees)))
        rows, pieces, size = [], [], 0

        def flush() -> None:
            codes = np.concatenate(pieces)
            first = np.cumsum([0, *(len(x) for x in pieces[:-1])])
            np.add.at(out, rows, np.add.reduceat(self.of_runs(codes).astype(np.float64), first))

        for k, text in enumerate(texts):
            raw = _padded(text)
            for at in range(0, len(raw) - ORDER, CHUNK):  # a long text in several pieces, each with its context
                pieces.append(_runs(raw[at : at + CHUNK + ORDER]))
                rows.append(k)
                size += len(pieces[-1])
                if size >= CHUNK:
                    flush()
                    rows, pieces, size = [], [], 0
        if rows:
            flush()
        return out


def identify(docs: DataFrame, trees: dict[str, ContextTree], parts: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred and score: the language's posterior under equal priors."""
    names = list(trees)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = CodeLengths(trees)
        for batch in it:
            texts = batch.column("text").to_pylist()
            lettered = [k for k, t in enumerate(texts) if t and _LETTER.search(t)]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if names and lettered:
                bits = coder.texts([texts[k] for k in lettered])
                best = bits.argmin(axis=1)
                least = bits.min(axis=1, keepdims=True)
                score[lettered] = 1 / np.exp2(np.maximum(least - bits, -1000)).sum(axis=1)
                for k, b in zip(lettered, best, strict=True):
                    lang[k] = names[b]
            cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(lang), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "lang_pred", "score"])

    fold = F.coalesce(train_fold("doc_id", parts) == held, F.lit(False)).alias("held_out")
    return batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold, "text"), run, "doc_id long, held_out boolean, lang_pred string, score double")
