"""Packing of tokenized documents into sequences by vector best-fit.

A sequence has three capacities: tokens, documents, and the cost of attention within its documents (the pairs
of a token and one at or before it). Pieces are placed by falling length, a piece into the sequence that fits
best among those with room for it under every capacity: with the rule "norm" the one whose residual
capacities, after the piece, have the least weighted norm; with "dot" the one whose residual capacities have
the largest weighted dot product with what the piece asks for. Residuals are fractions of the capacities. New
sequences open only where no open one has room.

All three demands follow from a piece's length, so pieces of one length are interchangeable, and the packing
of a corpus is worked out from the number of pieces of each length: at most as many numbers as a sequence has
tokens, whatever the size of the corpus. Sequences in one state are handled as one range, and a step fills
each sequence of a range with all that it can take of a length: a run. After that one of its residuals is less
than half of what it was, so a range takes part in few steps (at most the sum of the capacities' binary
logarithms), and a length that comes to its end splits one range in three: the runs grow with the number of
lengths, not of pieces (about 5,000 for 2048 tokens). Every piece finds its run by its length and its rank,
and the rank is its number among those of its length in its task, which the task itself counts, and the pieces
of that length in earlier tasks, a sum over counts. No piece passes through the driver, and no task sees all
pieces of a length or of a document's source.

Tokenizing: the tokenizer's file is read on the driver and goes to the tasks. Where its words never reach over
a space that a visible character follows, texts are cut there, and a worker remembers the ids of the parts.

Defined results: a null or empty text has only the closing id; rows with equal or null doc_id are documents of
their own; a document is cut only where it is longer than a sequence, into full pieces after a first one with
the rest; texts are read whole; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches, few, materialize

#: The vocabulary that queries use where the session doesn't name one by SETTING.
MODEL, SETTING = "/opt/tokenizers/byte_bpe_50k.json", "framewise.bytebpe.model"
#: Closes every document.
END = 0
#: Parts whose ids a worker remembers (about 200 bytes each), and texts that are tokenized together.
PARTS, TEXTS = 500_000, 250
#: Latin letters with marks after them: two units for the tokenizer's model, wherever they stand.
WORD = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([!-&(-/:-@\[-`{-~]{0,8})")
#: What stands for a byte in a byte-level vocabulary: itself if it is visible, else the characters from 256 on in turn.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
AS_CHARACTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


@dataclass(frozen=True)
class Capacity:
    """Of a sequence; None: no more than its tokens allow. weights: of tokens, documents and attention in the rule."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    rule: str = "norm"
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)

    @property
    def vector(self) -> np.ndarray:
        most = cost(self.tokens)
        return np.array([self.tokens, self.documents or self.tokens, self.attention or most], np.int64)


def cost(length: int) -> int:
    """Pairs of a token and one at or before it, in a piece."""
    return length * (length + 1) // 2


class _Known(dict):
    """Ids of parts. Of one that isn't known it gives an empty place, which gets its ids later."""

    def __init__(self) -> None:
        self.places: dict[str, bytearray] = {}

    def __missing__(self, part: str) -> bytearray:
        return self.places.setdefault(part, bytearray())


class Encoder:
    """Ids of texts, as little-endian 32-bit numbers."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks have a core each
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_str(spec), _Known()
        self.model = self.tokenizer.model
        self.words, self.marks = {}, {}
        said = json.loads(spec)
        pre = said.get("pre_tokenizer") or {}
        plain = (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True), said.get("normalizer")) == ("ByteLevel", False, True, None)
        model = said["model"]
        plain &= model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        added = [re.escape(t["content"]) for t in said.get("added_tokens") or []]
        #: Texts that are not cut: with an added token, which takes the spaces around it apart; or all.
        self.whole = re.compile("|".join(added) if added else r"(?!)") if plain else re.compile("")
        self.odd, self.cut = re.compile(r" (?=\s|\Z)"), re.compile(r" (?=\S)")

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        own = [k for k, t in enumerate(texts) if self.whole.search(t)]
        for k, raw in zip(own, self._encoded([texts[k] for k in own]), strict=True):
            out[k] = raw
        # the first part of a text has no space before it; the others do, and are kept without it
        left = [k for k in range(len(texts)) if out[k] is None]
        parts = [self.cut.split(texts[k]) if self.odd.search(texts[k]) else texts[k].split(" ") for k in left]
        heads = self._encoded([p[0] for p in parts])
        for p in parts:
            p[0] = ""
        self.known[""] = b""
        found = [[*map(self.known.__getitem__, p)] for p in parts]
        self._fill()
        for k, head, f in zip(left, heads, found, strict=True):
            out[k] = head + b"".join(f)
        return out

    def _fill(self) -> None:
        """The ids of all parts that have an empty place; they are known from now on, if there is room: what comes early comes often."""
        places, self.known.places = self.known.places, {}
        others = []
        for part, place in places.items():
            if found := WORD.fullmatch(part):
                place += self._word(" ", found[1])
                place += self._marks(found[2])
            elif len(lines := [*map(WORD.fullmatch, part.split("\n"))]) > 1 and all(lines):
                for k, found in enumerate(lines):
                    place += self._marks("\n") + self._word("", found[1]) if k else self._word(" ", found[1])
                    place += self._marks(found[2])
            else:
                others.append(part)
        for part, raw in zip(others, self._encoded([" " + x for x in others]), strict=True):
            places[part] += raw
        if len(self.known) + len(places) <= PARTS:
            self.known.update((part, bytes(place)) for part, place in places.items())

    def _word(self, space: str, word: str) -> bytes:
        if (raw := self.words.get(space + word)) is None:
            raw = self._of_model(space + word)
            if len(self.words) < PARTS:
                self.words[space + word] = raw
        return raw

    def _marks(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) >= PARTS:
                self.marks.clear()
            self.marks[marks] = self._of_model(marks)
        return self.marks[marks]

    def _of_model(self, unit: str) -> bytes:
        """The ids of what is one unit for the model, which sees its bytes as characters."""
        return array("I", [t.id for t in self.model.tokenize(unit.encode().decode("latin-1").translate(AS_CHARACTERS))]).tobytes() if unit else b""


_encoders: dict[int, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """A worker's encoder; it stays for the tasks to come."""
    if hash(spec) not in _encoders:
        _encoders.clear()
        _encoders[hash(spec)] = Encoder(spec)
    return _encoders[hash(spec)]


def session_spec(spark: SparkSession) -> str:
    with open(spark.conf.get(SETTING, MODEL), encoding="utf-8") as f:
        return f.read()


PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, number long"


def token_pieces(docs: DataFrame, spec: str, tokens: int = Capacity.tokens) -> DataFrame:
    """PIECES of every document: ids are little-endian 32-bit numbers, number counts the task's pieces of this length from 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.spark_partition_id().alias("part"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, end, seen = encoder(spec), array("I", [END]).tobytes(), np.zeros(tokens + 1, np.int64)
        for whole in it:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                which, piece, start, cut = [], [], [], []
                for k, raw in enumerate(made.ids(batch.column("text").to_pylist())):
                    raw += end
                    size, a = len(raw) // 4, 0
                    for n in range(-(-size // tokens)):
                        b = a + ((size - 1) % tokens + 1 if n == 0 else tokens)
                        which.append(k), piece.append(n), start.append(a), cut.append(raw[4 * a : 4 * b])
                        a = b
                length = np.array([len(x) // 4 for x in cut], np.int64)
                cols = [batch.column("doc_id").take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length)]
                cols += [pa.array(cut, pa.binary()), batch.column("part").take(pa.array(which, pa.int64())), pa.array(_numbers(length, seen))]
                yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in PIECES.split(", ")])

    return batches(rows, run, PIECES)


def _numbers(length: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The number of each among those of its length, after those seen; they count as seen then."""
    order = np.argsort(length, kind="stable")
    kinds, first, count = np.unique(length[order], return_index=True, return_counts=True)
    out = np.empty(len(length), np.int64)
    out[order] = np.arange(len(length)) - np.repeat(first, count) + np.repeat(seen[kinds], count)
    seen[kinds] += count
    return out


@dataclass(frozen=True)
class Runs:
    """Pieces of a length with ranks from ``rank`` on go to the sequences from ``bin`` on, ``each`` to one, at ``offset``. Sorted by length and rank."""

    length: np.ndarray
    rank: np.ndarray
    each: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces of these lengths and ranks."""
        # lengths are small, ranks below 2^44
        k = np.searchsorted((self.length << 44) + self.rank, (length << 44) + rank, side="right") - 1
        nth = rank - self.rank[k]
        return self.bin[k] + nth // self.each[k], self.offset[k] + nth % self.each[k] * length


def plan(counts: dict[int, int], cap: Capacity = Capacity()) -> Runs:
    """The runs of best-fit over so many pieces of each length."""
    full, weights = cap.vector, np.array(cap.weights, float)
    if cap.rule not in ("norm", "dot"):
        raise ValueError(f"no such rule: {cap.rule}")
    # ranges of sequences in one state: the first, how many, and the residual capacities
    first, many, left = [], [], np.empty((64, 3), np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    total = 0

    def add(b: int, m: int, residual: np.ndarray) -> None:
        nonlocal left
        if m <= 0 or (residual <= 0).any():
            return  # nothing goes there any more
        if len(first) == len(left):
            left = np.concatenate([left, np.empty_like(left)])
        left[len(first)] = residual
        first.append(b), many.append(m)

    for length in sorted(counts, reverse=True):
        todo, rank, want = counts[length], 0, np.array([length, 1, cost(length)], np.int64)
        if (want > full).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while todo > 0:
            open_ = left[: len(first)]
            fits = (open_ >= want).all(axis=1)
            if not fits.any():
                each = int((full // want).min())
                add(total, -(-todo // each), full)
                total += -(-todo // each)
                continue
            at = np.flatnonzero(fits)
            if cap.rule == "norm":
                score = ((((open_[at] - want) / full) ** 2) * weights).sum(axis=1)
                g = int(at[np.argmin(score)])
            else:
                g = int(at[np.argmax((open_[at] / full * (want / full) * weights).sum(axis=1))])
            b, m, residual = first[g], many[g], left[g].copy()
            each = int((residual // want).min())
            bins = min(m, todo // each)
            if bins == 0:  # the last pieces of this length
                each, bins = todo, 1
            runs.append((length, rank, each, b, cap.tokens - int(residual[0])))
            todo, rank = todo - bins * each, rank + bins * each
            many[g], first[g] = m - bins, b + bins
            if many[g] == 0:  # the last range takes its place
                left[g] = left[len(first) - 1]
                first[g], many[g] = first[-1], many[-1]
                first.pop(), many.pop()
            add(b, bins, residual - each * want)
    cols = np.array(runs, np.int64).reshape(-1, 5)
    cols = cols[np.lexsort((cols[:, 1], cols[:, 0]))]
    return Runs(*cols.T, sequences=total)


def place(pieces: DataFrame, cap: Capacity = Capacity()) -> DataFrame:
    """``pieces`` (length, part, number and any others; a written table, since it is read three times) with sequence_id and offset."""
    counts = materialize(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    lengths = counts.groupBy("length").agg(F.sum("n").alias("n"))  # at most as many as a sequence has tokens
    runs = plan({r["length"]: r["n"] for r in lengths.collect()}, cap)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    bases = materialize(bases, "packing-bases")
    ranked = pieces.join(F.broadcast(bases) if few(bases) else bases, ["length", "part"])
    others = [c for c in pieces.columns if c not in ("part", "number")]
    rows = ranked.select(*others, (F.col("base") + F.col("number")).alias("number"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sequence, offset = runs.place(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            cols = [batch.column(c) for c in others] + [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*others, "sequence_id", "offset"])

    schema = rows.drop("number").withColumns({c: F.lit(0).cast("long") for c in ("sequence_id", "offset")}).schema
    return batches(rows, run, schema)


def pack(docs: DataFrame, spec: str, cap: Capacity = Capacity()) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id and offset of every piece of ``docs``."""
    return place(materialize(token_pieces(docs, spec, cap.tokens), "packing-pieces"), cap)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, documents): the sequences themselves, their ids in one binary and each piece's place in it."""
    own = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))  # no more than a sequence holds
    rows = packed.groupBy("sequence_id").agg(own.alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", ids.alias("ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("documents"))


def pack_digest(docs: DataFrame, spec: str, cap: Capacity = Capacity()) -> DataFrame:
    """pack() with the CRC-32 of each piece's ids instead of the ids, which are then written nowhere."""
    rows = token_pieces(docs, spec, cap.tokens)
    rows = rows.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "number")
    return place(materialize(rows, "packing-pieces"), cap)
