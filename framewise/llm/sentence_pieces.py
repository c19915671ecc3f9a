"""SentencePiece encoding with seeded merge-dropout, and decoding.

A text is cut into units where a space follows another character, since no piece of such a vocabulary
goes on past that. Within a unit an agenda holds the candidate merges of neighbours, by the score of the
piece they make and then from the left. A candidate that comes up is skipped, for good, if the keyed hash
of (seed, variant, place, piece) falls below the dropout rate. The variant is a hash of the document's id
and the unit's place in the text, so each place of each document is segmented on its own, and the same
seed always gives the same result. Tasks remember the merges of units without dropout, which hold
wherever none of them is skipped; elsewhere the agenda is run. Characters that the vocabulary lacks,
the space mark itself among them, become byte pieces, so that decoding gives back every text.

Defined results: a null text has null ids and decodes to null; an empty text has no ids and decodes to
itself; repeated rows each get a row; the hash of a null doc_id is the text's; other columns stay; an empty table
gives no rows.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import adding, batches, without

SPACE = "▁"
#: The vocabulary that queries use where the session doesn't name one by SETTING.
MODEL, SETTING = "/opt/tokenizers/piece_bpe_32k.model", "framewise.sentencepiece.model"


@dataclass(frozen=True)
class Dropout:
    rate: float = 0.1
    seed: int = 13


@dataclass(frozen=True)
class Pieces:
    """A vocabulary. Symbols are numbered by rank: best score first, then by id, as merges are done.

    symbols: rank of each single character; merges: rank of the piece that two neighbouring symbols
    make, by ``left << 32 | right``; ids: each rank's id; bytes_: ids of byte pieces; raw: each id's bytes.
    """

    symbols: dict[str, int]
    merges: dict[int, int]
    ids: tuple[int, ...]
    bytes_: tuple[int, ...]
    raw: tuple[bytes, ...]
    unit: str

    @staticmethod
    def load(path: str = MODEL) -> "Pieces":
        """Read on the driver; tasks get it with their code."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        scores, ids, by, raw = {}, {}, [0] * 256, []
        for k in range(sp.get_piece_size()):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                by[int(piece[3:5], 16)] = k
                raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k):
                raw.append(b"")
            else:
                ids[piece], scores[piece] = k, sp.get_score(k)
                raw.append(piece.replace(SPACE, " ").encode())
        if any(SPACE in p.lstrip(SPACE) for p in ids) or 0 in by[1:]:
            raise ValueError("the vocabulary has pieces across spaces, or no byte pieces")
        if not all(c in ids for p in ids for c in p):
            raise ValueError("the vocabulary lacks a character of one of its pieces")
        order = sorted(ids, key=lambda p: (-scores[p], ids[p]))
        rank = {p: k for k, p in enumerate(order)}
        merges = {rank[p[:k]] << 32 | rank[p[k:]]: rank[p] for p in order for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank}
        symbols = {" " if p == SPACE else p: k for p, k in rank.items() if len(p) == 1}
        # a line feed that no longer piece has can be a unit of its own
        feed = any("\n" in p and len(p) > 1 for p in ids)
        unit = r" *[^ ]+| +" if feed else r" *[^ \n]+| +|\n"
        return Pieces(symbols, merges, tuple(ids[p] for p in order), tuple(by), tuple(raw), unit)


#: Longer units have their agenda in a heap; shorter ones are merged many at once. The merges are the same.
SHORT = 32
#: Texts that are segmented together.
TEXTS = 500
_NONE = np.int64(1 << 40)


_LOW = 0xFFFFFFFF


def _mixed(h):
    """A hash of 32-bit values; numbers or arrays of such."""
    h = (h ^ (h >> 15)) * 0x2C1B3C6D & _LOW
    return (h ^ (h >> 12)) * 0x297A2D39 & _LOW


def _key(variant, drop: Dropout):
    return _mixed((variant + (drop.seed * 1_000_003 & _LOW)) & _LOW)


def _candidate(start, made):
    """A candidate's part of the keyed hash; start is its place in the unit, made the piece's rank. Numbers or arrays."""
    h = (start * 0x9E3779B1 + made * 0x85EBCA77) & _LOW
    return h.astype(np.uint32) if isinstance(h, np.ndarray) else h


def _skipped(key, candidate, limit: int):
    """The candidate's keyed hash is below the limit. Numbers or arrays."""
    return _mixed(key ^ candidate) < limit


def _merged(symbols: list[int], merges: dict[int, int], key: int, limit: int) -> tuple[list[int], list[int]]:
    """Symbols and their starts. Entries are (rank, start, left, right); one is stale if its symbols have changed."""
    n = len(symbols)
    live, after, before = symbols[:], list(range(1, n + 1)), list(range(-1, n - 1))
    agenda: list[tuple[int, int, int, int]] = []

    def propose(a: int, b: int) -> None:
        if a >= 0 and b < n and (made := merges.get(live[a] << 32 | live[b])) is not None:
            heapq.heappush(agenda, (made, a, live[a], live[b]))

    for k in range(n - 1):
        propose(k, k + 1)
    gone = -2
    while agenda:
        made, a, left, right = heapq.heappop(agenda)
        b = after[a]
        if live[a] != left or b >= n or live[b] != right or (limit and _skipped(key, _candidate(a, made), limit)):
            continue
        live[a], live[b], after[a] = made, gone, after[b]
        if after[b] < n:
            before[after[b]] = a
        propose(before[a], a)
        propose(a, after[a])
    starts = [k for k in range(n) if live[k] != gone]
    return [live[k] for k in starts], starts


def segment(unit: str, variant: int, pieces: Pieces, drop: Dropout) -> tuple[int, ...]:
    """Ids of one unit."""
    symbols = [pieces.symbols.get(c, -1) for c in unit]  # -1: not in the vocabulary, in no merge
    limit = int(drop.rate * 2**32)
    return _ids(unit, *_merged(symbols, pieces.merges, _key(variant, drop), limit), pieces)


def _packed(ids: tuple[int, ...]) -> bytes:
    """The bytes of 32-bit ids, a third of a tuple's size."""
    return np.array(ids, np.int32).tobytes()


def _ids(unit: str, merged: list[int], starts: list[int], pieces: Pieces) -> tuple[int, ...]:
    out: list[int] = []
    for x, at in zip(merged, starts, strict=True):
        if x >= 0:
            out.append(pieces.ids[x])
        else:
            out += (pieces.bytes_[byte] for byte in unit[at].encode("utf-8", "surrogatepass"))
    return tuple(out)


class _PairRanks:
    """Ranks of pairs for whole arrays: hash tables in a cascade, each holding what collided in the one before."""

    BITS = 19

    def __init__(self, merges: dict[int, int]):
        keys, values = np.array(list(merges), np.uint64), np.array(list(merges.values()), np.int64)
        self.levels = []
        rng = np.random.default_rng(1)
        while len(keys):
            factor = rng.integers(1, 2**62, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            held, ranks = np.full(1 << self.BITS, np.iinfo(np.uint64).max), np.full(1 << self.BITS, _NONE)
            at = self._slot(keys, factor)
            held[at], ranks[at] = keys, values
            self.levels.append((factor, held, ranks))
            rest = held[at] != keys
            keys, values = keys[rest], values[rest]

    def _slot(self, keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * factor) >> np.uint64(64 - self.BITS)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """_NONE where the two symbols make no piece."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64) & np.uint64(0xFFFFFFFF)
        out = np.full(keys.shape, _NONE)
        for factor, held, ranks in self.levels:
            at = self._slot(keys, factor)
            out = np.where(held[at] == keys, ranks[at], out)
        return out


class Segmenter:
    """Segmentations of units. Those without dropout are remembered with their merges, up to ``limit`` units; then memory starts anew."""

    def __init__(self, pieces: Pieces, drop: Dropout, limit: int = 300_000):
        self.pieces, self.drop, self.limit = pieces, drop, limit
        self.units = re.compile(pieces.unit).findall
        self.pairs, self.ids_of = _PairRanks(pieces.merges), np.array(pieces.ids, np.int32)
        self.table = np.full(0x110000, -1, np.int64)
        for c, k in pieces.symbols.items():
            self.table[ord(c)] = k
        self._forget()

    def _forget(self) -> None:
        """number: each short unit's; ids and merges: the lists of all units, one after another, with their ends from 0 on."""
        self.number: dict[str, int] = {}
        self.ids_store, self.ids_ends = array("i"), array("q", [0])
        self.merge_store, self.merge_ends = array("I"), array("q", [0])

    def _many(self, units: list[str], variant: int | np.ndarray, merges: list[bytes] | None = None) -> list[bytes]:
        """Packed ids of short units. One step takes the best candidate of every unit and merges or skips it.

        With a list for ``merges`` there is no dropout, and each unit's candidates are put there.
        """
        key = _key(np.broadcast_to(np.asarray(variant, np.uint32), len(units)), self.drop)
        order = np.argsort([len(u) for u in units], kind="stable")
        out = [b""] * len(units)
        for part in np.array_split(order, max(1, len(order) // 5_000)):
            self._block([units[k] for k in part], key[part], part.tolist(), out, merges)
        return out

    def _block(self, units: list[str], key: np.ndarray, places: list[int], out: list[bytes], merges: list[bytes] | None) -> None:
        n, width = np.array([len(u) for u in units]), max(map(len, units))
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        # symbols stay at the place of their first character; -1 is not in the vocabulary, -2 is merged away or
        # no symbol. The last column stands for what is before the first and after the last symbol.
        sym = np.full((len(units), width + 1), -2)
        sym[np.arange(width + 1) < n[:, None]] = self.table[codes]
        after = np.broadcast_to(np.arange(1, width + 2), sym.shape).copy()
        before = np.broadcast_to(np.arange(-1, width), sym.shape).copy()
        rank = np.full(sym.shape, _NONE)
        rank[:, :-1] = self.pairs.get(sym[:, :-1], sym[:, 1:])
        limit = 0 if merges is not None else int(self.drop.rate * 2**32)
        done: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.uint32))]
        row = np.arange(len(units))
        while len(row):
            now = rank[row]
            k = now.argmin(axis=1)
            made = now[np.arange(len(row)), k]
            open_ = made != _NONE
            row, k, made = row[open_], k[open_], made[open_]
            skip = _skipped(key[row], _candidate(k, made), limit) if limit else np.zeros(len(row), bool)
            rank[row[skip], k[skip]] = _NONE
            r, k, made = row[~skip], k[~skip], made[~skip]
            if merges is not None:
                done.append((r, _candidate(k, made)))
            b = after[r, k]
            c = after[r, b]
            sym[r, k], sym[r, b], rank[r, b] = made, -2, _NONE
            after[r, k], before[r, c] = c, k
            rank[r, k] = self.pairs.get(made, sym[r, c])
            p = before[r, k]
            rank[r, p] = self.pairs.get(sym[r, p], made)
        live = sym > -2
        ends = (4 * np.cumsum(live.sum(axis=1))).tolist()
        flat = self.ids_of[np.maximum(sym[live], 0)].tobytes()
        unknown = (sym == -1).any(axis=1).tolist()
        begin = 0
        for i, (place, end) in enumerate(zip(places, ends, strict=True)):
            if unknown[i]:
                at = np.flatnonzero(live[i])
                out[place] = _packed(_ids(units[i], sym[i, at].tolist(), at.tolist(), self.pieces))
            else:
                out[place] = flat[begin:end]
            begin = end
        if merges is not None:
            of, cand = (np.concatenate(x) for x in zip(*done))
            order = np.argsort(of, kind="stable")
            upto = (np.searchsorted(of[order], np.arange(len(units) + 1)) * 4).tolist()
            packed = cand[order].tobytes()
            for place, a, b in zip(places, upto, upto[1:]):
                merges[place] = packed[a:b]

    def _learn(self, units: list[str]) -> None:
        merges = [b""] * len(units)
        ids = self._many(units, 0, merges)
        for packed, store, ends in ((ids, self.ids_store, self.ids_ends), (merges, self.merge_store, self.merge_ends)):
            ends.extend((ends[-1] + np.cumsum([len(x) // 4 for x in packed])).tolist())
            store.frombytes(b"".join(packed))

    def ids(self, texts: list[str], firsts: list[int]) -> list[np.ndarray]:
        """Ids of whole texts; firsts: the hash of each text's document."""
        if len(self.number) > self.limit:
            self._forget()
        split = [self.units(t) for t in texts]
        sizes = np.array([len(u) for u in split], np.int64)
        units = [u for own in split for u in own]
        ends = np.cumsum(sizes)
        place = np.arange(len(units)) - np.repeat(ends - sizes, sizes)
        variant = _mixed(((np.repeat(np.array(firsts, np.int64), sizes) + place * 0x9E3779B1) & _LOW).astype(np.uint32))
        known = self.number
        if new := [u for u in set(units) if u not in known and len(u) <= SHORT]:
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self._learn(new)
        # the last number stands for long units, which have neither merges nor ids yet
        number = np.fromiter(map(known.get, units, repeat(len(known))), np.int64, len(units))
        start, length = self._lists(self.ids_ends, number)
        limit = int(self.drop.rate * 2**32)
        again = np.empty(0, np.int64)
        if limit:
            at, counts = self._lists(self.merge_ends, number)
            upto = np.cumsum(counts)
            cand = np.frombuffer(self.merge_store, np.uint32)[np.repeat(at - upto + counts, counts) + np.arange(counts.sum())]
            skip = np.flatnonzero(_skipped(np.repeat(_key(variant, self.drop), counts), cand, limit))
            again = np.unique(np.searchsorted(upto, skip, side="right"))
        long_ = np.flatnonzero(number == len(known))
        made = self._many([units[k] for k in again.tolist()], variant[again]) if len(again) else []
        made += [_packed(segment(units[k], int(variant[k]), self.pieces, self.drop)) for k in long_.tolist()]
        own, sizes_own = np.concatenate([again, long_]), np.array([len(x) // 4 for x in made], np.int64)
        start[own], length[own] = len(self.ids_store) + np.cumsum(sizes_own) - sizes_own, sizes_own
        store = np.concatenate([np.array(self.ids_store, np.int32), np.frombuffer(b"".join(made), np.int32)])
        upto = np.cumsum(length)
        flat = store[np.repeat(start - upto + length, length) + np.arange(length.sum())]
        cut = np.concatenate([[0], upto])[np.concatenate([[0], ends])].tolist()
        return [flat[a:b] for a, b in zip(cut, cut[1:])]

    @staticmethod
    def _lists(ends: array, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the lists with these numbers; the one after the last is empty."""
        ends = np.array(ends, np.int64)
        ends = np.append(ends, ends[-1])
        return ends[number], np.diff(ends)[number]


def session_pieces(spark: SparkSession) -> Pieces:
    return Pieces.load(spark.conf.get(SETTING, MODEL))


def text_of(ids: np.ndarray, pieces: Pieces) -> bytes:
    return b"".join(map(pieces.raw.__getitem__, ids.tolist()))


def encode(docs: DataFrame, pieces: Pieces, drop: Dropout = Dropout(), check: bool = False) -> DataFrame:
    """``docs`` with ``ids``; with ``check`` also ``lossless``: whether they decode to the text. They replace columns with such names in any case."""
    made = ["ids", "lossless"] if check else ["ids"]
    names = without(docs.columns, *made)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(pieces, drop)
        for batch in it:
            texts = batch.column("text").to_pylist()
            named = zip(batch.column("doc_id").to_pylist(), texts, strict=True)
            firsts = [zlib.crc32(((t or "") if d is None else str(d)).encode("utf-8", "surrogatepass")) for d, t in named]
            rows: list[np.ndarray | None] = []
            for at in range(0, len(texts), TEXTS):
                rows += segmenter.ids([t or "" for t in texts[at : at + TEXTS]], firsts[at : at + TEXTS])
            rows = [None if t is None else r for t, r in zip(texts, rows, strict=True)]
            ends = np.cumsum([0, *(0 if r is None else len(r) for r in rows)])
            flat = np.concatenate([np.empty(0, np.int32), *(r for r in rows if r is not None)])
            mask = pa.array([r is None for r in rows], pa.bool_())
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=mask)
            cols = [*(batch.column(c) for c in names), ids]
            if check:
                same = (t is None or text_of(r, pieces) == t.encode("utf-8", "surrogatepass") for t, r in zip(texts, rows, strict=True))
                cols.append(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays(cols, [*names, *made])

    gone = [c for c in docs.columns if c not in names]
    return batches(docs, run, adding(docs, gone, "ids array<int>" + ", lossless boolean" * check))


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """``encoded`` with ``decoded``: the text of ``ids``."""
    names = without(encoded.columns, "decoded")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = (text_of(ids.values.to_numpy(), pieces) if ids.is_valid else None for ids in batch.column("ids"))
            texts = [None if x is None else x.decode("utf-8", "surrogatepass") for x in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], [*names, "decoded"])

    return batches(encoded, run, adding(encoded, [c for c in encoded.columns if c not in names], "decoded string"))
