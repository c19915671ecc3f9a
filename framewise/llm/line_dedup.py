"""Repeated runs of words, found by winnowing, and their deletion where they come again.

A gram is a run of NOISE words. Of all grams that fit into the first GUARANTEE words from any word on, the
one with the least hash is a fingerprint: two places that share a run of GUARANTEE words or more share a
fingerprint at the same place of the run, whatever the line breaks and punctuation. Each fingerprint's
places are joined with its first place, by (doc_id, place); matches are extended both ways, word by word,
and the later run is deleted; the first of all places stays.

A run whose fingerprints first stand in other contexts is only partly covered by these matches. So each
document also gives the windows of GUARANTEE words that hold a repeated fingerprint and that its matches
leave open, and of equal windows all but the first go as well. That makes the result exact for runs of
GUARANTEE words or more: a word goes if it is in such a run that stands in an earlier place too. (The first
place of a window either is the first place of its fingerprint, and the match extends over it, or it is
itself open: its matches are with earlier places, where the window isn't.) Shorter runs, of NOISE words or
more, go if a fingerprint falls in them.

A word goes with its run, except a line's first or second word where the run begins or ends at it, since
a single word at a line's start often is the same by chance; a line ends at a line feed or at the end of a
sentence.

Only the first place of a fingerprint is joined with the others, never all pairs, and a document has
one row for each of its fingerprints however often they come in it. A place within a run that is deleted
already is extended only if the word before or after that run is equal too; this keeps texts of one line
over and over linear. Documents that are first for many others are copied to as many tasks.

Defined results: white space between words doesn't count in comparing; lines without words go if they
stand within a deleted run; a null text stays null; rows with a null doc_id stay as they are; rows with
equal doc_id and text are one document; other columns stay, but for one named n_deleted in any case, which
is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, adding, batches, encoded, few, fresh, let, materialize, mix64, named, scratch, semi_by_id, without, word_hashes

NOISE, GUARANTEE = 15, 25
#: Matches with one document that go to one task.
MATCHES = 500
_CUT = re.compile(rb"[.!?][ \t]+|[\r\n]+")
#: Of a byte: 1 for a space or tab, 2 for a line feed or carriage return; and whether it ends a sentence.
_KIND = np.array([1 if c in b" \t" else 2 if c in b"\r\n" else 0 for c in range(256)], np.uint8)
_STOP = np.isin(np.arange(256), list(b".!?"))


def line_ends(raw: bytes) -> np.ndarray:
    """Where _CUT's matches end, by runs of bytes of one class: line feeds, and spaces after a mark that ends a sentence."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.empty(0, np.int64)
    kind = _KIND[b]
    bounds = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(b)]])
    start, end = bounds[:-1], bounds[1:]
    own = kind[start]
    return end[(own == 2) | ((own == 1) & (start > 0) & _STOP[b[np.maximum(start - 1, 0)]])]


def _layout(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the words, ends of the lines, each word's line, and which words begin a line; the text's end does so too."""
    blank = np.concatenate([[True], SPACE[np.frombuffer(raw, np.uint8)], [True]])
    spans = np.flatnonzero(blank[1:] != blank[:-1]).reshape(-1, 2)
    ends = np.append(line_ends(raw), len(raw))
    line = np.searchsorted(ends, spans[:, 0], side="right")
    return spans, ends, line, np.append(np.diff(line, prepend=-1) > 0, True)


def _ahead(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The best of so many values from each place on; fewer at the end."""
    x, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        x[:-step] = best(x[:-step], x[step:])
        have += step
    return x


def fingerprints(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the selected grams in several documents at once.

    h: hashes of all words; ends: where each document's words end.
    """
    n = len(h)
    if n < NOISE:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    # hashes of 1, 2, 4, .. words; of NOISE words by two runs that overlap
    g, have = h, 1
    with np.errstate(over="ignore"):
        while have < NOISE:
            step = min(have, NOISE - have)
            g = mix64(g[:-step]) + g[step:]
            have += step
        g = mix64(g)
    m = len(g)
    valid = np.arange(m) + NOISE <= np.repeat(ends, np.diff(ends, prepend=0))[:m]
    # NOISE - 1 places without a gram are between the grams of two documents: no window reaches over them
    window = GUARANTEE - NOISE + 1
    assert window <= NOISE
    g[~valid] = np.iinfo(np.uint64).max
    least = _ahead(g, window, np.minimum)
    least[~valid] = 0
    # a gram is selected if it is the least of some window that holds it
    most = _ahead(least[::-1], window, np.maximum)[::-1]
    chosen = np.flatnonzero(valid & (most == g))
    return chosen, g[chosen]


INDEX = "doc_id long, fp long, gram long, at long, again boolean"


def _known(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("fp"), "text")


def word_index(docs: DataFrame) -> DataFrame:
    """Each distinct fingerprint of a document with its first place and whether it comes again in the
    document; fp is the text's hash."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            h, ends = word_hashes(encoded(batch.column("text")))
            places, grams = fingerprints(h, ends)
            doc = np.searchsorted(ends, places, side="right")
            order = np.lexsort((grams, doc))  # equal ones stay in the order of places
            places, grams, doc = places[order], grams[order], doc[order]
            new = np.append((np.diff(doc) != 0) | (grams[1:] != grams[:-1]), True) if len(doc) else np.empty(0, bool)
            first = np.flatnonzero(np.roll(new, 1))
            doc, again = doc[first], ~new[first]
            at = places[first] - np.concatenate([[0], ends[:-1]])[doc]
            cols = [batch.column(c).take(pa.array(doc)) for c in ("doc_id", "fp")]
            cols += [pa.array(grams[first].view(np.int64)), pa.array(at), pa.array(again)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "fp", "gram", "at", "again"])

    return batches(_known(docs), run, INDEX)


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """How many values from the start on are equal; looks at twice as many each time."""
    n, done, step = min(len(a), len(b)), 0, 32
    while done < n:
        other = a[done : min(done + step, n)] != b[done : min(done + step, n)]
        k = int(other.argmax())
        if other[k]:
            return done + k
        done, step = min(done + step, n), 2 * step
    return n


def _matches(x: np.ndarray, y: np.ndarray, seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of ``x`` that are equal to runs of ``y`` around each (place in x, place in y)."""
    runs: list[tuple[int, int]] = []
    own = np.full(len(x), -1)
    for at, at0 in seeds:
        if own[at] >= 0:
            a, b = runs[own[at]]
            before, after = at0 - (at - a) - 1, at0 + (b - at)
            if not (a > 0 and before >= 0 and x[a - 1] == y[before]) and not (b < len(x) and after < len(y) and x[b] == y[after]):
                continue
        back, on = _same(x[:at][::-1], y[:at0][::-1]), _same(x[at:], y[at0:])
        if on >= NOISE:  # else only the grams' hashes are equal
            own[at - back : at + on] = len(runs)
            runs.append((at - back, at + on))
    return runs


def _open(h: np.ndarray, ends: np.ndarray, places: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of GUARANTEE words that hold a gram at one of the places and that no run covers.

    h: hashes of all words of several texts; ends: where each text's words end; runs: (start, end) rows.
    """
    inside, covered = np.zeros(len(h) + 1, bool), np.zeros(len(h) + 2, np.int32)
    begin = np.concatenate([[0], ends])[np.searchsorted(ends, places, side="right")]
    for back in range(GUARANTEE - NOISE + 1):
        inside[np.maximum(places - back, begin)] = True
    np.add.at(covered, runs[:, 0], 1)
    np.add.at(covered, np.maximum(runs[:, 1] - GUARANTEE + 1, runs[:, 0]), -1)
    s = np.flatnonzero(inside & (np.cumsum(covered[:-1]) == 0))
    s = s[s + GUARANTEE <= np.concatenate([ends, [0]])[np.searchsorted(ends, s, side="right")]]
    with np.errstate(over="ignore"):
        w = h[s]
        for k in range(1, GUARANTEE):
            w = mix64(w) + h[s + k]
    return s, mix64(w)


def _seeds(rows: DataFrame) -> DataFrame:
    """(doc_id, fp, d0, f0, seeds): the repeated grams of each document, by the document where they stand first.

    Most grams stand in one place: they are left out before anything is sorted, and what stays is written, so
    that a common gram's rows can be dealt to several tasks where they meet its first place.
    """
    place = F.struct("doc_id", "fp", "at")
    ends = [f(c).alias(f"{name}_{c}") for c in ("doc_id", "fp", "at") for name, f in (("least", F.min), ("most", F.max))]
    places = rows.groupBy("gram").agg(*ends, F.max(F.col("again").cast("int")).alias("r"))  # numbers only, so nothing is sorted
    several = places.filter("least_doc_id < most_doc_id OR least_fp < most_fp OR least_at < most_at OR r > 0").select("gram").hint("shuffle_hash")
    kept = materialize(rows.join(several, "gram"), "line-dedup-repeated")  # by rows of one gram each; an inner join reads the same exchange
    first = kept.groupBy("gram").agg(F.min(place).alias("p"))
    later = kept.join(first, "gram").filter((place > F.col("p")) | F.col("again"))
    anchor = [F.col("p.doc_id").alias("d0"), F.col("p.fp").alias("f0")]
    return later.groupBy("doc_id", "fp", *anchor).agg(F.collect_set(F.struct("gram", F.col("p.at").cast("int").alias("at0"))).alias("seeds"))


FOUND = "doc_id long, fp long, starts array<long>, stops array<long>, windows array<long>, places array<long>"


def _extended(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """FOUND: starts and ends of the runs of each pair of documents, and the open windows' hashes and places."""

    def extend(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, y = None, np.empty(0, np.uint64)  # the document that is first for the rows before
        for batch in it:
            if not batch.num_rows:
                continue
            h, ends = word_hashes(encoded(batch.column("text")))
            at, grams = fingerprints(h, ends)
            upto = np.searchsorted(at, ends)
            begin, low = np.concatenate([[0], ends]), np.concatenate([[0], upto])
            found, repeated = [np.empty((0, 2), np.int64)], [np.empty(0, np.int64)]
            names = [*zip(*(batch.column(c).to_pylist() for c in ("d0", "f0", "doc_id", "fp")), strict=True)]
            # the first documents of these rows, each once where it comes several times in a row
            fresh_ = [k for k, x in enumerate(names) if x[:2] != (names[k - 1][:2] if k else last)]
            h0, ends0 = word_hashes(encoded(batch.column("text0").take(pa.array(fresh_, pa.int64()))))
            firsts = iter(np.split(h0, ends0[:-1]) if len(fresh_) else [])
            for k, (d0, f0, d, f) in enumerate(names):
                if (d0, f0) != last:
                    last, y = (d0, f0), next(firsts)
                pairs = batch.column("seeds")[k].values
                known, at0 = (pairs.field(c).to_numpy() for c in ("gram", "at0"))
                order = np.argsort(known)
                known, at0 = known[order], at0[order]
                g = grams[low[k] : low[k + 1]].view(np.int64)
                i = np.minimum(np.searchsorted(known, g), len(known) - 1)
                on = known[i] == g
                places, first = at[low[k] : low[k + 1]][on] - begin[k], at0[i[on]]
                repeated.append(places + begin[k])
                if (d, f) == last:
                    places, first = places[places > first], first[places > first]
                runs = _matches(h[begin[k] : begin[k + 1]], y, list(zip(places.tolist(), first.tolist(), strict=True)))
                found.append(np.array(runs, np.int64).reshape(-1, 2) + begin[k])
            runs = np.concatenate(found)
            s, windows = _open(h, ends, np.concatenate(repeated), runs)
            of_run, of_window = (np.searchsorted(ends, x, side="right") for x in (runs[:, 0], s))
            lists = [(of_run, runs[:, 0] - begin[of_run]), (of_run, runs[:, 1] - begin[of_run]), (of_window, windows.view(np.int64)), (of_window, s - begin[of_window])]
            cols = [batch.column("doc_id"), batch.column("fp")]
            cols += [pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(ends) + 1)), pa.int32()), pa.array(v, pa.int64())) for row, v in lists]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "fp", "starts", "stops", "windows", "places"])

    # only documents in pairs are dealt out, and of these only those that are first for others once more
    firsts = seeds.select(F.col("d0").alias("doc_id")).distinct()
    texts = semi_by_id(_known(docs), seeds.select("doc_id").unionByName(firsts).distinct()).dropDuplicates(["doc_id", "fp"])
    # of a document that is first for many others there is a copy for every MATCHES of them
    busy = seeds.groupBy("d0", "f0").agg(F.ceil(F.count(F.lit(1)) / F.lit(MATCHES)).cast("int").alias("parts"))
    busy = busy.filter("parts > 1")
    busy = F.broadcast(busy) if few(busy) else busy  # 20 bytes each
    dealt = seeds.join(busy, ["d0", "f0"], "left").withColumn("part", F.pmod(F.xxhash64("doc_id", "fp"), F.coalesce("parts", F.lit(1)))).drop("parts")
    first = semi_by_id(texts, firsts).select(F.col("doc_id").alias("d0"), F.col("fp").alias("f0"), F.col("text").alias("text0")).join(busy, ["d0", "f0"], "left")
    first = first.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1).cast("array<long>"))).drop("parts")
    pairs = dealt.join(texts, ["doc_id", "fp"]).join(first, ["d0", "f0", "part"])
    return batches(pairs.select("doc_id", "fp", "d0", "f0", "seeds", "text", "text0"), extend, FOUND)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, runs): the later runs, as (start, end) numbers of words, end exclusive."""
    # one exchange, for the grams' places and for the join with them: the filter is what the join would infer on one side
    rows = word_index(docs).filter("gram IS NOT NULL AND doc_id IS NOT NULL AND fp IS NOT NULL").repartition("gram")
    seeds = materialize(_seeds(rows), "line-dedup-seeds")
    found = materialize(_extended(docs, seeds), "line-dedup-matches")
    place = F.struct("doc_id", "fp", "start")
    open_ = found.select("doc_id", "fp", F.explode(F.arrays_zip("windows", "places")).alias("w"))
    open_ = open_.select("doc_id", "fp", F.col("w.windows").alias("window"), F.col("w.places").alias("start"))
    first = open_.groupBy("window").agg(F.min(place).alias("p"), F.max(place).alias("q")).filter("p < q").select("window", "p")
    again = open_.join(first, "window").filter(place > F.col("p"))
    more = again.groupBy("doc_id", "fp").agg(let(F.array_sort(F.collect_set("start")), _joined).alias("runs"))
    runs = F.zip_with("starts", "stops", lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    both = found.filter(F.size("starts") > 0).select("doc_id", "fp", runs.alias("runs")).unionByName(more)
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list("runs"))))
    return both.groupBy("doc_id", "fp").agg(every.alias("runs")).withColumn("runs", _merged("runs"))


def _merged(runs: str) -> Column:
    """Sorted runs, those that overlap or meet as one."""

    def add(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        return F.when(r["start"] > last["end"], F.concat(done, F.array(r))).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer)))

    return F.aggregate(F.slice(runs, 2, 1 << 30), F.slice(runs, 1, 1), add)


def _joined(starts: Column) -> Column:
    """Runs of the windows of GUARANTEE words with these starts, ascending; those that overlap or meet are one."""
    first = F.filter(starts, lambda x, k: (k == 0) | (x > F.get(starts, k - 1) + GUARANTEE))
    last = F.filter(starts, lambda x, k: (k == F.size(starts) - 1) | (F.get(starts, k + 1) > x + GUARANTEE))
    return F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), (b + GUARANTEE).alias("end")))


def cut_runs(raw: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The text without the runs of words, and how many words that takes out."""
    spans, ends, line, opens = _layout(raw)
    second = np.concatenate([[False], opens[:-1]]) & ~opens  # a line's second word
    edge = np.zeros(len(spans) + 1, np.int64)
    for a, b in runs:
        edge[a] += 1
        edge[b] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    kept, at, count = [], 0, 0
    for a, b in np.flatnonzero(np.diff(gone, prepend=False, append=False)).reshape(-1, 2).tolist():
        a, b = a + bool(second[a]), b - bool(second[b])
        if b - a < NOISE:
            continue
        count += b - a
        high = int(ends[line[b - 1]]) if opens[b] else int(spans[b, 0])
        if opens[a]:
            low = int(ends[line[a] - 1]) if line[a] else 0
        else:  # what stands before the run in its line keeps the white space after the run
            low, high = int(spans[a - 1, 1]), int(spans[b - 1, 1])
        kept.append(raw[at:low])
        at = high
    return b"".join([*kept, raw[at:]]), count


def dedup_lines(docs: DataFrame, count: str = "n_deleted") -> DataFrame:
    """``docs`` with later repeated runs taken out of ``text``, and n_deleted, or another ``count``: how many words went."""
    id_, fp, runs, gone = fresh(docs.columns, "_id", "_fp", "_runs", "_gone")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cut = batch.column(runs).is_valid()  # other texts pass as they are
            texts, counts = [], np.zeros(batch.num_rows, np.int64)
            for k in np.flatnonzero(cut.to_numpy(zero_copy_only=False)):
                raw = batch.column("text")[k].as_py().encode("utf-8", "surrogatepass")
                raw, counts[k] = cut_runs(raw, [(c["start"], c["end"]) for c in batch.column(runs)[k].as_py()])
                texts.append(raw.decode("utf-8", "surrogatepass"))
            text = pc.replace_with_mask(batch.column("text"), cut, pa.array(texts, pa.string()))
            names = [c for c in batch.schema.names if c not in ("text", runs)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), text, pa.array(counts)], [*names, "text", gone])

    with scratch() as keep:
        found = keep(materialize(repeated_runs(docs).toDF(id_, fp, runs), "line-dedup-runs"))
    size = found.agg(F.sum(F.size(runs))).first()[0] or 0
    # 24 bytes for each document and 8 for each run, checked; beyond that texts are dealt by id
    if few(found, 400_000) and size <= 1_000_000:
        found = F.broadcast(found)
    same = (F.col("doc_id").cast("long") == F.col(id_)) & (F.xxhash64("text") == F.col(fp))
    joined = docs.join(found, same, "left").drop(id_, fp)
    out = batches(joined, run, adding(joined, ["text", runs], f"text string, `{gone}` long"))
    return out.select(*map(named, without(docs.columns, count)), F.col(gone).alias(count))
