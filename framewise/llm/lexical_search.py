"""Ranked lexical search over whole documents by Block-Max WAND.

The index is cut by documents into shards. Of each term a shard has postings (a document's place in the shard
and how often it holds the term) in blocks of a fixed number, compressed as variable-length bytes, and of every block
the first and last document and the maximum impact: the largest score, before the term's weight, that any of its
documents gets. Impacts need the number of documents and their mean length, which are counted first.

A query's terms each point to a block. The pointers move along the documents from one block's bound to the next
without reading any block (shallow moves); between two bounds the weighted maxima of the blocks pointed to
limit every score. Where that limit is below the tenth best score so far, all documents up to the next bound
are skipped. Elsewhere the blocks are decompressed, and a document is a pivot, and is scored in full, only if
the maxima of the terms that it holds reach the tenth best score. All bounds of a shard are lined up at once in
numpy; places that stay open are gone through in the order of documents, in stretches that double. Documents
whose limit equals the threshold are scored, so ties are exact.

A task keeps each query's best documents and threshold from one shard to the next, and the shards of
one task in 32 are searched before the others, which then start with a threshold. Tasks return no more than the best of each
query; ranks are given to these. Queries are dealt in blocks of bounded size, a few to a pass over the index; their
weights come from an aggregate over the shards' terms, so no vocabulary is broadcast or gathered.

Terms are compared by their 64-bit hashes. Defined results: a null or empty text has no terms; rows of equal
doc_id are ranked each on its own; a null doc_id comes after others of equal score; rows with equal item_id are
one query with the terms of all; an item without terms that occur has no rows; other columns are ignored,
whatever their names; empty tables give no rows; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches, encoded, few, list_array, materialize, named, word_hashes

#: Documents that a query returns.
TOP = 10

#: ASCII letters and digits and all other characters make terms; A-Z are lower-cased.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Layout:
    block: int = 64  # postings
    shard_bytes: int = 12_000_000  # of text
    shard_docs: int = 60_000
    seeds: int = 32  # the shards of one task in so many are searched first
    queries: int = 1_000  # of a block of queries, and terms of it, about
    query_terms: int = 200_000
    passes: int = 8  # blocks of queries that go through the index at once


@dataclass(frozen=True)
class Corpus:
    """Documents with terms, and the terms of all with repeats."""

    documents: int
    terms: int

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """The part of the score's divisor that a document's length makes."""
        return 10 + 90 * n * self.documents // max(self.terms, 1)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def corpus(docs: DataFrame) -> Corpus:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in it:
            for raw in encoded(batch.column(0), _TABLE):
                seen = np.frombuffer(b" " + raw, np.uint8) != 32
                k = int(np.count_nonzero(seen[1:] & ~seen[:-1]))
                n, total = n + (k > 0), total + k
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    rows = batches(docs.select("text"), run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return Corpus(*(x or 0 for x in rows))


INDEX = (
    "seed int, block_size int, doc_ids array<long>, lengths array<int>, terms array<long>, counts array<int>, "
    "firsts array<int>, lasts array<int>, maxima array<int>, ends array<int>, postings binary"
)


def varints(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the highest set where more follow; and where each value's bytes end."""
    size = 1 + sum((v >= 1 << s).astype(np.int64) for s in (7, 14, 21, 28))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        on = size > k
        out[(ends - size)[on] + k] = (v[on] >> 7 * k & 127) | np.where(size[on] > k + 1, 128, 0)
    return out, ends


def from_varints(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    size, out = ends - starts + 1, np.zeros(len(ends), np.int64)
    for k in range(int(size.max()) if len(size) else 0):
        on = size > k
        out[on] |= (raw[starts[on] + k].astype(np.int64) & 127) << 7 * k
    return out


def _shard(ids: list[int | None], raws: list[bytes], seed: int, about: Corpus, size: int) -> pa.RecordBatch:
    h, ends = word_hashes(raws)
    n = np.diff(ends, prepend=0)
    order = np.argsort(h, kind="stable")  # a term's documents stay in order
    h, doc = h[order], np.repeat(np.arange(len(raws)), n)[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(at, append=len(h))
    h, doc = h[at], doc[at]
    head = np.ones(len(h), bool)
    head[1:] = h[1:] != h[:-1]
    begin = np.flatnonzero(head)
    counts = np.diff(begin, append=len(h))
    nth = np.arange(len(h)) - np.repeat(begin, counts)
    block = np.flatnonzero(nth % size == 0)
    pairs = np.empty((len(h), 2), np.int64)
    pairs[:, 0], pairs[:, 1] = np.diff(doc, prepend=0), tf - 1
    pairs[block, 0] = 0
    raw, upto = varints(pairs.ravel())
    last = np.append(block[1:], len(h))[: len(block)] - 1
    most = np.maximum.reduceat(impacts(tf, about.lengths(n)[doc]), block) if len(block) else block
    cols = [pa.array([seed], pa.int32()), pa.array([size], pa.int32()), pa.array([ids], pa.list_(pa.int64())), list_array([n.astype(np.int32)], pa.int32()), list_array([h[begin].view(np.int64)], pa.int64())]
    cols += [list_array([x.astype(np.int32)], pa.int32()) for x in (counts, doc[block], doc[last], most, upto[2 * last + 1])]
    return pa.RecordBatch.from_arrays([*cols, pa.array([raw.tobytes()], pa.binary())], [c.split()[0] for c in INDEX.split(", ")])


def build_index(docs: DataFrame, about: Corpus, by: Layout = Layout()) -> DataFrame:
    """INDEX, a row for each shard; terms are in unsigned order, ends are where blocks end in the postings."""
    seed = (F.pmod(F.spark_partition_id(), F.lit(by.seeds)) == 0).cast("int")  # one for a task, so that files without seeds are not read
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", seed.alias("seed"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raws, size, seed = [], [], 0, 0
        for batch in it:
            for i, raw in zip(batch.column("doc_id").to_pylist(), encoded(batch.column("text"), _TABLE), strict=True):
                if raws and (size + len(raw) > by.shard_bytes or len(raws) >= by.shard_docs):
                    yield _shard(ids, raws, seed, about, by.block)
                    ids, raws, size = [], [], 0
                ids.append(i), raws.append(raw)
                size += len(raw)
                seed = batch.column("seed")[0].as_py()
        if raws:
            yield _shard(ids, raws, seed, about, by.block)

    return materialize(batches(rows, run, INDEX), "search-index")


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            h, ends = word_hashes(encoded(batch.column("text"), _TABLE))
            n = np.diff(ends, prepend=0)
            which = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(which), pa.array(h.view(np.int64))], ["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return batches(items.select("item_id", "text"), run, f"item_id {kind}, term long").distinct()


def weighted_queries(terms: DataFrame, index: DataFrame, about: Corpus, by: Layout = Layout()) -> DataFrame:
    """(block, item_id, terms, weights, least); block: which block of queries; least: a score that the tenth best document has at least."""
    terms = materialize(terms, "search-terms")
    own = terms.select("term").distinct()
    own = F.broadcast(own) if few(own) else own  # 8 bytes each
    held = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    df = held.join(own, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    w = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * about.documents + 2) / (2 * F.col("df") + 1))).cast("long")
    rows = terms.join(df, "term").select("item_id", F.struct("term", w.alias("w")).alias("t")).filter("t.w > 0")
    every = F.array_sort(F.collect_list("t"))  # the terms of one item
    rows = materialize(rows.groupBy("item_id").agg(every.alias("t")), "search-queries")
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("t")), F.lit(0))).first()
    blocks = max(1, -(-n // by.queries), -(-size // by.query_terms))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")
    return rows.select(block.alias("block"), "item_id", F.col("t.term").alias("terms"), F.col("t.w").alias("weights"), F.lit(0).cast("long").alias("least"))


@dataclass
class Best:
    """A query's best documents so far."""

    least: int
    scores: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    nulls: np.ndarray = field(default_factory=lambda: np.empty(0, bool))

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray, top: int) -> None:
        s, i, z = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.nulls, nulls)))
        order = np.lexsort((i, z, -s))[:top]
        self.scores, self.ids, self.nulls = s[order], i[order], z[order]
        if len(order) == top:
            self.least = max(self.least, int(self.scores[-1]))


class Shard:
    """A shard's arrays, and the search in it."""

    def __init__(self, row: dict[str, pa.Scalar], about: Corpus):
        of = lambda c: row[c].values.to_numpy()
        ids = row["doc_ids"].values
        self.nulls, self.ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        self.m = about.lengths(of("lengths").astype(np.int64))
        self.terms, counts = of("terms").view(np.uint64), of("counts").astype(np.int64)
        self.first, self.last, self.most = (of(c).astype(np.int64) for c in ("firsts", "lasts", "maxima"))
        self.ends, self.raw = of("ends").astype(np.int64), np.frombuffer(row["postings"].as_buffer(), np.uint8)
        size = row["block_size"].as_py()
        n = -(-counts // size)
        self.blocks = np.concatenate([[0], np.cumsum(n)])  # of each term
        self.sizes = np.full(len(self.first), size)
        self.sizes[self.blocks[1:] - 1] = counts - (n - 1) * size
        self.decoded = 0  # blocks so far

    def look_up(self, terms: np.ndarray) -> np.ndarray:
        """The terms' places in the shard, -1 for those that it lacks."""
        k = np.searchsorted(self.terms, terms)
        if not len(self.terms):
            return np.full(len(terms), -1)
        return np.where(self.terms[np.minimum(k, len(self.terms) - 1)] == terms, k, -1)

    def decompress(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, times, which of the blocks) of the postings."""
        self.decoded += len(blocks)
        start = np.where(blocks > 0, self.ends[blocks - 1], 0)
        size, n = self.ends[blocks] - start, self.sizes[blocks]
        v = from_varints(self.raw[_ranges(start, size)])
        doc = np.cumsum(v[0::2])
        head = np.cumsum(n) - n
        return doc + np.repeat(self.first[blocks] - doc[head], n), v[1::2] + 1, np.repeat(np.arange(len(blocks)), n)

    def search(self, places: np.ndarray, weights: np.ndarray, best: Best, top: int) -> None:
        """Adds to ``best`` what the shard has for the terms at these places."""
        n = self.blocks[places + 1] - self.blocks[places]
        blocks, w = _ranges(self.blocks[places], n), np.repeat(weights, n)
        upper, low, high = w * self.most[blocks], self.first[blocks], self.last[blocks] + 1
        # shallow moves: between two bounds the same blocks are pointed to
        bounds = np.unique(np.concatenate([low, high]))
        change = np.zeros(len(bounds), np.int64)
        np.add.at(change, np.searchsorted(bounds, low), upper)
        np.subtract.at(change, np.searchsorted(bounds, high), upper)
        limit = np.cumsum(change)[:-1]
        todo, stretch = np.flatnonzero(limit >= max(best.least, 1)), 32
        while len(todo):
            now, todo = todo[:stretch], todo[stretch:]
            now, stretch = now[limit[now] >= best.least], 2 * stretch
            if not len(now):
                continue
            # blocks that reach into one of the open places
            k = np.searchsorted(bounds[now + 1], low, side="right")
            near = np.flatnonzero((k < len(now)) & (bounds[now[np.minimum(k, len(now) - 1)]] < high))
            doc, tf, which = self.decompress(blocks[near])
            open_ = np.zeros(len(bounds), bool)
            open_[now] = True
            on = open_[np.searchsorted(bounds, doc, side="right") - 1]
            doc, tf, which = doc[on], tf[on], near[which[on]]
            docs, nth = np.unique(doc, return_inverse=True)
            most = np.zeros(len(docs), np.int64)
            np.add.at(most, nth, upper[which])
            pivot = most >= best.least
            on = pivot[nth]
            score = np.zeros(len(docs), np.int64)
            np.add.at(score, nth[on], w[which[on]] * impacts(tf[on], self.m[doc[on]]))
            hit = docs[(score > 0) & (score >= best.least)]
            best.add(score[(score > 0) & (score >= best.least)], self.ids[hit], self.nulls[hit], top)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


def search_shards(index: DataFrame, queries: DataFrame, about: Corpus, top: int = TOP, by: Layout = Layout()) -> DataFrame:
    """(item_id, doc_id, score): of every task the best of each query, among which are the best of all."""
    kind = queries.schema["item_id"].dataType
    asked = queries.groupBy("block").agg(F.collect_list(F.struct("item_id", "terms", "weights", "least")).alias("queries"))  # bounded by the layout
    count = (queries.agg(F.max("block")).first()[0] or 0) + 1
    schema = f"item_id {kind.simpleString()}, doc_id long, score long"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, tuple] = {}
        for batch in it:
            for k in range(batch.num_rows):
                block = batch.column("block")[k].as_py()
                if block not in states:
                    q = batch.column("queries")[k].values
                    terms, least = q.field("terms"), q.field("least").to_pylist()
                    states[block] = q.field("item_id"), terms.offsets.to_numpy(), terms.values.to_numpy().view(np.uint64), q.field("weights").values.to_numpy(), [Best(x) for x in least]
                _, offsets, terms, weights, best = states[block]
                shard = Shard({c: batch.column(c)[k] for c in batch.schema.names if c not in ("block", "queries")}, about)
                places = shard.look_up(terms)
                for j, own in enumerate(best):
                    p = places[offsets[j] : offsets[j + 1]]
                    if (p >= 0).any():
                        shard.search(p[p >= 0], weights[offsets[j] : offsets[j + 1]][p >= 0], own, top)
        for items, *_, best in states.values():
            n = np.array([len(b.ids) for b in best])
            ids = pa.array(np.concatenate([b.ids for b in best]), pa.int64(), mask=np.concatenate([b.nulls for b in best]))
            yield pa.RecordBatch.from_arrays([items.take(pa.array(np.repeat(np.arange(len(n)), n))), ids, pa.array(np.concatenate([b.scores for b in best]), pa.int64())], ["item_id", "doc_id", "score"])

    out = None
    for a in range(0, count, by.passes):
        upto = min(count, a + by.passes)
        rows = index.drop("seed").withColumn("block", F.explode(F.array(*map(F.lit, range(a, upto)))))
        found = batches(rows.join(F.broadcast(asked.filter((F.col("block") >= a) & (F.col("block") < upto))), "block"), run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the best."""
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def search(index: DataFrame, items: DataFrame, about: Corpus, top: int = TOP, by: Layout = Layout()) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` documents of every item."""
    queries = materialize(weighted_queries(query_terms(items), index, about, by), "search-weights")
    seeds = materialize(ranked(search_shards(index.filter("seed = 1"), queries, about, top, by), top).drop("rank"), "search-seeds")
    least = seeds.groupBy(F.col("item_id").alias("i")).agg(F.when(F.count(F.lit(1)) >= top, F.min("score")).otherwise(0).alias("l"))
    known = queries.join(least, named("item_id").eqNullSafe(F.col("i")), "left").withColumn("least", F.coalesce("l", "least")).drop("i", "l")
    rest = search_shards(index.filter("seed = 0"), materialize(known, "search-thresholds"), about, top, by)
    return ranked(seeds.unionByName(rest), top)


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, by: Layout = Layout()) -> DataFrame:
    """search() of ``items`` in an index of all of ``docs``."""
    about = corpus(docs)
    return search(build_index(docs, about, by), items, about, top, by)


#: Equivalent DuckDB SQL: every document's score for every item.
LEXICAL_SEARCH_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
s AS (SELECT count(*)::BIGINT AS nd, sum(len(ws))::BIGINT AS total FROM t WHERE len(ws) > 0),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
u AS (SELECT r, doc_id, len(ws)::BIGINT AS n, unnest(ws) AS w FROM t),
p AS (SELECT r, doc_id, n, w, count(*)::BIGINT AS tf FROM u WHERE w IN (SELECT w FROM q) GROUP BY ALL),
f AS (SELECT w, count(*) AS df FROM p GROUP BY w),
x AS (
  SELECT item_id, r, doc_id, sum(floor(1000 * ln((2 * nd + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // total)))) AS score
  FROM q JOIN p USING (w) JOIN f USING (w), s GROUP BY item_id, r, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score::BIGINT AS score
FROM x WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
