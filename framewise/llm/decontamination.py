"""Benchmark decontamination by a distributed positional inverted index.

The index is cut by documents into shards. A shard has, of every term in its documents, the ascending list of
its places in the shard's words, so any benchmark can be looked up in it; and where each document ends.
Test windows (runs of WINDOW item words; a shorter item is one window) list their terms, the rarest in all
documents first. A window goes to the shards that have its rarest term: windows and the shards' terms are
joined, neither passes through the driver. There the terms' lists, less the terms' places in the window, are
intersected from the rarest on, until all terms stand where they do in the window, within one document.
Neither a frequent term nor a passage that many documents share meets in one task, since every shard has its
own list. Proximity matches, where a window's rarest terms stand near their places in any order, come from the
same lists.

Words are compared by their 64-bit hashes. Defined results: a null or empty text has no words, and nothing is
hit; an item without words has no windows; rows with equal doc_id are searched each on its own; items with
equal item_id count once; other columns are ignored, and stay in remove_contaminated(); empty tables give no
hits, or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches, encoded, few, fresh, gram_hashes, join_lookup, list_array, materialize, scratch, shared_table, word_hashes

WINDOW = 10
#: Terms of each window that a proximity match needs.
ANCHORS = 3
#: Windows that are looked up in a shard at once (about 200 bytes each).
BLOCK = 100_000

#: ASCII letters and digits and all other characters make words; A-Z are lower-cased.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def test_windows(benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(win, terms) of the distinct windows, and (item_id, win) of the items; win is the terms' hash."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            items, wins, terms = [], [], []
            every, ends = word_hashes(encoded(batch.column("text"), _TABLE))
            for item, h in zip(batch.column("item_id").to_pylist(), np.split(every, ends[:-1]) if len(ends) else [], strict=True):
                for k, g in enumerate(gram_hashes(h, size)):
                    items.append(item), wins.append(g), terms.append(h[k : k + size].view(np.int64))
            found = pa.array(np.array(wins, np.uint64).view(np.int64), pa.int64())
            cols = [pa.array(items, batch.column("item_id").type), found, list_array(terms, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["item_id", "win", "terms"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    rows = batches(benchmark.select("item_id", "text"), run, f"item_id {kind}, win long, terms array<long>")
    rows = materialize(rows, "decontamination-windows")
    return rows.dropDuplicates(["win"]).select("win", "terms"), rows.select("item_id", "win").distinct()


INDEX = "shard string, doc_ids array<long>, fps array<long>, ends array<long>, terms array<long>, counts array<int>, places binary"


def postings(docs: DataFrame) -> DataFrame:
    """The index. A row is a shard: its documents with the ends of their words, its terms in unsigned order
    with their numbers of places, and the places (32 bits), term by term. fp is the hash of a document's text.
    """
    part = F.spark_partition_id().cast("string").alias("part")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("fp"), "text", part)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(it):
            if not batch.num_rows:
                continue
            h, ends = word_hashes(encoded(batch.column("text"), _TABLE))
            order = np.argsort(h, kind="stable")
            terms, counts = np.unique(h[order], return_counts=True)
            cols = [pa.array([f"{batch.column('part')[0].as_py()}-{number}"])]
            cols += [pa.array([batch.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("doc_id", "fp")]
            cols += [list_array([ends], pa.int64()), list_array([terms.view(np.int64)], pa.int64())]
            cols += [list_array([counts.astype(np.int32)], pa.int32()), pa.array([order.astype(np.int32).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["shard", "doc_ids", "fps", "ends", "terms", "counts", "places"])

    return batches(rows, run, INDEX)


def shared_index(docs: DataFrame) -> DataFrame:
    """The index, written in buckets of shards: windows come to it, it doesn't move."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shared_table(postings(docs), "decontamination-index", "shard", max(buckets, 32))


def documents(index: DataFrame) -> DataFrame:
    """(doc_id, fp, n_words) of every row that was indexed."""
    d = index.select(F.posexplode(F.arrays_zip("doc_ids", "fps", "ends")).alias("k", "d"), "ends")
    before = F.when(F.col("k") > 0, F.get("ends", F.col("k") - 1)).otherwise(F.lit(0))
    return d.select(F.col("d.doc_ids").alias("doc_id"), F.col("d.fps").alias("fp"), (F.col("d.ends") - before).alias("n_words"))


def ranked_windows(windows: DataFrame, index: DataFrame) -> DataFrame:
    """(rarest, win, len, terms): windows all of whose terms occur; terms: (n, off, term), the rarest in all documents first."""
    places = windows.select("win", F.size("terms").alias("len"), F.posexplode("terms").alias("off", "term"))
    places = materialize(places, "decontamination-terms")
    own = places.select("term").distinct()
    own = F.broadcast(own) if few(own) else own  # 8 bytes each
    found = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    n = found.join(own, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    ranked = join_lookup(places, n, "term").groupBy("win", "len").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "term"))).alias("terms"))
    rarest = F.get("terms", F.lit(0))
    return ranked.filter(rarest["n"] > 0).select(rarest["term"].alias("rarest"), "win", "len", "terms")


MATCHES = "doc_id long, fp long, wins array<long>, starts array<int>, lengths array<int>"


def matches(index: DataFrame, ranked: DataFrame, count: int | None = None, slop: int = 0) -> DataFrame:
    """MATCHES: where windows stand, word for word, in place in their document.

    With ``count`` only so many of each window's rarest terms are looked at, and with ``slop`` each but the
    rarest may be that many words from its place (proximity matches).
    """
    if count is not None:
        ranked = ranked.withColumn("terms", F.slice("terms", 1, count))
    there = index.select("shard", F.explode("terms").alias("rarest"))
    todo = materialize(join_lookup(there, ranked.groupBy("rarest").agg(F.count(F.lit(1)).alias("k")), "rarest", "inner").select("shard", "rarest", "k"), "decontamination-shards")
    # a shard's windows in so many parts that none has more than BLOCK
    most = todo.groupBy("shard").agg(F.sum("k").alias("k")).agg(F.max("k")).first()[0] or 0
    parts = -(-most // BLOCK) or 1
    wins = todo.select("shard", "rarest").join(ranked, "rarest").select("shard", F.pmod(F.xxhash64("win"), F.lit(parts)).alias("part"), F.struct("win", "len", "terms").alias("w"))
    asked = wins.groupBy("shard", "part").agg(F.collect_list("w").alias("windows"))
    both = asked.join(index, "shard").select("windows", "doc_ids", "fps", "ends", "terms", "counts", "places")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k in range(batch.num_rows):
                yield _matched({c: batch.column(c)[k] for c in batch.schema.names}, slop)

    return batches(both, run, MATCHES)


def _matched(row: dict[str, pa.Scalar], slop: int) -> pa.RecordBatch:
    """The matches of one shard's windows, by document."""
    terms = row["terms"].values.to_numpy().view(np.uint64)
    ends = np.cumsum(row["counts"].values.to_numpy())
    places, docs = np.frombuffer(row["places"].as_buffer(), np.int32), row["ends"].values.to_numpy()
    lists: dict[int, np.ndarray] = {}

    def of(term: np.int64) -> np.ndarray:
        if term not in lists:
            k = int(np.searchsorted(terms, np.uint64(term.view(np.uint64))))
            here = k < len(terms) and terms[k] == term.view(np.uint64)
            lists[term] = places[ends[k - 1] if k else 0 : ends[k]].astype(np.int64) if here else np.empty(0, np.int64)
        return lists[term]

    asked = row["windows"].values
    win, length, sets = asked.field("win").to_numpy(), asked.field("len").to_numpy(), asked.field("terms")
    bounds, offs, names = sets.offsets.to_numpy(), sets.values.field("off").to_numpy(), sets.values.field("term").to_numpy()
    which, starts = [], []
    for k in range(len(win)):
        first, *rest = range(bounds[k], bounds[k + 1])
        left = of(names[first]) - offs[first]
        for j in rest:
            if not len(left):
                break
            at = of(names[j]) - offs[j]
            near = np.searchsorted(at, left - slop)
            left = left[(near < len(at)) & (at[np.minimum(near, len(at) - 1)] <= left + slop)] if len(at) else at
        which.append(np.full(len(left), k)), starts.append(left)
    w, s = (np.concatenate([np.empty(0, np.int64), *x]) for x in (which, starts))
    # in one document; near matches need their rarest term in it only
    anchor = s + (offs[bounds[w]] if slop and len(w) else 0)
    doc = np.searchsorted(docs, anchor, side="right")
    begin = np.concatenate([[0], docs])[doc]
    inside = np.ones(len(s), bool) if slop else (s >= begin) & (s + length[w] <= docs[np.minimum(doc, len(docs) - 1)])
    w, s, doc, begin = w[inside], s[inside], doc[inside], begin[inside]
    order = np.argsort(doc, kind="stable")
    w, s, doc = w[order], (s - begin)[order], doc[order]
    own, upto = np.unique(doc, return_index=True)
    cut = [*upto.tolist(), len(doc)]
    ids, fps = row["doc_ids"].values, row["fps"].values
    cols = [x.take(pa.array(own)) for x in (ids, fps)]
    for x, kind in ((win[w], pa.int64()), (s, pa.int32()), (length[w], pa.int32())):
        cols.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, kind)))
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "fp", "wins", "starts", "lengths"])


def phrase_hits(found: DataFrame) -> DataFrame:
    """(doc_id, fp, n_hit, wins) of the texts in which windows stand: hit words and the windows."""
    place = F.transform(F.arrays_zip("starts", "lengths"), lambda x: F.struct(x["starts"].alias("a"), (x["starts"] + x["lengths"]).alias("b")))
    every = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(x)))).alias(name) for x, name in ((place, "runs"), (F.col("wins"), "wins"))]
    rows = found.groupBy("doc_id", "fp").agg(*every)  # a text's windows of all parts; no more than it has words and windows
    zero = F.struct(F.lit(0).alias("b"), F.lit(0).alias("n"))
    grown = lambda s, r: F.struct(F.greatest(s["b"], r["b"]).alias("b"), (s["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(s["b"], r["a"]))).alias("n"))
    return rows.select("doc_id", "fp", F.aggregate("runs", zero, grown, lambda s: s["n"].cast("long")).alias("n_hit"), "wins")


def _search(docs: DataFrame, benchmark: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, hits, items): the index of ``docs``, phrase_hits() of all windows, and the items' windows."""
    index = shared_index(docs)
    windows, items = test_windows(benchmark, size)
    with scratch() as keep:
        ranked = materialize(ranked_windows(windows, index), "decontamination-ranked")
        hits = keep(materialize(phrase_hits(matches(index, ranked)), "decontamination-hits"))
    return index, hits, items


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` whose text has no window of the benchmark."""
    i, f = fresh(docs.columns, "_id", "_fp")
    with scratch() as keep:
        _, hits, _ = _search(docs, benchmark, size)
        gone = keep(materialize(hits.select(F.col("doc_id").alias(i), F.col("fp").alias(f)), "decontamination-gone"))
    gone = F.broadcast(gone) if few(gone) else gone
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(f))
    return docs.join(gone, same, "left_anti")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, for every row of ``docs``."""
    index, hits, items = _search(docs, benchmark, size)
    # an item's windows are many, a document's items few: items are gathered as sets, each hit window once
    by_win = items.groupBy("win").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    named = join_lookup(hits.select("doc_id", "fp", F.explode("wins").alias("win")), by_win, "win", "inner")
    named = named.groupBy("doc_id", "fp").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("ids"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("fp") == F.col("f"))
    hits = hits.select(F.col("doc_id").alias("d"), F.col("fp").alias("f"), "n_hit")
    named = named.join(hits, same).select("d", "f", "n_hit", "ids")
    out = documents(index).join(named, same, "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int = 5, size: int = WINDOW) -> DataFrame:
    """(doc_id, item_id): items of which the ANCHORS rarest terms of a window stand within ``slop`` words of their places."""
    index = shared_index(docs)
    windows, items = test_windows(benchmark, size)
    ranked = materialize(ranked_windows(windows, index), "decontamination-ranked")
    found = matches(index, ranked, ANCHORS, slop).select("doc_id", F.explode("wins").alias("win"))
    by_win = items.groupBy("win").agg(F.collect_set("item_id").alias("ids"))
    named = join_lookup(found.distinct(), by_win, "win", "inner")
    return named.select("doc_id", F.explode("ids").alias("item_id")).distinct()


#: Equivalent DuckDB SQL: every window of every text, joined with the items' windows.
DECONTAMINATION_SQL = r"""
WITH t AS (
  SELECT doc_id, NULL AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, unnest(list_transform(range(1, greatest(1, len(ws) - 9) + 1), lambda k: array_to_string(ws[k:k+9], ' '))) AS g FROM b WHERE len(ws) > 0),
s AS (SELECT DISTINCT n FROM i),
d AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS k, ws FROM t, s WHERE len(ws) >= n),
g AS (SELECT doc_id, n, k, array_to_string(ws[k:k+n-1], ' ') AS g FROM d),
h AS (SELECT doc_id, g.n, k, item_id FROM g JOIN i ON i.g = g.g AND i.n = g.n),
x AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
y AS (SELECT doc_id, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS v FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM t LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)
"""
