"""Near-duplicate documents by MinHash.

Every document gets the minima of many universal hash functions over its word shingles. Documents
with the same shingle set are one class and are represented by one of them. Bands of minima put
classes into buckets; within a bucket, classes are compared with hubs and not with each other.
Candidate pairs pass a check of the whole signatures and then an exact check of the whole sets, and
connected components come from alternating large-star and small-star steps.

No link between different texts is lost to the buckets' hubs. Where a bucket's classes are not all in
one component after that, an exact join by their rarest shingles finds the pairs that can still be linked.

With BANDS bands of ROWS minima a pair of the least similarity 0.8 is missed by all bands with a
probability of (1 - 0.8^ROWS)^BANDS, here 3e-6, and one of similarity 0.9 with 1e-12.

Defined results: a null or empty text, or one without words, has no shingles and is linked with
nothing; rows with a null doc_id are linked with nothing and have a null component; rows that share
a doc_id are one node and each get a row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, batches, encoded, gram_hashes, join_lookup, list_array, materialize, mix64, scratch, semi_by_id, word_hashes
from .components import connected_components

BANDS, ROWS = 32, 5
#: Pairs of one class, and classes of one bucket, that go to one task.
PAIRS, MEMBERS = 200, 2_000


@dataclass(frozen=True)
class NearDup:
    words: int = 5
    percent: int = 80  # least similarity, in hundredths
    slack: float = 0.15  # by how much a signature's estimate may fall short; about five deviations


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Of each text, the sorted 64-bit hashes of the distinct shingles of lower-cased words."""
    h, ends = word_hashes(encoded(texts, LOWER))
    return (np.unique(gram_hashes(own, words)) for own in (np.split(h, ends[:-1]) if len(ends) else []))


def _universal() -> tuple[np.ndarray, np.ndarray]:
    """Fixed multipliers (odd) and addends of the hash functions h(x) = a x + b mod 2^32."""
    seeds = (mix64(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
    return seeds[::2] | np.uint32(1), seeds[1::2]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima over the upper 32 bits of shingles; all functions at once for a block of these, which keeps the work in the cache."""
    a, b = _universal()
    out = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 512):
            now = np.multiply.outer(a, x[at : at + 512])
            now += b[:, None]
            np.minimum(out, now.min(axis=1), out=out)
    return out


def features(docs: DataFrame, p: NearDup) -> DataFrame:
    """doc_id, n_shingles, digest (of the set), bands (one hash for each) and sig (a byte for each minimum)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        tags = mix64(np.arange(BANDS, dtype=np.uint64))
        for batch in it:
            n, digests, bands, sigs = [], [], [], []
            for s in shingle_sets(batch.column("text"), p.words):
                n.append(len(s))
                if not len(s):
                    digests.append(None), bands.append(np.empty(0, np.int64)), sigs.append(None)
                    continue
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                m = signature(s).reshape(BANDS, ROWS).astype(np.uint64)
                key = tags.copy()
                for j in range(ROWS):
                    key = mix64(key) ^ m[:, j]
                bands.append(mix64(key).view(np.int64))
                sigs.append((mix64(m.ravel()) >> np.uint64(56)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), list_array(bands, pa.int64()), pa.array(sigs, pa.binary())],
                ["doc_id", "n_shingles", "digest", "bands", "sig"],
            )

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return batches(ids, run, "doc_id long, n_shingles long, digest binary, bands array<long>, sig binary")


def _paired(pairs: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """Pairs (a, b) with the values of both, as x and y; rows: rep and the value.

    Of each pair, the end that is in more pairs is its hub. The other end's value comes first and then goes
    with the pair to the hub, of whose value there is one copy for every PAIRS pairs; so a hub's value is
    not sent with each of its pairs, nor do all of them meet in one task.
    """
    n = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    n = materialize(n, "near-dedup-hubs")
    both = pairs.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
    first = F.col("na") >= F.col("nb")
    both = both.select("a", "b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("rep"), F.ceil(F.greatest("na", "nb") / F.lit(PAIRS)).alias("parts"))
    both = both.withColumn("part", F.pmod(F.xxhash64("rep"), "parts"))
    values = rows.select("rep", F.col(value).alias("y"))
    copies = rows.join(n, "rep").select(F.col("rep").alias("hub"), F.col(value).alias("x"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.lit(PAIRS)) - 1)).alias("part"))
    return both.join(values, "rep").select("a", "b", "hub", "part", "y").join(copies, ["hub", "part"]).select("a", "b", "x", "y")


def _alike(pairs: DataFrame, sigs: DataFrame, p: NearDup) -> DataFrame:
    """Pairs (a, b) whose signatures agree enough, with their agreement ``est``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in ("x", "y"))
            est = (x == y).mean(axis=1)
            keep = pa.array(est >= p.percent / 100 - p.slack)
            cols = [batch.column("a"), batch.column("b"), pa.array(est, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["a", "b", "est"]).filter(keep)

    return batches(_paired(pairs, sigs, "sig"), run, "a long, b long, est double")


def _confirmed(pairs: DataFrame, docs: DataFrame, p: NearDup) -> DataFrame:
    """Pairs (a, b) whose whole shingle sets are similar enough; of ids with several texts, those of any."""

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [x.tobytes() for x in shingle_sets(batch.column("text"), p.words)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["rep", "set"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= p.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    found = batches(semi_by_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids), sets, "rep long, set binary")
    found = materialize(found, "near-dedup-sets")
    return batches(_paired(pairs, found, "set"), run, "a long, b long").distinct()


def _with_component(df: DataFrame, node: str, comps: DataFrame, out: str) -> DataFrame:
    """Adds the component of ``node``; a node without links is its own."""
    joined = df.join(comps.withColumnRenamed("node", node).withColumnRenamed("component", "_c"), node, "left")
    return joined.withColumn(out, F.coalesce("_c", node)).drop("_c")


def _open(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    return _with_component(_with_component(pairs, "a", comps, "ca"), "b", comps, "cb").filter("ca <> cb").drop("ca", "cb")


def links(docs: DataFrame, feats: DataFrame, p: NearDup) -> DataFrame:
    """(node, component) of the classes that are linked with others; nodes are the least doc_id of each class."""
    known = feats.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    reps = materialize(reps, "near-dedup-classes")
    sigs = reps.select("rep", "sig")
    slots = reps.select("rep", F.explode("bands").alias("key"))
    # apart from the join, so that adaptive execution can split a large bucket in it
    sizes = materialize(slots.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-dedup-sizes")
    members = materialize(slots.join(sizes, "key"), "near-dedup-buckets")
    # hubs are the classes that share most bands with others: what copies were made from, not a copy
    central = members.groupBy("rep").agg((-F.sum("n")).alias("o"))
    members = members.join(central, "rep")
    hubs = members.groupBy("key", "n").agg(F.min(F.struct("o", "rep")).alias("h")).select("key", "n", F.col("h.rep").alias("hub"))
    parts = F.ceil(F.col("n") / F.lit(MEMBERS))
    hubs = hubs.select("key", "hub", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    members = members.withColumn("part", F.pmod(F.xxhash64("rep"), parts)).join(hubs, ["key", "part"]).drop("part")
    members = materialize(members, "near-dedup-buckets")
    pair = lambda df, x, y: df.filter(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
    cand = materialize(_alike(pair(members, "hub", "rep"), sigs, p), "near-dedup-pairs")
    # the best pair of each class first; what is then still open after that
    best = cand.groupBy("b").agg(F.max(F.struct("est", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    edges = materialize(_confirmed(best, docs, p), "near-dedup-links")
    comps = materialize(connected_components(edges, "a", "b"), "near-dedup-components")
    rest = materialize(_open(cand.join(best, ["a", "b"], "left_anti").select("a", "b"), comps), "near-dedup-pairs")
    if not rest.isEmpty():
        edges = materialize(edges.unionByName(_confirmed(rest, docs, p)), "near-dedup-links")
        comps = materialize(connected_components(edges, "a", "b"), "near-dedup-components")
    more = _unsettled(docs, members.filter("n > 2").select("key", "rep"), comps, p)
    if more is not None:
        more = materialize(_alike(more, sigs, p).select("a", "b"), "near-dedup-pairs")
        edges = materialize(edges.unionByName(_confirmed(more, docs, p)), "near-dedup-links")
        comps = materialize(connected_components(edges, "a", "b"), "near-dedup-components")
    return comps


def _unsettled(docs: DataFrame, members: DataFrame, comps: DataFrame, p: NearDup) -> DataFrame | None:
    """Pairs (a, b) that may still be linked, of classes that share a bucket but not a component; None if there are none.

    Each class lists its shingles, the rarest among these classes first. Linked sets share a shingle in
    their first places, and what can follow that place bounds their overlap; other pairs are not made.
    At least one class of a pair is outside its bucket's largest component, so only such classes are
    joined with the others.
    """
    rows = _with_component(members, "rep", comps, "comp")
    parts = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    split = parts.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    rows = rows.join(split.select("key", "main"), "key")
    ids = rows.groupBy("rep", "comp").agg(F.max((F.col("comp") != F.col("main")).cast("int")).alias("small"))
    ids = materialize(ids, "near-dedup-unsettled")
    if ids.isEmpty():
        return None

    def shingles(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [x.view(np.int64) for x in shingle_sets(batch.column("text"), p.words)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), list_array(found, pa.int64())], ["rep", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = batches(semi_by_id(texts, ids.select(F.col("rep").alias("doc_id"))), shingles, "rep long, set array<long>")
    tokens = materialize(sets.select("rep", F.size("set").alias("n"), F.explode("set").alias("token")), "near-dedup-shingles")
    rare = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("rep", "n").orderBy("df", "token"))
    first = tokens.join(rare, "token").withColumn("i", place)
    first = first.filter(100 * (F.col("n") - F.col("i") + 1) >= p.percent * F.col("n")).join(ids, "rep")
    first = materialize(first.filter("df > 1").select("rep", "comp", "small", "token", "n", "i"), "near-dedup-shingles")
    left = first.filter("small = 1").select("token", *(F.col(c).alias(f"{c}1") for c in ("rep", "comp", "small", "n", "i")))
    reach = 1 + F.least(F.col("n1") - F.col("i1"), F.col("n") - F.col("i"))
    enough = (100 + p.percent) * reach >= p.percent * (F.col("n1") + F.col("n"))
    once = (F.col("small") == 0) | (F.col("rep1") < F.col("rep"))
    pairs = left.join(first, "token").filter((F.col("comp1") != F.col("comp")) & once & enough)
    return pairs.select(F.least("rep1", "rep").alias("a"), F.greatest("rep1", "rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept (it is that one)."""
    feats = materialize(features(docs, p), "near-dedup-features")
    with scratch() as keep:
        comps = keep(materialize(links(docs, feats, p), "near-dedup-components"))
    known = feats.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    moved = _with_component(classes, "rep", comps, "component").filter("component <> rep OR rep <> last").select("digest", "component")
    out = join_lookup(feats.select("doc_id", "n_shingles", "digest"), moved, "digest")
    found = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    found = F.when(F.col("doc_id").isNotNull(), found)
    return out.select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce(found == F.col("doc_id"), F.lit(True)).alias("kept"))


#: Equivalent DuckDB SQL for shingles of four words: every pair with a common shingle, and components by walking the links.
NEAR_DEDUP_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id
"""
