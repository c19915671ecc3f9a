"""Ranked search against the scores of all documents."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from framewise.llm import lexical_search
from framewise.llm.lexical_search import Best, Corpus, Layout, Shard

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in TERM.findall(text or "")]


def brute(rows, items, top=10):
    """{item: [(doc_id, score)]}; rows and items: (id, text)."""
    docs = [(i, terms_of(t)) for i, t in rows]
    docs = [(i, collections.Counter(ws), len(ws)) for i, ws in docs if ws]
    number, total = len(docs), sum(n for *_, n in docs)
    df = collections.Counter(w for _, c, _ in docs for w in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i].update(terms_of(t))
    out = {}
    for item, ws in asked.items():
        found = []
        for i, c, n in docs:
            m = 100 - 90 + (90 * n * number) // total
            score = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 8 * m)) for w in ws if w in c)
            found += [(-score, i is None, i, score)] * (score > 0)
        if found:
            out[item] = [(i, s) for *_, i, s in sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top]]
    return out


def as_dict(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.item_id is None, r.item_id or 0, r.rank)):
        out[r.item_id].append((r.doc_id, r.score))
        assert r["rank"] == len(out[r.item_id])
    return dict(out)


SMALL = [Layout(), Layout(block=2, shard_docs=7, seeds=3), Layout(block=16, shard_bytes=60_000, seeds=1, queries=5, passes=2), Layout(block=1, shard_docs=40, query_terms=30, passes=1)]


@pytest.mark.parametrize("by", SMALL)
def test_equals_brute_force(spark, documents, texts, sf_dir, by):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute(list(texts.items()), [tuple(r) for r in items.select("item_id", "text").collect()])
    got = as_dict(lexical_search.rank_documents(documents.repartition(5), items, by=by))
    assert got == want and len(want) == items.count()


def test_ties_and_top(spark):
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(30)]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.choice([3, 3, 20])))) for i in range(300)] + [(1000 - k, "w1 w2 W3") for k in range(40)]
    items = [(k, " ".join(rnd.choices(words, k=k + 1))) for k in range(12)] + [(50, "w1 w1 w2"), (50, "w3"), (60, "unknown"), (61, "")]
    frames = spark.createDataFrame(rows, "doc_id long, text string").repartition(6), spark.createDataFrame(items, "item_id long, text string")
    for top in (1, 3, 500):
        assert as_dict(lexical_search.rank_documents(*frames, top, Layout(block=4, shard_docs=13, seeds=2))) == brute(rows, items, top)


def test_odd_rows(spark, odd, none):
    items = [(1, "Alpha beta one x漢字 y", 1), (None, "ten", 2), (None, "ALPHA 555", 2), (2, None, 3), (3, "\x00 ..", 3)]
    asked = spark.createDataFrame(items, "item_id long, text string, score int")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = brute(rows, [x[:2] for x in items])
    assert as_dict(lexical_search.rank_documents(odd, asked)) == want and set(want) == {1, None}
    assert any(i is None for i, _ in want[None])
    assert lexical_search.rank_documents(none, asked).count() == 0
    assert lexical_search.rank_documents(odd, asked.limit(0)).count() == 0


def test_blocks_below_the_threshold_are_not_decompressed():
    rnd = random.Random(1)
    texts = [" ".join(rnd.choices([f"c{k}" for k in range(50)], k=60)).encode() for _ in range(4000)]
    for k in range(2000, 2012):
        texts[k] += b" rare" * 3
    about = Corpus(4000, sum(len(t.split()) for t in texts))
    batch = lexical_search._shard(list(range(4000)), texts, 0, about, 64)
    shard = Shard({c: batch.column(c)[0] for c in batch.schema.names}, about)
    from framewise.llm.common import word_hashes

    places = shard.look_up(word_hashes([b"rare c1 c2 c3"])[0])
    best = Best(0)
    shard.search(places, np.array([6000, 30, 30, 30]), best, 10)
    assert set(best.ids.tolist()) <= set(range(2000, 2012)) and len(best.ids) == 10
    first, every = shard.decoded, sum(int(shard.blocks[p + 1] - shard.blocks[p]) for p in places)
    shard.search(places, np.array([6000, 30, 30, 30]), Best(best.least), 10)
    assert shard.decoded - first < 0.15 * every < first


def test_varints():
    v = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**31 - 1])
    raw, ends = lexical_search.varints(v)
    assert lexical_search.from_varints(raw).tolist() == v.tolist() and ends[-1] == len(raw)
    assert len(lexical_search.varints(v[:0])[0]) == 0 and pa.array(lexical_search.from_varints(raw[:0])).to_pylist() == []
