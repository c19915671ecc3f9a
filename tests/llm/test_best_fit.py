"""Packing: ids against the tokenizer, constraints, and the number of sequences against best-fit one by one."""

import collections
import random
import zlib

import numpy as np
import pytest

from framewise.llm import best_fit
from framewise.llm.best_fit import Capacity, cost


@pytest.fixture(scope="module")
def spec(spark):
    return best_fit.session_spec(spark)


@pytest.fixture(scope="module")
def tokenizer(spec):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


def want_pieces(tokenizer, text, tokens):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
    first = (len(ids) - 1) % tokens + 1
    edges = [0, *range(first, len(ids) + 1, tokens)]
    return [(a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for a, b in zip(edges, edges[1:])]


def check_packing(rows, cap):
    """Gapless sequences under every capacity; their number."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0, *(n for _, n in own)])[:-1])
        assert all(x <= y for x, y in zip((sum(n for _, n in own), len(own), sum(cost(n) for _, n in own)), cap.vector, strict=True))
    return len(by)


def one_by_one(lengths, cap):
    """Best-fit by falling length, a piece at a time, by the rule's score."""
    full, bins = cap.vector, []
    for n in sorted(lengths, reverse=True):
        want = np.array([n, 1, cost(n)])
        fits = [k for k, b in enumerate(bins) if (b >= want).all()]
        if not fits:
            bins.append(full - want)
        elif cap.rule == "norm":
            k = min(fits, key=lambda k: ((((bins[k] - want) / full) ** 2) * cap.weights).sum())
            bins[k] = bins[k] - want
        else:
            k = max(fits, key=lambda k: (bins[k] / full * (want / full) * cap.weights).sum())
            bins[k] = bins[k] - want
    return len(bins)


EDGES = ["a  b", " a", "a ", "  ", "a\n b", "a \n b", "a\n\n  b\t c ", "x\x1c y", "\x1c y", "y \x1c", "  b c d", "don't 'we'll  'S", "<|endoftext|> b", "a  <|endoftext|>", "a<|endoftext|>b c", "é漢 字 😀  ẞ", "12 34,5 .. !? \r\n x", "\x00 \x1f", "a​ b﻿ c", "　 a　 b"]


def test_encoder_equals_the_tokenizer(spec, tokenizer, texts, monkeypatch):
    rnd = random.Random(3)
    made = ["".join(rnd.choice(" \n\t\r\x0b\x1c  ab1'!é漢<") for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    every = [*EDGES, *made, *list(texts.values())]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(every, add_special_tokens=False)]
    assert best_fit.Encoder(spec).ids(every) == want
    monkeypatch.setattr(best_fit, "PARTS", 50)  # most is forgotten
    small = best_fit.Encoder(spec)
    assert [x for k in range(0, len(every), 100) for x in small.ids(every[k : k + 100])] == want
    assert len(small.known) <= 50


def test_query_equals_brute_force(spark, sf_dir, texts, tokenizer):
    from framewise.llm.queries import QUERIES

    rows = QUERIES["op13_best_fit_packing"](spark, sf_dir).collect()
    got = collections.defaultdict(dict)
    for r in rows:
        got[r.doc_id][r.piece] = (r.start, r.length, r.ids_crc32)
    assert {i: [p[k] for k in range(len(p))] for i, p in got.items()} == {i: want_pieces(tokenizer, t, 2048) for i, t in texts.items()}
    n, total = check_packing(rows, Capacity()), sum(r.length for r in rows)
    assert n <= max(-(-total // 2048) + 1, one_by_one([r.length for r in rows], Capacity()))


@pytest.mark.parametrize("cap", [Capacity(64), Capacity(64, rule="dot"), Capacity(64, documents=3), Capacity(64, attention=cost(64) // 2 + 400), Capacity(64, 5, cost(64), "dot", (1.0, 1.0, 1.0)), Capacity(64, 4, cost(64), "norm", (1.0, 1.0, 1.0))])
def test_plan(cap):
    rnd = random.Random(9)
    top = max(n for n in range(1, 65) if cost(n) <= cap.vector[2])
    for case in range(12):
        lengths = [min(top, 1 + int(rnd.paretovariate(0.6 + case % 3))) for _ in range(rnd.choice([0, 1, 2, 50, 700]))]
        runs = best_fit.plan(collections.Counter(lengths), cap)
        seen, rows = collections.Counter(), []
        for n in lengths:
            s, o = runs.place(np.array([n]), np.array([seen[n]]))
            seen[n] += 1
            rows.append(collections.namedtuple("R", "sequence_id offset length")(int(s[0]), int(o[0]), n))
        assert check_packing(rows, cap) == runs.sequences
        best = one_by_one(lengths, cap)
        assert runs.sequences <= (best if cap.rule == "norm" and cap.weights[1] < 1 and cap.documents is None and cap.attention is None else 1.1 * best + 1)


def test_plan_does_not_grow_with_the_corpus():
    rnd = random.Random(4)
    counts = {n: rnd.randint(1, 10**9) for n in range(1, 2049)}
    runs = best_fit.plan(counts)
    assert len(runs.length) < 20_000 and runs.sequences < 1.01 * sum(n * c for n, c in counts.items()) / 2048
    with pytest.raises(ValueError):
        best_fit.plan({10: 1}, Capacity(64, attention=20))
    with pytest.raises(ValueError):
        best_fit.plan({10: 1}, Capacity(rule="other"))


def test_odd_rows_and_round_trip(spark, odd, none, spec, tokenizer):
    cap = Capacity(300, documents=7)
    packed = best_fit.pack(odd, spec, cap)
    rows = packed.collect()
    check_packing(rows, cap)
    own = sorted((r.start, r.length, zlib.crc32(r.ids)) for r in rows)
    assert own == sorted(p for r in odd.collect() for p in want_pieces(tokenizer, r.text, 300))
    assert best_fit.pack(none, spec).count() == 0 and best_fit.pack_digest(none, spec).count() == 0
    texts = collections.defaultdict(list)
    for s in best_fit.sequences(packed).collect():
        ids = np.frombuffer(s.ids, "<u4")
        for d in s.documents:
            texts[d.doc_id].append((d.piece, ids[d.offset : d.offset + d.length].tolist()))
    whole = [t for _, x in sorted(texts[5]) for t in x]
    assert whole[-1] == 0 and tokenizer.decode(whole[:-1]) == next(r.text for r in odd.collect() if r.doc_id == 5)


def test_ranks_count_across_tasks(spark, spec):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('word ', cast(id % 5 AS int)) AS text").repartition(7)
    rows = best_fit.pack_digest(docs, spec, Capacity(16)).collect()
    assert len(rows) == 3000 and check_packing(rows, Capacity(16)) == -(-sum(r.length for r in rows) // 16)
