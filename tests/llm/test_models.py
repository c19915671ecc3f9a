"""Language model, language identification, quality classifier, personal data and sentence pieces."""

import collections
import hashlib
import math
import os
import random
import re
import zlib
from dataclasses import replace

import numpy as np
import pytest

from framewise.llm import language_id, language_model, personal_data, quality_classifier, sentence_pieces
from framewise.llm.common import bounded_sample


def fold(i, parts):
    return zlib.crc32(str(i).encode()) % parts


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def brute_interpolation(texts, p):
    """Base and interpolated scores by dictionaries, with plain expectation-maximisation on exact estimates."""
    sets = {"all": lambda f: f != p.test, "kept": lambda f: f not in (p.test, p.held)}
    grams = {k: collections.Counter() for k in sets}

    def of(text):
        w = [None] * (p.order - 1) + tokens(text)
        return [[tuple(w[k - n : k + 1]) for n in range(p.order)] for k in range(p.order - 1, len(w))]

    for i, t in texts.items():
        for k, inside in sets.items():
            if inside(fold(i, p.parts)):
                grams[k].update(g for own in of(t) for g in own)
    n = {k: sum(c for g, c in x.items() if len(g) == 1) for k, x in grams.items()}
    v = {k: sum(len(g) == 1 for g in x) for k, x in grams.items()}

    def context(c, g):
        return n[c] if len(g) == 1 else grams[c][(None,)] if not any(g[:-1]) else grams[c][g[:-1]]

    def row(c, own):
        """The bucket, and the estimates from order 0 on."""
        seen = [g for g in own if len(g) > 1 and context(c, g)]
        f = [1 / (v[c] + 1)] + [grams[c][g] / context(c, g) if context(c, g) else 0 for g in own]
        return (len(seen[-1]) - 1, context(c, seen[-1]).bit_length()) if seen else (0, 0), f

    held = collections.defaultdict(list)
    for i, t in texts.items():
        if fold(i, p.parts) == p.held:
            for own in of(t):
                b, f = row("kept", own)
                held[b].append(f)
    weights = {}
    for b, fs in held.items():
        known = np.arange(p.order + 1) <= b[0] + 1
        w, f = known / known.sum(), np.array(fs)
        for _ in range(p.rounds):
            share = f * w
            got = (share / share.sum(1, keepdims=True)).sum(0) + 0.5 * known
            w = got / got.sum()
        weights[b] = w
    out = {}
    for i, t in texts.items():
        base = score = 0.0
        for own in of(t):
            b, f = row("all", own)
            known = np.arange(p.order + 1) <= b[0] + 1
            score += math.log10(np.dot(weights.get(b, known / known.sum()), f))
            base += math.log10((grams["all"][own[0]] + 1) / (n["all"] + v["all"] + 1))
        w = tokens(t)
        out[i] = (fold(i, p.parts) == p.test, len(w), sum(grams["all"][(x,)] > 0 for x in w), n["all"], base, score)
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_language_model(spark, texts, order):
    p = language_model.Interpolation(order=order, block_tokens=20_000, slice_bytes=100_000)
    if order in (1, 4):
        texts = dict(list(texts.items())[:60])
    want = brute_interpolation(texts, p)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in language_model.interpolated_scores(df, p).collect()}
    assert set(got) == set(want)
    for i, row in want.items():
        assert got[i][:4] == row[:4]
        assert got[i][4] == pytest.approx(row[4], rel=1e-9)
        assert got[i][5] == pytest.approx(row[5], rel=5e-3)  # the weights are fitted to rounded estimates
    assert sum(r[5] for r in got.values()) == pytest.approx(sum(r[5] for r in want.values()), rel=5e-4)
    held = [r for r in got.values() if r[0]]
    assert sum(r[5] for r in held) > sum(r[4] for r in held)  # interpolation beats the base on held-out texts
    exact = {r.doc_id: r.score for r in language_model.interpolated_scores(df, replace(p, steps=2000)).collect()} if order == 3 else {}
    assert all(exact[i] == pytest.approx(want[i][5], rel=1e-4) for i in exact)


def test_weights_are_maximum_likelihood():
    import pandas as pd

    p = language_model.Interpolation(order=2, steps=8, rounds=2000)
    cells = pd.DataFrame([(35, -40, -8, 700), (35, -40, -10_000, 300)], columns=["bucket", "q1", "q2", "n"])
    w = language_model.fit_weights(cells, p, 1e-9)[35]
    assert w.sum() == pytest.approx(1) and (w > 0).all()
    best = min(np.linspace(0.01, 0.99, 99), key=lambda l2: -(700 * math.log(l2 / 2 + (1 - l2) * 2**-5) + 300 * math.log((1 - l2) * 2**-5)))
    assert w[2] == pytest.approx(best, abs=0.02)


def test_weights_fitted_in_spark_are_the_same(spark, documents, monkeypatch):
    """Beyond the bound on cells, rounds of Spark aggregates give the weights that the driver's rounds give."""
    docs, seen = documents.select("doc_id", "text"), {}
    fitted = language_model.fit_weights
    monkeypatch.setattr(language_model, "fit_weights", lambda cells, p, floor: seen.setdefault("here", fitted(cells, p, floor)))
    rounds = language_model.fit_weights_by_rounds
    monkeypatch.setattr(language_model, "fit_weights_by_rounds", lambda cells, p, floor: seen.setdefault("spark", rounds(cells, p, floor)))
    p = language_model.Interpolation(rounds=12)
    a = {r.doc_id: r.score for r in language_model.interpolated_scores(docs, p).collect()}
    b = {r.doc_id: r.score for r in language_model.interpolated_scores(docs, replace(p, cells=10)).collect()}
    assert np.allclose(seen["here"], seen["spark"], atol=1e-9) and all(a[i] == pytest.approx(b[i], rel=1e-7) for i in a)


def test_cells_come_to_the_driver_as_columns(spark, documents, monkeypatch):
    """No collect() of a row for each cell, which took several hundred bytes of the driver's memory each."""
    docs = documents.select("doc_id", "text")
    rows, fitted, cells = [], language_model.fit_weights, []
    collect = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: (got := collect(self), rows.append(len(got)))[0])
    monkeypatch.setattr(language_model, "fit_weights", lambda own, p, floor: (cells.append(len(own)), fitted(own, p, floor))[1])
    language_model.interpolated_scores(docs, language_model.Interpolation(rounds=2))
    assert cells and cells[0] > 100 and max(rows, default=0) < 100


def test_means_of_cells_keep_scores(spark, documents):
    """Scores with weights fitted to cells are those of weights fitted to nearly single estimates, for every document."""
    docs = documents.select("doc_id", "text")
    a, b = ({r.doc_id: r.score for r in language_model.interpolated_scores(docs, language_model.Interpolation(steps=k)).collect()} for k in (8, 400))
    assert max(abs(a[i] / b[i] - 1) for i in a) < 1e-4


def test_language_model_of_odd_rows(odd, none):
    got = language_model.interpolated_scores(odd).collect()
    assert len(got) == odd.count() and all(r.n_tokens >= 1 and math.isfinite(r.score) and r.score <= 0 for r in got)
    assert [r.n_tokens for r in got if r.doc_id in (2, 3, 4)] == [1, 1, 1]
    assert language_model.interpolated_scores(none).count() == 0


def brute_ppm(raws, text):
    """Bits of a text under one language, by the definition."""
    n = collections.Counter()
    for raw in raws:
        for k in range(language_id.ORDER, len(raw)):
            for o in range(language_id.ORDER + 1):
                n[raw[k - o : k + 1]] += 1
    total, kinds = collections.Counter(), collections.Counter()
    for g, c in n.items():
        total[len(g), g[:-1]] += c
        kinds[len(g), g[:-1]] += 1
    bits, raw = 0.0, language_id._padded(text)
    for k in range(language_id.ORDER, len(raw)):
        p = 1 / 256
        for o in range(language_id.ORDER + 1):
            g = raw[k - o : k + 1]
            key = (o + 1, g[:-1])
            if total[key]:
                room = total[key] + kinds[key]
                p = n[g] / room if n[g] else p * kinds[key] / room
        bits -= math.log2(p)
    return bits


def test_code_lengths(monkeypatch):
    rnd = random.Random(1)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 7)))
    train = {"a": [" ".join(word("abcdé") for _ in range(40)) for _ in range(5)], "b": [" ".join(word("xyzab") for _ in range(40)) for _ in range(5)]}
    trees = {}
    for lang, ts in train.items():
        runs, n = np.unique(np.concatenate([language_id._runs(language_id._padded(t)) for t in ts]), return_counts=True)
        trees[lang] = language_id.ContextTree(runs, n)
    monkeypatch.setattr(language_id, "CHUNK", 64)
    probe = [" ".join(word("abcxyzéQ") for _ in range(30)) for _ in range(8)] + ["z", "é"]
    got = language_id.CodeLengths(trees).texts(probe)
    for row, t in zip(got, probe, strict=True):
        for bits, lang in zip(row, ("a", "b"), strict=True):
            assert bits == pytest.approx(brute_ppm([language_id._padded(x) for x in train[lang]], t), rel=1e-5)


def test_language_accuracy(documents):
    got = language_id.identify(documents, language_id.learn(documents)).collect()
    truth = {r.doc_id: r.lang for r in documents.collect()}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if fold(i, 5) == 0}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(odd, none):
    got = language_id.identify(odd, language_id.learn(odd)).collect()
    assert len(got) == odd.count()
    und = [r.doc_id for r in got if r.lang_pred == "und"]
    assert sorted(und, key=str) == [10, 2, 3, 4, None]
    with pytest.raises(ValueError):
        language_id.learn(odd, language_id.LanguageSample(max_languages=1))
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert language_id.identify(none, language_id.learn(none)).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd, {}).collect()} == {"und"}


def test_quality_accuracy(spark, documents):
    """Labels by rule on more rows than the smallest table has: junk with symbols, and repeated words."""
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(600):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 120))]
        if i % 4 == 0:
            w = [x + "###" for x in w] if i % 8 else [x for x in w[:10] for _ in range(9)]
        rows.append((i, " ".join(w), int(i % 4 != 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = quality_classifier.classify(df.select("doc_id", "text"), df.select("doc_id", "quality")).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == rows[r.doc_id][2] for r in held) >= 0.95 * len(held)
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    again = quality_classifier.classify(df.select("doc_id", "text").repartition(7), df.select("doc_id", "quality")).collect()
    assert {r.doc_id: r.score for r in got} == {r.doc_id: r.score for r in again}


def score_by_definition(text, model, p):
    """The logistic function of the mean of all features' numbers, counted one by one."""
    words = (text or "").encode().split()
    slots = []
    for w in words:
        marked = b"<" + w + b">"
        slots.append(zlib.crc32(w, 1) % p.table)
        slots += [zlib.crc32(marked[k : k + n]) % p.table for n in (2, 3, 4) for k in range(len(marked) - n + 1)]
    slots += [zlib.crc32(b"a bigram of a word with itself") % p.table for a, b in zip(words, words[1:]) if a == b]
    return 1 / (1 + math.exp(-(sum(model.slots[s] for s in slots) / (len(slots) + p.rest) + model.bias)))


def test_training_is_gradient_descent():
    """Every step follows the loss's slope, measured by differences, in all vectors, weights and biases."""
    p = quality_classifier.SubwordClassifier(table=16, dim=2, rest=3, epochs=2, rate=0.5)
    texts, labels = ["a b b", "c c c d", "a d", "", "b c a a"], [1, 0, 1, 0, 0]
    rng = np.random.default_rng(p.seed)
    state = {"v": rng.uniform(-1 / p.dim, 1 / p.dim, (p.table, p.dim)), "w": np.zeros((p.dim, 2)), "b": np.zeros(2)}
    share = np.bincount(labels) / len(labels)

    def features(text):
        words = text.encode().split()
        out = [s for w in words for s in quality_classifier.word_features(w, p)] + [quality_classifier.repeat_slot(p)] * quality_classifier.repeats(words)
        return np.bincount(out, minlength=p.table) / (len(out) + p.rest)

    def loss(k):
        z = features(texts[k]) @ state["v"] @ state["w"] + state["b"]
        return (np.log(np.exp(z).sum()) - z[labels[k]]) * 0.5 / share[labels[k]]

    done, steps = 0, p.epochs * len(texts)
    for _ in range(p.epochs):
        for k in rng.permutation(len(texts)):
            rate, done = p.rate * (1 - done / steps), done + 1
            if not texts[k]:
                continue
            slopes = {}
            for name, x in state.items():
                slopes[name] = np.zeros_like(x)
                for at in np.ndindex(x.shape):
                    kept = x[at]
                    x[at] = kept + 1e-6
                    up = loss(k)
                    x[at] = kept - 1e-6
                    slopes[name][at] = (up - loss(k)) / 2e-6
                    x[at] = kept
            for name, factor in (("v", 1), ("w", 1), ("b", 0.1)):
                state[name] -= factor * rate * slopes[name]
    got = quality_classifier.train(texts, labels, p)
    assert np.allclose(got.slots, state["v"] @ (state["w"][:, 1] - state["w"][:, 0]), atol=1e-6) and got.bias == pytest.approx(state["b"][1] - state["b"][0], abs=1e-6)


def test_quality_scores_by_the_definition(spark, odd):
    """Scores are a logistic function of the mean of all features' numbers, counted one by one."""
    p = quality_classifier.SubwordClassifier(table=1 << 10, epochs=3, rate=0.1)
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice(["good", "fine", "é", "bad", "bad", "x" * 90]) for _ in range(rnd.randint(0, 40))) for _ in range(80)]
    labels = [int("bad bad" not in t) for t in texts]
    model = quality_classifier.train(texts, labels, p)
    docs = {r.doc_id: r.text for r in odd.filter("doc_id IS NOT NULL AND doc_id <> 6").collect()} | dict(enumerate(texts, 100))

    df = spark.createDataFrame([(k, t, 1, 2) for k, t in docs.items()], "doc_id long, text string, Score int, `a.b` int")
    got = quality_classifier.score_texts(df, model, p, names=("_score", "_predicted")).collect()
    assert len(got) == len(docs) and all(r.Score == 1 and r["a.b"] == 2 for r in got)
    for r in got:
        assert r._score == pytest.approx(score_by_definition(docs[r.doc_id], model, p), rel=1e-9) and r._predicted == int(r._score >= p.threshold)


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (7, None), (8, 3), (5, 0), (1, 1)], "doc_id long, quality int")
    got = quality_classifier.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality_classifier.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(none, labels).count() == 0


def test_bounded_sample(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id < 15000 THEN 'a' WHEN id < 15010 THEN 'b' END AS k")
    got = bounded_sample(df, "k", 300)
    n = {r.k: r["count"] for r in got.groupBy("k").count().collect()}
    assert n == {"a": 300, "b": 10, None: 300}
    assert sorted(got.collect(), key=str) == sorted(bounded_sample(df.repartition(9), "k", 300).collect(), key=str)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda x: re.sub("[^0-9]", "", x)

    def luhn(d):
        s = [int(c) for c in d[::-1]]
        return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans():
    rnd = random.Random(4)
    for alphabet in ("ab1.@-+% é", "0123456789 -.", "+(5) 1-2.x", "@.a\n"):
        for _ in range(3000):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
            assert personal_data.base_spans(text) == plain_spans(text), text
    assert personal_data.base_spans("4111 1111 1111 1111") == [("card", 0, 19)]
    for _ in range(2000):
        text = ".".join("".join(rnd.choice("0129. x") for _ in range(rnd.randint(0, 3))) for _ in range(rnd.randint(0, 14)))
        assert personal_data.base_spans(text) == plain_spans(text), text


def test_base_spans_are_linear():
    import time

    for text in ("1" * 1_000_000, "1." * 500_000, "1.1.1." * 170_000 + "x", "a" * 1_000_000 + "@", "+1" + "(" * 1_000_000, "@" + "a" * 1_000_000):
        start = time.process_time()
        personal_data.base_spans(text)
        assert time.process_time() - start < 5


def test_gradients():
    t = personal_data.Tagger(window=10, hidden=3, embed=4)
    net, rng = personal_data.Network(t), np.random.default_rng(0)
    codes = rng.integers(1, personal_data.CHARS, (10, 3))
    codes[7:, 1] = 0
    tags = np.zeros((10, 3), int)
    tags[2, 0], tags[3:5, 0], tags[4, 2], tags[5:8, 2] = 1, 2, 5, 6
    _, g = net.gradients(codes, tags)
    for name in g:
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in net.p[name].shape)
            if name == "trans" and net.cost[at] < 0:
                continue
            old, side = net.p[name][at], []
            for e in (1e-5, -1e-5):
                net.p[name][at] = old + e
                side.append(net.gradients(codes, tags)[0])
            net.p[name][at] = old
            assert g[name][at] == pytest.approx((side[0] - side[1]) / 2e-5, rel=1e-4, abs=1e-7)


@pytest.fixture(scope="module")
def tagger():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8)))

    def text():
        made = [
            f"{word()}@{word()}.com",
            ".".join(str(rnd.randint(0, 255)) for _ in range(4)),
            "".join(rnd.choice("0123456789") for _ in range(16)),
            f"+1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}",
            f'token = "{hashlib.sha1(word().encode()).hexdigest()}"',
            str(rnd.randint(1, 2030)),
        ]
        return " ".join(x for _ in range(3) for x in (*(word() for _ in range(rnd.randint(3, 25))), rnd.choice(made)))

    texts = [text() for _ in range(260)]
    return personal_data.train(texts[:220], personal_data.Tagger(epochs=8)), texts[220:]


def test_tagger_on_held_out_texts(tagger):
    net, texts = tagger
    found, true = set(), set()
    for k, (t, spans) in enumerate(zip(texts, personal_data.model_spans(texts, net), strict=True)):
        found |= {(k, *s) for s in spans}
        true |= {(k, *s) for s in personal_data.base_spans(t, strict=False)}
    both = len(found & true)
    assert both >= 0.85 * len(true) and both >= 0.85 * len(found)


def test_windows_are_reconciled(tagger):
    """Spans don't depend on where a long text is cut into windows."""
    net, _ = tagger
    body = "abc " * 50
    text = body + "mail me ab@cde.com now " + "12 " * 60 + "ab@cde.com " + body
    assert [s for s in personal_data.model_spans([text], net)[0] if s[0] == "email"] == [
        ("email", m.start(), m.end()) for m in re.finditer("ab@cde.com", text)
    ]
    assert personal_data.model_spans([body, ""], net) == [[], []]


def test_personal_data_of_odd_rows(odd, none, tagger):
    for net in (None, tagger[0], personal_data.fit(odd)):
        got = personal_data.find_personal_data(odd, net).collect()
        assert len(got) == odd.count()
        (r,) = [x for x in got if x.doc_id is None and x.n_email]
        text = "no id here at all 12 a@b.cd +1 (555) 123-4567"
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(text))
        assert (r.n_email, r.n_phone) == (1, 1) and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) <= set(r.spans.split(","))
    assert personal_data.fit(none) is None
    assert personal_data.find_personal_data(none, None).count() == 0


needs_model = pytest.mark.skipif(not os.path.exists(sentence_pieces.MODEL), reason="no vocabulary")


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.Pieces.load()


ODD = ["", " ", "  a  b ", "a ▁ b\n\n\tx", "é漢😀\x00", "▁▁", "x" * 3000, "\n" * 5, "word " * 200]


@needs_model
def test_pieces_without_dropout_are_the_library_s(pieces, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    plain = [" ".join(t.split()) for t in list(texts.values())[:60] if t.split()]
    got = sentence_pieces.Segmenter(pieces, sentence_pieces.Dropout(rate=0.0)).ids([" " + t for t in plain], [0] * len(plain))
    assert [g.tolist() for g in got] == [sp.encode(t) for t in plain]


@needs_model
def test_many_units_at_once_are_as_one_by_one(pieces, texts, monkeypatch):
    drop = sentence_pieces.Dropout(rate=0.3)
    s = sentence_pieces.Segmenter(pieces, drop, limit=50)
    units = sorted({u for t in [*list(texts.values())[:40], *ODD] for u in s.units(t) if len(u) <= sentence_pieces.SHORT})
    for v in range(2):
        got = [tuple(np.frombuffer(x, np.int32).tolist()) for x in s._many(units, v)]
        assert got == [sentence_pieces.segment(u, v, pieces, drop) for u in units]
    some = [*list(texts.values())[:30], *ODD]
    a = [x.tolist() for x in s.ids(some, [k % 4 for k in range(len(some))])]
    monkeypatch.setattr(sentence_pieces, "SHORT", 0)
    b = [x.tolist() for x in sentence_pieces.Segmenter(pieces, drop).ids(some, [k % 4 for k in range(len(some))])]
    assert a == b


def brute_segment(unit, variant, pieces, drop):
    """The agenda by its definition: of all neighbours that make a piece and weren't skipped, the best one, again and again."""
    parts = [(k, pieces.symbols.get(c, -1)) for k, c in enumerate(unit)]
    skipped, limit = set(), int(drop.rate * 2**32)

    def mixed(h):
        h = (h ^ (h >> 15)) * 0x2C1B3C6D % 2**32
        return (h ^ (h >> 12)) * 0x297A2D39 % 2**32

    key = mixed((variant + drop.seed * 1_000_003) % 2**32)
    while True:
        found = [(made, a[0], j) for j, (a, b) in enumerate(zip(parts, parts[1:])) if a[1] >= 0 and b[1] >= 0 and (made := pieces.merges.get(a[1] << 32 | b[1])) is not None]
        found = [f for f in found if (f[0], f[1], parts[f[2] + 1][0]) not in skipped]
        if not found:
            break
        made, at, j = min(found)
        if mixed(key ^ ((at * 0x9E3779B1 + made * 0x85EBCA77) % 2**32)) < limit:
            skipped.add((made, at, parts[j + 1][0]))
        else:
            parts[j : j + 2] = [(at, made)]
    return tuple(i for k, x in parts for i in ([pieces.ids[x]] if x >= 0 else [pieces.bytes_[b] for b in unit[k].encode("utf-8", "surrogatepass")]))


@needs_model
def test_dropout_by_the_definition(pieces, texts):
    drop = sentence_pieces.Dropout(rate=0.3)
    s = sentence_pieces.Segmenter(pieces, drop, limit=50)
    some = [*list(texts.values())[:12], *ODD]
    for k, (t, got) in enumerate(zip(some, s.ids([t or "" for t in some], list(range(len(some)))), strict=True)):
        units = s.units(t or "")
        places = [sentence_pieces._mixed((k + j * 0x9E3779B1) & 0xFFFFFFFF) for j in range(len(units))]
        assert got.tolist() == [i for u, v in zip(units, places, strict=True) if len(u) < 300 for i in brute_segment(u, v, pieces, drop)] or any(len(u) >= 300 for u in units)


@needs_model
def test_every_place_of_a_unit_varies(spark, pieces):
    """A passage in many documents has more than a few segmentations, and a unit's merges are dropped at the rate."""
    text = "an internationalization of the passage"
    df = spark.createDataFrame([(k, text) for k in range(200)], "doc_id long, text string")
    ids = [tuple(r.ids) for r in sentence_pieces.encode(df, pieces).collect()]
    assert len(set(ids)) > 30
    unit, drop = " a", sentence_pieces.Dropout(rate=0.1)  # one merge
    got = sentence_pieces.Segmenter(pieces, drop).ids([unit * 4000], [5])[0]
    places = [sentence_pieces._mixed((5 + k * 0x9E3779B1) & 0xFFFFFFFF) for k in range(4000)]
    assert got.tolist() == [i for v in places for i in sentence_pieces.segment(unit, v, pieces, drop)]
    assert 0.08 < len(got) / 4000 - 1 < 0.12


@needs_model
def test_pieces_round_trip_and_vary(spark, odd, none, pieces):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    for seed in (1, 2):
        drop = sentence_pieces.Dropout(rate=0.5, seed=seed)
        both = sentence_pieces.decode(sentence_pieces.encode(df, pieces, drop), pieces)
        assert all(r.decoded == r.text for r in both.collect())
    text = spark.createDataFrame([(1, "internationalization " * 8)], "doc_id long, text string")
    one, same, other = (
        sentence_pieces.encode(text, pieces, sentence_pieces.Dropout(rate=0.3, seed=s)).first().ids for s in (1, 1, 2)
    )
    assert one == same != other
    whole = sentence_pieces.encode(text, pieces, sentence_pieces.Dropout(rate=0.0)).first().ids
    assert len(one) > len(whole)
    got = sentence_pieces.decode(sentence_pieces.encode(odd, pieces), pieces)
    assert set(odd.columns) - {"ids"} <= set(got.columns)
    assert all(r.decoded == r.text and (r.text is None) == (r.ids is None) for r in got.collect())
    assert sentence_pieces.encode(none, pieces).count() == 0


@needs_model
def test_pipeline(spark, sf_dir, documents, texts):
    import corpus_pipeline as cp

    names = [n for n, _ in cp.STAGES]
    assert names == ["quality classifier", "line dedup", "near duplicates", "benchmark decontamination", "sentence pieces"] and cp.ORACLE_SQL is None
    docs, seen = documents, []
    for name, stage in cp.STAGES:
        docs = cp.materialize(stage(spark, docs, sf_dir), "test")
        seen.append((name, docs))
        if name != names[-1]:
            assert docs.columns == documents.columns and docs.schema == documents.schema
    left = {n: {r.doc_id: r.text for r in d.collect()} for n, d in seen[:-1]}
    assert set(left["near duplicates"]) <= set(left["line dedup"]) <= set(left["quality classifier"]) <= set(texts)
    from .test_duplicates import brute_components, brute_hits, check_line_dedup, words_left

    # stage 1: texts whose score by the definition is below the threshold go
    p = quality_classifier.SubwordClassifier()
    model = quality_classifier.fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert set(left["quality classifier"]) == {i for i, t in texts.items() if score_by_definition(t, model, p) >= p.threshold}
    # stage 2: all runs of GUARANTEE words of an earlier place go, and nothing that doesn't stand in one
    before, _, runs = check_line_dedup(seen[0][1].select("doc_id", "text"))
    after = {i: words_left(t, runs[i]) for i, t in before.items()}
    assert {i: t.encode().split() for i, t in left["line dedup"].items()} == {i: w for i, w in after.items() if w or not before[i].split()}
    comps, _ = brute_components(left["line dedup"], 5)
    assert set(left["near duplicates"]) == {i for i, c in comps.items() if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hits = brute_hits(left["near duplicates"], items)
    assert set(left["benchmark decontamination"]) == {i for i, h in hits.items() if not h[4]}
    last = seen[-1][1].collect()
    assert {r.doc_id for r in last} == set(left["benchmark decontamination"]) and all(r.lossless for r in last)
    assert sorted(tuple(r) for r in cp.run(spark, sf_dir).select("doc_id", "n_pieces").collect()) == sorted((r.doc_id, r.n_pieces) for r in last)


@needs_model
def test_pipeline_stages_on_odd_rows(spark, sf_dir, odd, none):
    import corpus_pipeline as cp

    before = collections.Counter(tuple(r)[5:] for r in odd.collect())
    for frame in (odd, none):
        for name, stage in cp.STAGES:
            out = stage(spark, frame, sf_dir)
            n = out.count()
            assert n <= frame.count()
            if name != cp.STAGES[-1][0]:  # columns with names that operators use come through as they were
                assert out.columns == frame.columns and out.schema == frame.schema
                assert not collections.Counter(tuple(r)[5:] for r in out.collect()) - before
            if name == "near duplicates" and frame is odd:
                assert {r.doc_id for r in out.collect()} == {1, 2, 3, 4, None, 5, 6, 7, 9, 10}
                assert out.filter("doc_id = 6").count() == 2  # two texts


def test_texts_under_one_id_stay(spark, sf_dir):
    import corpus_pipeline as cp

    rows = [(1, "alpha beta gamma delta epsilon zeta"), (1, "one two three four five six"), (1, "one two three four five six"), (2, "no copy of any other text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 7):
        got = cp.near_duplicates(spark, df.repartition(parts), sf_dir)
        assert got.columns == df.columns and sorted(map(tuple, got.collect())) == sorted(set(rows))


def test_texts_that_train_are_bounded(spark, monkeypatch):
    """20,000 texts under one labelled id: one of them comes to the driver."""
    docs = spark.range(20_000).selectExpr("cast(1 AS long) AS doc_id", "concat('text ', id) AS text").unionByName(spark.range(2, 40).selectExpr("id AS doc_id", "concat('other ', id) AS text"))
    labels = spark.range(1, 40).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality").unionByName(spark.range(1, 3).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality"))
    seen = []
    monkeypatch.setattr(quality_classifier, "train", lambda texts, quality, p: seen.append((texts, quality)))
    quality_classifier.fit(docs, labels, parts=1, held=5)
    ((texts, quality),) = seen
    assert len(texts) == len(quality) == 39 and sum(t.startswith("text ") for t in texts) == 1


def test_bytes_of_languages_are_bounded(spark):
    sample = language_id.LanguageSample(language_bytes=3_000, total_bytes=40_000)
    docs = spark.range(4_000).selectExpr("id AS doc_id", "concat('l', id % 40) AS lang", "repeat(concat(char(97 + id % 20), char(98 + id % 13), ' '), 200) AS text")
    size = lambda tree: tree.orders[0][1].sum()
    trees = language_id.learn(docs, sample)
    assert len(trees) == 40 and all(500 < size(t) <= 1_000 for t in trees.values())
    two = language_id.learn(docs.filter("lang IN ('l1', 'l2')"), sample)
    assert len(two) == 2 and all(2_400 <= size(t) <= 3_000 for t in two.values())
    with pytest.raises(ValueError):
        language_id.learn(docs, language_id.LanguageSample(max_languages=39))


def test_scratch_of_two_threads(spark):
    """What one thread's block has written stays when another's ends."""
    import threading

    from framewise.llm.common import materialize, scratch

    ready, ended, out = threading.Event(), threading.Event(), {}

    def other():
        ready.wait(60)
        with scratch():
            out["other"] = materialize(spark.range(5), "thread")
        ended.set()

    t = threading.Thread(target=other)
    t.start()
    with scratch():
        own = materialize(spark.range(7), "thread")
        ready.set()
        assert ended.wait(60)
        assert own.count() == 7
    t.join()
    with pytest.raises(Exception):
        out["other"].count()
