"""Near duplicates, line dedup and decontamination against brute force."""

import collections
import hashlib
import random
import re

import pytest

from framewise.llm import components, decontamination, line_dedup, near_dedup


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_components(texts, n, percent=80):
    sets = {i: shingles(t, n) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(documents, texts, n):
    comps, sizes = brute_components(texts, n)
    got = near_dedup.near_duplicates(documents, near_dedup.NearDup(words=n)).collect()
    assert {r.doc_id: r.component_id for r in got} == comps
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_signatures_find_pairs_just_above_the_bound():
    """Of pairs with a similarity from 0.80 to 0.85 nearly all share a band, and the estimate keeps them."""
    import numpy as np

    rng, p, found, pairs = np.random.default_rng(5), near_dedup.NearDup(), 0, 0
    while pairs < 4000:
        union = int(rng.integers(30, 400))
        both = int(np.ceil(rng.uniform(0.80, 0.85) * union))
        if both > 0.85 * union:
            continue
        s, own = rng.integers(0, 2**64, size=union, dtype=np.uint64), int(rng.integers(0, union - both + 1))
        x, y = (near_dedup.signature(np.sort(v)) for v in (s[: both + own], np.concatenate([s[:both], s[both + own :]])))
        pairs += 1
        found += (x.reshape(near_dedup.BANDS, -1) == y.reshape(near_dedup.BANDS, -1)).all(axis=1).any() and (x == y).mean() >= p.percent / 100 - p.slack
    assert found >= 0.999 * pairs


def test_star_of_copies_with_strangers(spark):
    """Copies that are linked only through what they were made from, and others just too far from it."""
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(5000)}" for _ in range(150)]
    texts = {0: " ".join(f"u{k}" for k in range(60))}
    for k in range(1, 90):
        w = base[:]
        for p in rnd.sample(range(0, 150, 5), k % 9):
            w[p] = f"x{k}_{p}"
        texts[1000 - k] = " ".join(w)
    comps, _ = brute_components(texts, 5)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == comps and 1 < len(set(comps.values())) < len(texts)


def test_near_duplicates_of_odd_rows(odd, none):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[8].component_id == 1 and not by[8].kept and by[1].kept
    assert by[2].n_shingles == by[3].n_shingles == by[4].n_shingles == 0 and by[2].component_id == 2 and by[2].kept
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    assert [r.component_id for r in got if r.doc_id == 6] == [6, 6, 6]
    assert near_dedup.near_duplicates(none).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rnd.randrange(80), rnd.randrange(80)) for _ in range(50)] + [(7, 7), (None, 3), (1, 2), (1, 2)]
    df = spark.createDataFrame(edges, "a long, b long")
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(df, "a", "b").collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components.connected_components(df.limit(0), "a", "b").count() == 0


def repeated(texts, words):
    """Places of words within runs of so many words that stand in an earlier place."""
    first, out = set(), {}
    for i in sorted(texts):
        w = (texts[i] or "").encode().split()
        out[i] = set()
        for a in range(len(w) - words + 1):
            key = tuple(w[a : a + words])
            if key in first:
                out[i] |= set(range(a, a + words))
            first.add(key)
    return out


def words_left(text, gone):
    """Words of a text without those that are gone; a line's second word stays where a run begins or ends at it."""
    seconds, n = set(), 0
    for line in re.split(r"(?<=[.!?])[ \t]+|[\r\n]+", text):
        w = line.encode().split()
        seconds |= {n + 1} if len(w) > 1 else set()
        n += len(w)
    cut, at = set(), 0
    while at < n:
        end = at
        while end in gone:
            end += 1
        run = range(at + (at in seconds), end - (end in seconds))
        cut |= set(run) if len(run) >= line_dedup.NOISE else set()
        at = max(end, at + 1)
    return [x for k, x in enumerate(text.encode().split()) if k not in cut]


def check_line_dedup(df):
    texts = {r.doc_id: r.text for r in df.collect()}
    must, may = repeated(texts, line_dedup.GUARANTEE), repeated(texts, line_dedup.NOISE)
    runs = collections.defaultdict(set)
    for r in line_dedup.repeated_runs(df).collect():
        runs[r.doc_id] |= {k for x in r.runs for k in range(x.start, x.end)}
    for i in texts:
        assert must[i] <= runs[i] <= may[i]
    return texts, must, runs


def test_line_dedup(documents):
    df = documents.select("doc_id", "text")
    texts, must, runs = check_line_dedup(df)
    assert any(must.values())
    for r in line_dedup.dedup_lines(df).collect():
        left = words_left(texts[r.doc_id], runs[r.doc_id])
        assert r.text.encode().split() == left and r.n_deleted == len(texts[r.doc_id].encode().split()) - len(left)
        assert runs[r.doc_id] or r.text == texts[r.doc_id]


def shared_runs(length, n=60):
    """Texts with a run of so many words, after texts that have its parts in other contexts."""
    rnd = random.Random(length)
    some = lambda k: [f"w{rnd.randrange(10**7)}" for _ in range(k)]
    texts = []
    for _ in range(n):
        run = some(length)
        a, b = sorted(rnd.sample(range(length + 1), 2))
        for part in (run[a:b], run[: rnd.randrange(length)], run[rnd.randrange(length) :], run, run):
            texts.append(" ".join([*some(30), *part, *some(30)]))
    return dict(enumerate(texts))


@pytest.mark.parametrize("length", [20, 25, 30, 40])
def test_runs_whose_parts_stand_in_other_contexts(spark, length):
    """Every run of GUARANTEE words or more is found whole; most of the shorter ones are."""
    df = spark.createDataFrame(list(shared_runs(length).items()), "doc_id long, text string")
    texts, must, runs = check_line_dedup(df)
    want = repeated(texts, length)
    assert sum(len(want[i] & runs[i]) for i in texts) >= (1.0 if length >= line_dedup.GUARANTEE else 0.5) * sum(map(len, want.values()))


def test_busy_first_documents_are_copied(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MATCHES", 3)
    passage = " ".join(f"common{k}" for k in range(55))
    rows = [(k, f"Own words of {k}. {passage}. After {k}.") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_line_dedup(df)
    got = {r.doc_id: r.n_deleted for r in line_dedup.dedup_lines(df).collect()}
    assert got[0] == 0 and all(got[k] >= 55 for k in range(1, 40))


def test_line_ends_are_the_pattern_s():
    rnd = random.Random(2)
    for _ in range(4000):
        raw = bytes(rnd.choice(b"ab.!? \t\r\n\x0b") for _ in range(rnd.randint(0, 40)))
        assert line_dedup.line_ends(raw).tolist() == [m.end() for m in line_dedup._CUT.finditer(raw)]


def test_first_place_stays_and_context_is_kept(spark):
    passage = " ".join(f"common{k}" for k in range(55)) + ".\n"
    rows = [(3, "Own three.\n" + passage + "After three."), (1, "Own one.\n" + passage + "After one."), (2, "Nothing shared here.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: rows[1][1], 2: rows[2][1], 3: "Own three.\nAfter three."}


def left_words(texts, words):
    """Each text's words without those in a run of so many words that stands in an earlier place; looks at words only."""
    first, out = set(), {}
    for i in sorted(texts):
        w = texts[i].split()
        gone = set()
        for a in range(len(w) - words + 1):
            key = tuple(w[a : a + words])
            gone |= set(range(a, a + words)) if key in first else set()
            first.add(key)
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_passages_within_sentences(spark):
    """Passages inside one sentence, in bar-separated text, across the ends of sentences and in other line breaks."""
    rnd = random.Random(7)

    def some(n, sep=" "):
        return sep.join(f"w{rnd.randrange(10**6)}" for _ in range(n))

    inside, bars, across, least = some(60), some(60, " | "), some(30) + ". " + some(15) + "? " + some(30), some(25)
    texts = {k: f"{some(40)} {p} {some(40)}" for k, p in enumerate([inside, bars, across, least, inside, bars, across, least, some(60)])}
    texts[9] = f"{some(9)} {across[20:]} {some(50)} {inside[:200].replace(' ', chr(10))} {some(30)}"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.text.split() for r in line_dedup.dedup_lines(df).collect()}
    want = left_words(texts, line_dedup.GUARANTEE)
    assert all(got[k] == want[k] for k in range(9))
    # a line's second word stays where a run begins or ends at it
    assert len(want[9]) <= len(got[9]) <= len(want[9]) + 4 and sum(map(len, want.values())) < sum(len(t.split()) for t in texts.values()) - 250


def test_line_dedup_of_odd_rows(odd, none):
    got = line_dedup.dedup_lines(odd).collect()
    assert len(got) == odd.count() and got[0].__fields__.count("n_deleted") == 1
    texts = collections.Counter((r.doc_id, r.text) for r in got)
    assert texts[(2, None)] == 1 and texts[(3, "")] == 1
    six = [r for r in got if r.doc_id == 6 and r.n_deleted]
    assert len(six) == 2 and six[0].text == six[1].text and 0 < len(six[0].text) < 400
    assert line_dedup.dedup_lines(none).count() == 0


def match_words(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute_hits(texts, items):
    words = match_words
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    out = {}
    for d, t in texts.items():
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        ids = ",".join(sorted(map(str, found)))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))
    return out


def test_decontamination(spark, sf_dir, documents, texts):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    more = spark.createDataFrame([(900, "The"), (901, None), (902, " ... "), (903, "of the"), (904, "of THE!"), (900, "The")], bench.schema)
    both = bench.unionByName(more)
    want = brute_hits(texts, [(r.item_id, r.text) for r in both.collect()])
    got = {r.doc_id: tuple(r)[1:] for r in decontamination.decontaminate(documents, both).collect()}
    assert got == want and any(v[4] for v in want.values())


def test_decontamination_in_blocks(spark, sf_dir, documents, monkeypatch):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one = sorted(decontamination.decontaminate(documents, bench).collect())
    monkeypatch.setattr(decontamination, "BLOCK", 100)
    monkeypatch.setattr(decontamination, "few", lambda df, bound=0: False)
    assert sorted(decontamination.decontaminate(documents, bench).collect()) == one


def test_decontamination_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([("q", "eta theta iota kappa"), ("r", "no ID"), (None, "beta gamma")], "item_id string, text string")
    got = decontamination.decontaminate(odd, items).collect()
    assert len(got) == odd.count()
    hits = sorted((-1 if r.doc_id is None else r.doc_id, r.n_hit) for r in got if r.contaminated)
    assert hits == [(-1, 2), (1, 6), (8, 6)]
    left = decontamination.remove_contaminated(odd, items)
    assert left.count() == odd.count() - 3 and left.columns == odd.columns
    assert decontamination.decontaminate(none, items).count() == 0
    assert decontamination.decontaminate(odd, items.limit(0)).filter("contaminated").count() == 0


def test_proximity(spark):
    item = "quartz jumble vexing sphinx oblong waltz nymph crypt fjord gizmo"
    w = item.split()
    docs = [(1, item), (2, " ".join([*w[:5], "so", "to", "say", *w[5:]])), (3, " ".join(w[::-1])), (4, "quartz alone"), (5, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    near = {r.doc_id for r in decontamination.proximity_matches(df, bench, slop=4).collect()}
    assert {1, 2} <= near and not near & {4, 5}
    exact = {r.doc_id for r in decontamination.decontaminate(df, bench).filter("contaminated").collect()}
    assert exact == {1}


def test_ids_of_hits_are_sorted_as_text(spark):
    docs = spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "ab"), (9, "cd"), (100, "ab cd")], "item_id long, text string")
    r = decontamination.decontaminate(docs, items).first()
    assert r.items_sha256 == hashlib.sha256(b"10,100,9").hexdigest() and r.n_hit == 2


def test_word_hashes_tell_words_apart():
    """The words are those of bytes.split(), and equal words, and only those, have equal hashes."""
    from framewise.llm import common

    rnd = random.Random(8)
    alphabet = ["a", "b", "\x00", "é", "\u2003", " ", "\n", "\t", "\x0b\x0c\r", "x" * 7, "y" * 9, "z" * 600]
    raws = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))).encode() for _ in range(300)] + [b"", b" ", b"a", b"a\x00", b"q" * 100_000]
    h, ends = common.word_hashes(raws)
    words = [r.split() for r in raws]
    assert ends.tolist() == [sum(map(len, words[: k + 1])) for k in range(len(words))]
    by = collections.defaultdict(set)
    for w, x in zip((w for own in words for w in own), h.tolist(), strict=True):
        by[w].add(x)
    assert all(len(x) == 1 for x in by.values()) and len({min(x) for x in by.values()}) == len(by)
    assert common.word_hashes([])[1].tolist() == []


def test_hot_lookup_is_salted(spark, monkeypatch):
    from framewise.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(common, "few", lambda df, bound=1: df.limit(bound + 1).count() <= 1)
    big = spark.createDataFrame([(None if k % 3 else k % 5, k) for k in range(60)], "key long, v long")
    small = spark.createDataFrame([(None, "n"), (0, "a"), (3, "b")], "key long, name string")
    got = sorted((r.v, r.name or "") for r in common.join_lookup(big, small, "key").collect())
    names = {None: "n", 0: "a", 3: "b"}
    assert got == [(k, names.get(None if k % 3 else k % 5, "")) for k in range(60)]
