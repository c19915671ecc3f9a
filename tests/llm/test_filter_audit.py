"""The filter audit against filters applied one after another to the rows themselves."""

import collections
import math
import re
from fractions import Fraction
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from framewise.llm import filter_audit

def fails(rows):
    """For every row (doc_id, text, source) the letters that it fails."""
    out = []
    for i, text, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        f += "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        out.append(f + "E" * any(i is not None and j is not None and j < i and (u or "") == t for j, u, _ in rows))
    return out

def brute(rows, labels):
    """Every order, step by step, over lists of rows."""
    good, toxic = ({i for i, *said in labels if said[k] == 1} for k in (0, 1))
    failing, out = fails(rows), {}
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, failing, strict=True) if (r[2] or "") == part]
        total = collections.Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                total[x] += len(gone)
                all_x = sum(x in d[1] for d in own)
                losses = [sum(d[0] in s for d in gone if d[0] is not None) for s in (good, toxic)]
                out[part, "".join(order), step] = [len(left), len(gone), all_x - len(gone), sum(d[1] == x for d in own), *losses]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out

def as_dict(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): list(r)[3:] for r in rows}
    assert len(out) == len(rows)
    return out

LABELS = "doc_id long, quality int, toxic int"

def test_equals_filters_one_by_one(spark):
    base = [" ".join(f"w{k}x{j}" for j in range(220)) for k in range(4)]
    kinds = [*base, base[0], base[1].upper(), "w " * 300, base[2] + " $", "Ab #" * 60, "", None, base[3] + " | " + base[3].upper()]
    rows = [(100 - k, kinds[k * 7 % len(kinds)], f"s{k % 3}" if k % 5 else None) for k in range(60)]
    labels = [(100 - k, k % 2, k % 3 == 0) for k in range(50)] + [(99, 0, 1), (None, 1, 1)]
    labels = [(i, int(q), int(t)) for i, q, t in labels]
    got = as_dict(filter_audit.audit_filters(spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(labels, LABELS)))
    assert got == brute(rows, labels)

def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, None), (2, None, 1), (None, 1, 1), (8, 0, 1), (6, 1, 1), (6, 1, 1)], LABELS)
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    got = as_dict(filter_audit.audit_filters(odd, labels))
    assert got == brute(rows, [tuple(r) for r in labels.collect()])
    assert {k[0] for k in got} == {"", "a", "b", "c", "d"} and len(got) == 5 * 600
    assert filter_audit.audit_filters(none, labels).count() == 0
    assert all(v[4:6] == [0, 0] for v in as_dict(filter_audit.audit_filters(odd, labels.limit(0))).values())

@pytest.mark.parametrize("n", [1, 3, 5])
def test_shapley_values_are_exact(spark, n):
    """The integral equals the mean of the marginal removals over all subsets, as fractions; also with fewer filters."""
    counts = {mask: (mask * 7 + 3) % 11 for mask in range(1 << n)}
    rows = [("p", m, 0, 0) for m, c in counts.items() for _ in range(c)]
    letters = "ABCDE"[:n]
    got = filter_audit.audit(spark.createDataFrame(rows, "part string, mask int, good int, toxic int"), letters).collect()
    removed = lambda s: sum(c for m, c in counts.items() if any(m >> k & 1 for k in s))
    for k in range(n):
        value, others = Fraction(0), [j for j in range(n) if j != k]
        for size in range(n):
            for s in combinations(others, size):

                value += Fraction(math.factorial(size) * math.factorial(n - size - 1), math.factorial(n)) * (removed((*s, k)) - removed(s))
        assert {r.shapley for r in got if r.filter_order[r.step - 1] == letters[k]} == {value * math.factorial(n)}

def test_one_text_held_by_most_rows_is_no_hot_key(spark):
    """The join that tells repeated texts goes by digest and id."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit("s").alias("source"))
    labels = spark.createDataFrame([], LABELS)
    marked = filter_audit.failing(docs, labels)
    assert marked.filter(F.col("mask").bitwiseAND(16) > 0).count() == 4000 - 1334 - 1
    (row,) = filter_audit.audit(marked).filter("filter_order = 'EABCD' AND step = 1").collect()
    assert (row.removed, row.redundant, row.kept) == (2665, 0, 1335)
