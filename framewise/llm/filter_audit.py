"""What filters on documents remove, in every order, and what each is worth: a Shapley audit.

Every document has a mask, one bit for each filter whose condition it fails. All that the audit needs of a part
(the documents of one source) is how many documents have which mask, of all, of the good and of the toxic ones.
The numbers make the part's removal polynomial, the multilinear extension of "documents removed by a set of
filters": with x_i the chance that filter i is applied,

    f(x) = sum of a_T * product of x_i for i in T,   a_T = (-1)^(|T|+1) * documents whose mask contains T.

At a corner (every x_i 0 or 1) f is the number that this set removes, so survivors and losses of every step of
every order are differences of two corners. A filter's Shapley value is the integral of f's partial derivative
along the diagonal, sum of a_T / |T| over the T that hold it; it is kept as a numerator over the least common
multiple of 1 to n, so it is exact, and times n! it is the documents that the filter removes in all orders.

The text is read once, for the mask and a 128-bit digest. Duplicates are told by joining the documents with
the least id of each digest, by digest and id together: a text that a third of all rows have is no hot key. The
masks are counted by part and mask before they are moved; a part is one row from there on.

Defined results: a null text is empty; a null source is part ''; a null doc_id has no smaller one, is no
smaller one itself and has no labels; repeated rows count each time and, having one id, are no duplicates of
each other; a doc_id with several rows of labels is good or toxic if one says so; texts are read whole; other
columns are ignored, whatever their names; an empty table has no parts and gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, scratch

#: The filter that compares texts; the others look at one text each.
REPEATED = "E"


def text_rules(text: Column) -> Column:
    """An array of the failure conditions A to D of a text."""

    def rules(t: Column) -> Column:
        words = F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")
        of_words = let(words, lambda w: F.array(F.size(w) < 200, 100 * F.size(F.array_distinct(w)).cast("long") < 50 * F.size(w).cast("long")))
        capitals = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
        return F.concat(of_words, F.array(100 * capitals.cast("long") > 2 * F.length(t), t.rlike("[#$%&*|]")))

    return let(F.coalesce(text, F.lit("")), rules)


def failing(docs: DataFrame, labels: DataFrame, rules: Callable[[Column], Column] = text_rules) -> DataFrame:
    """(doc_id, part, mask, good, toxic) of every row: bit k of the mask is rule k's, the bit after them that of repeated texts."""
    n = 4 if rules is text_rules else F.size(rules(F.lit("")))
    bits = F.aggregate(F.transform(rules(F.col("text")), lambda x, k: F.when(x, F.call_function("shiftleft", F.lit(1), k)).otherwise(0)), F.lit(0), lambda a, b: a + b)
    digest = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), bits.alias("bits"), digest.alias("digest"))
    rows = materialize(rows, "audit-masks")
    first = rows.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    fails = F.col("doc_id").isNotNull() & F.col("first").isNull()
    marked = rows.join(first, ["digest", "doc_id"], "left").withColumn("mask", F.col("bits") + F.when(fails, F.call_function("shiftleft", F.lit(1), F.lit(n))).otherwise(0))
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")))
    known = marked.join(said, "doc_id", "left")
    return known.select("doc_id", "part", "mask", *(F.coalesce(F.col(c), F.lit(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))


def polynomials(marked: DataFrame, n: int) -> DataFrame:
    """part, docs, and the coefficients a_T of the removal polynomials of all, good and toxic documents; T counts in binary."""
    kinds = {"all": F.lit(1), "good": F.col("good"), "toxic": F.col("toxic")}
    counts = marked.groupBy("part", "mask").agg(*(F.sum(x.cast("long")).alias(c) for c, x in kinds.items()))
    rows = counts.groupBy("part").agg(F.sum("all").alias("docs"), F.collect_list(F.struct("mask", *kinds)).alias("of"))  # a row for each mask, 2^n at most
    subsets = F.array(*map(F.lit, range(1 << n)))
    odd = F.array(*(F.lit(t.bit_count() % 2 * 2 - 1 if t else 0) for t in range(1 << n)))

    def coefficients(kind: str) -> Column:
        holding = lambda t: F.aggregate("of", F.lit(0).cast("long"), lambda s, c: s + F.when(c["mask"].bitwiseAND(t) == t, c[kind]).otherwise(0))
        return F.transform(subsets, lambda t: holding(t) * F.get(odd, t)).alias(kind)

    return rows.select("part", "docs", *map(coefficients, kinds))


def corners(coefficients: Column, n: int) -> Column:
    """The polynomial's values where the variables of a set are 1 and the others 0, by set."""
    subsets = F.array(*map(F.lit, range(1 << n)))
    terms = lambda s: F.transform(coefficients, lambda a, t: F.when(s.bitwiseAND(t) == t, a).otherwise(0))
    return F.transform(subsets, lambda s: F.aggregate(terms(s), F.lit(0).cast("long"), lambda x, a: x + a))


def shapley_numerators(coefficients: Column, n: int) -> Column:
    """Of each filter, the integral of the partial derivative on the diagonal, times the least common multiple of 1 to n."""
    lcm = math.lcm(*range(1, n + 1))
    share = [F.array(*(F.lit(lcm // t.bit_count() if t >> k & 1 else 0) for t in range(1 << n))) for k in range(n)]
    return F.array(*(F.aggregate(F.zip_with(coefficients, share[k], lambda a, q: a * q), F.lit(0).cast("long"), lambda x, a: x + a) for k in range(n)))


def audit(marked: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row for every part, order of the filters and step; marked: (part, mask, good, toxic).

    shapley is n! times the Shapley value: the documents that the step's filter removes, summed over all orders.
    """
    n, orders = len(letters), ["".join(p) for p in permutations(letters)]
    parts = polynomials(marked, n)
    parts = parts.select("part", "docs", *(corners(F.col(c), n).alias(c) for c in ("all", "good", "toxic")), shapley_numerators(F.col("all"), n).alias("values"))
    steps = parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.array(*map(F.lit, range(1, n + 1)))))
    place = lambda k: F.instr("filter_order", letters[k])
    before = sum((F.when(place(k) < F.col("step"), 1 << k).otherwise(0) for k in range(n)), F.lit(0))
    own = sum((F.when(place(k) == F.col("step"), k).otherwise(0) for k in range(n)), F.lit(0))
    steps = steps.withColumns({"before": before, "own": own}).withColumn("bit", F.call_function("shiftleft", F.lit(1), F.col("own")))
    step = lambda kind: F.get(kind, F.col("before") + F.col("bit")) - F.get(kind, F.col("before"))
    whole = (1 << n) - 1
    return steps.select(
        "part",
        "filter_order",
        "step",
        (F.col("docs") - F.get("all", F.col("before") + F.col("bit"))).alias("kept"),
        step("all").alias("removed"),
        (F.get("all", F.col("bit")) - step("all")).alias("redundant"),
        (F.get("all", F.lit(whole)) - F.get("all", F.lit(whole) - F.col("bit"))).alias("unique_fails"),
        step("good").alias("good_lost"),
        step("toxic").alias("toxic_lost"),
        (F.get("values", F.col("own")) * F.lit(math.factorial(n) // math.lcm(*range(1, n + 1)))).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """audit() of the filters A to E over all of ``docs``."""
    with scratch() as keep:
        marked = keep(materialize(failing(docs, labels).drop("doc_id"), "audit-marked"))
    return audit(marked)


#: Equivalent DuckDB SQL: every order applied step by step to the numbers of documents by what they fail.
FILTER_AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
f AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
    count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c3.x || c4.x || c5.x AS filter_order FROM c a, c b, c c3, c c4, c c5
  WHERE len(list_distinct([a.x, b.x, c3.x, c4.x, c5.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS own, left(filter_order, step - 1) AS before, left(filter_order, step) AS upto FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN translate(fails, upto, '') = fails THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(fails, own) AND translate(fails, before, '') = fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, own) AND translate(fails, before, '') <> fails THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(fails, own) AND translate(fails, before, '') = fails THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, own) AND translate(fails, before, '') = fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""
