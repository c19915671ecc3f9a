"""Quality rules on documents and on their hosts, with DataFrame functions only.

Every document gets a few counts over its whole text and a verdict from each rule. The share of
failing documents of each host (here: ``source``) is shrunk towards an empirical beta prior, whose
two parameters are fitted to all hosts by moments; the host's verdict then goes back to its documents.

Defined results: a null or empty text has no words and fails the base rules; a null host is a host
of its own; repeated rows each get a row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_lookup, let, materialize

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class HostRules:
    """Rates are integers in hundredths, so that verdicts need no floating point."""

    min_words: int = 50
    max_repeat: int = 50  # per 100 words
    symbols: tuple[int, int] = (10, 30)  # strict, lenient: per 100 words
    dup_lines: tuple[int, int] = (20, 50)  # strict, lenient: per 100 lines with a word
    word_chars: tuple[int, int] = (1200, 2000)  # strict, lenient: per 100 words
    suspect: float = 0.4  # shrunk failure rates from which hosts are suspect, or rejected
    reject: float = 0.8
    max_strength: float = 1e6


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _repeat_words(w: Column) -> Column:
    """Words covered by 3-word windows that the text has twice or more.

    Windows are sorted by their 64-bit hashes and places, which puts equal ones side by side; the covered
    words are summed over the sorted places.
    """
    n = F.size(w)

    def starts(sorted_: Column) -> Column:
        at = lambda j: F.get(sorted_, j)["h"]
        same = lambda x, j: F.coalesce(at(j - 1) == x["h"], F.lit(False)) | F.coalesce(at(j + 1) == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(sorted_, same), lambda x: x["i"]))

    hashed = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    windows = F.sort_array(
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(hashed(i).alias("h"), i.cast("long").alias("i")))
    )
    covered = lambda s: F.aggregate(
        F.transform(s, lambda x, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get(s, j + 1), x + 3) - x)),
        F.lit(0).cast("long"),
        lambda a, b: a + b,
    )
    found = let(windows, lambda p: let(starts(p), covered))
    return F.when(n >= 3, found).otherwise(F.lit(0).cast("long"))


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    counted = F.transform(
        F.array(F.struct(words(text).alias("w"), lines.alias("l"))),
        lambda s: F.struct(
            F.size(s["w"]).cast("long").alias("n_words"),
            F.length(F.array_join(s["w"], "")).cast("long").alias("word_chars"),
            (F.size(s["l"]) - F.size(F.array_distinct(s["l"]))).cast("long").alias("n_dup_lines"),
            let(s["w"], _repeat_words).alias("n_repeat_words"),
            F.size(s["l"]).cast("long").alias("n_lines"),
        ),
    )
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")
    out = docs.select("doc_id", "source", symbols.alias("n_symbols"), F.explode(counted).alias("c"))
    return out.select(
        "doc_id", "source", "c.n_words", "c.word_chars", "n_symbols", "c.n_dup_lines", "c.n_repeat_words", "c.n_lines"
    )


def document_rules(counts: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """Adds base_failed and the number of strict and lenient rules that each document fails."""
    n, lines = F.col("n_words"), F.col("n_lines")

    def failed(k: int) -> Column:
        tests = (
            100 * F.col("n_symbols") > rules.symbols[k] * n,
            100 * F.col("n_dup_lines") > rules.dup_lines[k] * lines,
            100 * F.col("word_chars") > rules.word_chars[k] * n,
        )
        return sum((t.cast("int") for t in tests[1:]), tests[0].cast("int"))

    base = (n < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat * n)
    return counts.withColumns({"base_failed": base, "strict": failed(0), "lenient": failed(1)})


def host_verdicts(ruled: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """source, host_docs, host_failed, host_rate (shrunk) and host_verdict: trust, suspect or reject."""
    bad = (F.col("base_failed") | (F.col("strict") > 0)).cast("long")
    hosts = ruled.groupBy("source").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(bad).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"))
    spread = F.when(F.col("v") > 0, F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(F.lit(rules.max_strength))
    prior = prior.select("m", F.greatest(F.lit(1.0), F.least(F.lit(rules.max_strength), spread)).alias("strength"))
    shrunk = (F.col("host_failed") + F.col("m") * F.col("strength")) / (F.col("host_docs") + F.col("strength"))
    verdict = (
        F.when(F.col("host_rate") >= rules.reject, "reject")
        .when(F.col("host_rate") >= rules.suspect, "suspect")
        .otherwise("trust")
    )
    # the prior is one row
    return hosts.join(F.broadcast(prior)).withColumn("host_rate", shrunk).withColumn("host_verdict", verdict).drop("m", "strength")


def quality_rules(docs: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """Each document's counts, its host's verdict and ``kept``.

    A document goes if it fails a base rule or a lenient rule, if its host is rejected, or if its
    host is suspect and it fails a strict rule.
    """
    ruled = materialize(document_rules(document_counts(docs), rules), "quality-rules")
    joined = join_lookup(ruled, host_verdicts(ruled, rules), "source")
    kept = (
        ~F.col("base_failed")
        & (F.col("lenient") == 0)
        & (F.col("host_verdict") != "reject")
        & ((F.col("host_verdict") == "trust") | (F.col("strict") == 0))
    )
    return joined.withColumn("kept", kept).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_verdict"
    )


#: Equivalent DuckDB SQL, with the parameters of HostRules().
QUALITY_RULES_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         row_number() OVER () AS rid FROM documents),
g AS (
  SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
d AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY rid),
c AS (
  SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (rid)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 20 * n_lines OR 100 * word_chars > 1200 * n_words AS strict,
         100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 50 * n_lines OR 100 * word_chars > 2000 * n_words AS lenient
  FROM c),
h AS (SELECT source, count(*) AS n, count_if(base_failed OR strict) AS k FROM f GROUP BY source),
p AS (SELECT avg(k / n) AS m, var_pop(k / n) AS v FROM h),
s AS (SELECT m, greatest(1.0, least(1e6, CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1e6 END)) AS s FROM p),
hv AS (SELECT source, CASE WHEN (k + m * s) / (n + s) >= 0.8 THEN 'reject' WHEN (k + m * s) / (n + s) >= 0.4 THEN 'suspect' ELSE 'trust' END AS host_verdict
       FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT lenient AND host_verdict <> 'reject' AND (host_verdict = 'trust' OR NOT strict) AS kept, host_verdict
FROM f JOIN hv ON f.source IS NOT DISTINCT FROM hv.source
"""
