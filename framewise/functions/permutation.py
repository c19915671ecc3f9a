"""Keyed permutations of 0 .. n-1 as column expressions: a shuffled order is a map over rows, not a sort.

A Feistel network over pairs (left, right) with left < a and right < b, where a * b is n or little more: each
round adds a keyed function of one half to the other, which can be undone, so the whole is a bijection of
0 .. a*b-1. Values that end at n or above go through the network again (cycle walking) until they are below; the
rest of that cycle does so too, so what is left is a bijection of 0 .. n-1. a*b - n is below a, so few values
walk, and no walk is longer than a*b - n + 1.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rounds of the network; and steps of a walk at most, for pools so large that longer ones don't come up (they fail).
ROUNDS, WALK = 6, 200

# Primes near 2^31 and multipliers below them, so that products stay within 64 bits; what is divided off makes the function far from linear.
MODULI, FACTORS, CUTS = (2147483647, 2147483629), (1103515245, 1140671485), (1021, 61)


def round_keys(seed: int | str, rounds: int = ROUNDS) -> list[int]:
    """A key for each round, from the seed."""
    return [int(hashlib.md5(f"{seed}#{k}".encode()).hexdigest()[:7], 16) for k in range(rounds)]


def _keyed(x: Column, key: int) -> Column:
    """A function of a half and a key, of about 25 bits."""
    for factor, modulus, cut in zip(FACTORS, MODULI, CUTS, strict=True):
        x = F.call_function("div", (x * F.lit(factor) + F.lit(key)) % F.lit(modulus), F.lit(cut).cast("long"))
    return x


def _let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` worked out once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sides(n: int) -> tuple[int, int]:
    """(a, b): the least a with a * a >= n, and the least b with a * b >= n."""
    a = max(1, math.isqrt(n - 1) + 1) if n > 0 else 1
    return a, -(-n // a) or 1


def network(x: Column, a: Column, b: Column, keys: list[int]) -> Column:
    """One pass of x through the network."""
    left, right = F.call_function("div", x, b), x % b
    for k, key in enumerate(keys):
        if k % 2:
            right = (right + _keyed(left, key)) % b
        else:
            left = (left + _keyed(right, key)) % a
    return left * b + right


def permuted(ordinal: Column, n: Column | int, seed: int | str) -> Column:
    """The place of each ordinal 0 .. n-1 in the order that the seed gives; a bijection. Null for other ordinals.

    With a column n the sides are worked out for each row. The ordinal stands in the expression once, so that
    permutations of permuted places stay small when Spark puts them together.
    """
    x, keys = ordinal.cast("long"), round_keys(seed)
    if isinstance(n, int):
        a, b = sides(n)
        return _let(x, lambda v: _walked(v, *(F.lit(k).cast("long") for k in (n, a, b)), keys))
    n = n.cast("long")
    root = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    least = _let(root, lambda r: F.greatest(F.lit(1).cast("long"), F.when((r - 1) * (r - 1) >= n, r - 1).otherwise(r)))
    sized = _let(least, lambda a: F.struct(x.alias("x"), n.alias("n"), a.alias("a"), F.greatest(F.lit(1).cast("long"), F.call_function("div", n + a - 1, a)).alias("b")))
    return _let(sized, lambda s: _walked(s["x"], s["n"], s["a"], s["b"], keys))


def _walked(x: Column, n: Column, a: Column, b: Column, keys: list[int]) -> Column:
    def walk(first: Column) -> Column:
        steps = F.sequence(F.lit(1).cast("long"), F.least(F.lit(WALK).cast("long"), a * b - n + 1))
        last = F.aggregate(steps, first, lambda v, _: F.when(v < n, v).otherwise(network(v, a, b, keys)))
        return _let(last, lambda v: F.when(v < n, v).otherwise(F.raise_error(F.lit("a walk is longer than WALK steps")).cast("long")))

    place = _let(network(x, a, b, keys), lambda v: F.when(v < n, v).otherwise(walk(v)))
    return F.when((x >= 0) & (x < n), place)


def permutation_sql(seed: int | str, rows: str, name: str) -> str:
    """DuckDB SQL of a table ``name`` (ordinal, n, place) with the same places over the query ``rows`` (ordinal, n), as the part of a WITH clause."""
    keys = round_keys(seed)

    def keyed(half: str, key: int) -> str:
        for factor, modulus, cut in zip(FACTORS, MODULI, CUTS, strict=True):
            half = f"((({half} * {factor}::BIGINT + {key}) % {modulus}) // {cut})"
        return half

    def after(half: str, odd: int, other: str, size: str) -> str:
        return " ".join(["CASE k", *(f"WHEN {k} THEN ({half} + {keyed(other, key)}) % {size}" for k, key in enumerate(keys) if k % 2 == odd), f"ELSE {half} END"])

    end = len(keys)
    return f"""{name} AS (
  WITH RECURSIVE s AS (SELECT ordinal::BIGINT AS ordinal, n::BIGINT AS n, greatest(1, ceil(sqrt(n)))::BIGINT AS a FROM ({rows})),
  b AS (SELECT *, greatest(1, (n + a - 1) // a) AS b FROM s),
  r AS (
    SELECT ordinal, n, a, b, ordinal // b AS l, ordinal % b AS r, 0 AS k FROM b
    UNION ALL
    SELECT ordinal, n, a, b, CASE k WHEN {end} THEN (l * b + r) // b ELSE {after("l", 0, "r", "a")} END, CASE k WHEN {end} THEN (l * b + r) % b ELSE {after("r", 1, "l", "b")} END, (k + 1) % {end + 1}
    FROM r WHERE k < {end} OR l * b + r >= n)
  SELECT ordinal, n, l * b + r AS place FROM r WHERE k = {end} AND l * b + r < n)"""
