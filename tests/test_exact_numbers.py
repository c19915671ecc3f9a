"""Rounding as Python's, p-values in columns, and quantiles from one scan."""

import math
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from framewise.functions.arrays import exact_round
from framewise.operators import stats
from framewise.operators.quantiles import quantiles

DIGITS = (2, 4, 6)


def test_rounding_equals_python(spark, tmp_path):
    """A million numbers: random ones of many sizes, ties that are exact in binary, and the neighbours of decimal ties."""
    rnd = random.Random(7)
    xs = [rnd.uniform(-1, 1) * 10 ** rnd.randint(-8, 12) for _ in range(400_000)]
    xs += [(2 * rnd.randint(0, 10**6) + 1) / 2 ** rnd.randint(1, 12) * rnd.choice((1, -1)) for _ in range(200_000)]
    for d in DIGITS:
        near = [(rnd.randint(0, 10**7) + 0.5) / 10**d for _ in range(50_000)]
        xs += near + [math.nextafter(x, math.inf) for x in near] + [math.nextafter(x, 0) for x in near]
    xs += [0.0, -0.0, 0.5, 2.5, 0.1234565, 2.675, 1e300, -1e300, 5e-324, 9007199254740993.0, 1e15 + 0.3, float("inf"), float("-inf")]
    assert len(xs) > 1_000_000
    cols = {"x": xs} | {f"r{d}": [x if math.isinf(x) else round(x, d) for x in xs] for d in DIGITS}
    pq.write_table(pa.table(cols), tmp_path / "n.parquet")
    df = spark.read.parquet(str(tmp_path / "n.parquet"))
    wrong = df.select("x", *(exact_round("x", d).alias(f"s{d}") for d in DIGITS), *(f"r{d}" for d in DIGITS)).filter(" OR ".join(f"s{d} <> r{d}" for d in DIGITS))
    assert wrong.limit(5).collect() == []
    r = spark.range(1).select(exact_round(F.lit(None).cast("double"), 2).alias("a"), exact_round(F.lit(float("nan")), 2).alias("b"), exact_round(F.lit(7), 0).alias("c")).first()
    assert r.a is None and math.isnan(r.b) and r.c == 7.0
    with pytest.raises(ValueError):
        exact_round("x", -1)


def test_p_values(spark):
    rows = [(n, r) for n in (3, 4, 5, 12, 100, 5000, 10**6) for r in (-0.99, -0.5, -0.003, 1e-9, 0.0, 0.02, 0.3, 0.9, 1.0)] + [(2, 0.5), (5, None), (5, float("nan"))]
    got = spark.createDataFrame(rows, "n long, r double").select("n", "r", stats.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()
    for x in got:
        if x.n < 3 or x.r is None or math.isnan(x.r):
            assert math.isnan(x.p)
            continue
        want = 0.0 if abs(x.r) >= 1 else stats.student_t_two_sided(x.r * math.sqrt((x.n - 2) / (1 - x.r * x.r)), x.n - 2)
        assert x.p == pytest.approx(want, rel=1e-6, abs=1e-12), x
    assert "Python" not in spark.createDataFrame(rows, "n long, r double").select(stats.correlation_p(F.col("r"), F.col("n")))._jdf.queryExecution().executedPlan().toString()


def test_quantiles_beyond_the_bound_read_their_input_once(spark, tmp_path):
    spark.range(5000).selectExpr("id % 3 AS k", "cast((id * 7919) % 1009 AS double) AS v").write.parquet(str(tmp_path / "q"))
    df = spark.read.parquet(str(tmp_path / "q"))
    few = quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.99}, small=10)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path) not in plan  # only the counts are read from here on
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.99}).collect()}


def _unsteady(of, kind: str):
    """A function of a group's values whose last digits differ each time that it is worked out, as those do that depend on the order of merging."""
    return F.udf(of, kind).asNondeterministic()


def test_quantiles_hold_when_the_cuts_come_out_otherwise_each_time(spark, monkeypatch):
    df = spark.range(6000).selectExpr("id % 3 AS k", "cast((id * 7919) % 2003 AS double) AS v")
    shares = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.75, "e": 0.99}
    want = {by: sorted(map(tuple, quantiles(df, list(by), "v", shares).collect())) for by in ((), ("k",))}
    cuts = _unsteady(lambda xs: sorted(random.sample(xs, 63)), "array<double>")
    monkeypatch.setattr(F, "percentile_approx", lambda c, *_: cuts(F.collect_list(c)))
    for by, rows in want.items():
        got = sorted(map(tuple, quantiles(df, list(by), "v", shares, small=10).collect()))
        assert len(got) == len(rows) and all(x == pytest.approx(y) for x, y in zip(got, rows, strict=True))


def test_violin_against_all_pairs(spark):
    rnd = random.Random(3)
    groups = {"a": [rnd.gauss(0, 1) for _ in range(500)], "b": [rnd.expovariate(0.1) for _ in range(300)] + [500.0], None: [1.0, 2.0], "one": [3.0], "same": [4.0] * 9}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("a", None), ("a", float("nan")), ("a", float("inf")), ("nothing", None)]
    got = stats.violin(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], 50).collect()
    assert {r.g for r in got} == {"a", "b", None} and len(got) == 150
    for g in ("a", "b", None):
        xs = groups[g]
        n, mean = len(xs), sum(xs) / len(xs)
        h = n**-0.2 * math.sqrt(sum((x - mean) ** 2 for x in xs) / (n - 1))
        full = lambda at: sum(math.exp(-0.5 * ((at - x) / h) ** 2) for x in xs) / (n * h * math.sqrt(2 * math.pi))  # noqa: B023, E731
        own = sorted((r for r in got if r.g == g), key=lambda r: r.k)
        peak = max(full(r.x) for r in own)
        assert [r.k for r in own] == list(range(50)) and own[0].x == min(xs) and own[-1].x == pytest.approx(max(xs))
        assert all(abs(r.density - full(r.x)) < 1e-4 * peak for r in own)


def test_violin_has_each_place_once_when_the_deviation_comes_out_otherwise_each_time(spark, monkeypatch):
    df = spark.range(2000).selectExpr("id % 3 AS g", "cast((id * 7919) % 1009 AS double) AS v")
    want = {(r.g, r.k): r.density for r in stats.violin(df, "v", ["g"], 20).collect()}
    deviation, near = F.stddev_samp, _unsteady(lambda x: x * (1 + random.randint(1, 10**6) * 2**-50), "double")
    monkeypatch.setattr(F, "stddev_samp", lambda c: near(deviation(c)))
    got = stats.violin(df, "v", ["g"], 20).collect()
    assert len(got) == len(want) == 60 and all(r.density == pytest.approx(want[r.g, r.k], rel=1e-6) for r in got)
