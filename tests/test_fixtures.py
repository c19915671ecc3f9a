"""Boundary cases worked by hand from the formulas."""

import math

import pytest
from pyspark.sql import functions as F

from framewise.functions import arrays, text
from framewise.operators import chunks, dataset, manifest, motion, qc, stats
from framewise.params import Corruption, QcLimits, SafeZone, Split, splits
from framewise.sources import motion_params


def series(spark, values, run="r"):
    return spark.createDataFrame([(run, k, float(v)) for k, v in enumerate(values)], "run string, vol int, fd double")


PAR = [(0,) * 6, (0.01, 0, 0, 0.5, 0, 0), (0.01, 0.002, 0, 0.5, -0.2, 0), (0,) * 6]


def fd_of(spark, rows):
    df = spark.createDataFrame([("r", k, *map(float, r)) for k, r in enumerate(rows)], "run string, vol int, a double, b double, c double, x double, y double, z double")
    cols = [F.col(c) for c in "abcxyz"]
    return motion.framewise_displacement(df, ["run"], "vol", cols[:3], cols[3:])


def test_displacement(spark):
    got = [r.fd for r in fd_of(spark, PAR).orderBy("vol").collect()]
    assert got == pytest.approx([0, 1.0, 0.3, 1.3])
    assert [r.fd for r in fd_of(spark, PAR[:1]).collect()] == [0.0]


def test_chunk_fd(spark):
    fd = fd_of(spark, PAR).select("run", "vol", "fd")
    chunk = spark.createDataFrame([("r", 1, 3)], "run string, chunk_start int, chunk_end int")
    r = motion.chunk_fd(chunk, fd, ["run"], "vol").first()
    assert (r.par_fd_mean, r.par_fd_max, r.par_fd_std) == pytest.approx((0.8, 1.3, 0.5))
    assert (r.run_fd_mean, r.run_fd_max) == pytest.approx((0.8666667, 1.3))


@pytest.mark.parametrize("n,size,step,want", [(25, 20, 1, 6), (25, 20, 2, 3), (19, 20, 1, 0)])
def test_window_count(spark, n, size, step, want):
    s = series(spark, range(n))
    assert chunks.sliding_windows(s, ["run"], "vol", "fd", Corruption(size=size, step=step)).count() == want


def test_streak_counts_equality(spark):
    df = spark.createDataFrame([([1.0, 2.0, 0.9, 1.0, 1.0, 1.0, 0.0],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(chunks.longest_streak(F.col("v"), 1.0)).collect()] == [3, 0]


def test_maximum_is_strict_and_fraction_is_not(spark):
    p = Corruption(size=4, threshold=1.0, min_fraction=0.5, min_streak=1, min_mean=1.0, max_fd=10.0)
    assert chunks.corrupted_chunks(series(spark, [10, 1, 0, 0]), ["run"], "vol", "fd", p).count() == 0
    assert chunks.corrupted_chunks(series(spark, [9.99, 1, 0, 0]), ["run"], "vol", "fd", p).count() == 1


@pytest.mark.parametrize("spikes,safe", [([10], [*range(5), *range(21, 30)]), ([1, 28], list(range(12, 23)))])
def test_dilation(spark, spikes, safe):
    s = series(spark, [1.0 if k in spikes else 0.0 for k in range(30)])
    got = chunks.safe_volumes(s, ["run"], "vol", "fd", SafeZone()).filter("safe").orderBy("vol")
    assert [r.vol for r in got.collect()] == safe


def test_safe_chunks_drop_remainders(spark):
    s = series(spark, [1.0 if k == 10 else 0.0 for k in range(30)])
    got = chunks.safe_chunks(s, ["run"], "vol", "fd", SafeZone(size=4)).orderBy("chunk_start").collect()
    assert [(r.chunk_start, r.chunk_end) for r in got] == [(0, 3), (21, 24), (25, 28)]
    assert got[0].n_safe_vols_in_run == 14 and got[0].n_total_vols_in_run == 30


def test_entities(spark):
    df = spark.createDataFrame([("sub-ICC157_ses-2_task-rest10_run-001",), ("sub-X1_task-videos",), (None,)], "k string")
    got = [tuple(r) for r in df.select(*text.entities("k")).collect()]
    assert got == [("ICC157", "2", "rest10", "001"), ("X1", "unknown", "videos", "unknown"), ("unknown",) * 4]


def test_zfill_and_mask(spark):
    df = spark.createDataFrame([("1", "ICC155"), ("12", "ICC155A"), ("001", "a"), ("1234", "A")], "r string, s string")
    got = df.select(text.zfill("r", 3), text.mask_kind("s")).collect()
    assert [r[0] for r in got] == ["001", "012", "001", "1234"]
    assert [r[1] for r in got] == ["younger", "older", "younger", "older"]


def test_split_sizes(spark):
    df = spark.createDataFrame([(f"s{k}",) for k in range(20)] * 2, "subject string")
    got = dataset.subject_split(df, "subject", Split())
    n = {r.split: r["count"] for r in got.groupBy("split").count().collect()}
    assert n == {"train": 14, "val": 3, "test": 3}
    assert got.select("subject").distinct().count() == 20
    assert got.orderBy("subject").collect() == dataset.subject_split(df.repartition(7), "subject", Split()).orderBy("subject").collect()


@pytest.mark.parametrize("pool,n,want", [(5, 8, 5), (9, 4, 4)])
def test_balance(spark, pool, n, want):
    df = spark.createDataFrame([("d", k) for k in range(pool)], "domain string, id int")
    got = dataset.balanced_sample(df, "domain", "id", n)
    assert got.count() == want == got.distinct().count()


@pytest.mark.parametrize("a,b,ok", [(0, 29, True), (11, 30, False), (-1, 18, False), (5, 4, False)])
def test_slices(spark, a, b, ok):
    df = spark.createDataFrame([(a, b, 30)], "a int, b int, n int")
    assert (df.select(dataset.slice_status(F.col("a"), F.col("b"), F.col("n"))).first()[0] == "ok") is ok


def test_manifest_upsert(spark):
    old = spark.createDataFrame([("p1", "processed", 20), ("", "error", None)], "input_path string, status string, n int")
    new = spark.createDataFrame([("p1", "skipped", None), ("p2", "processed", 20), ("", "error", None)], "input_path string, status string, n int")
    got = sorted((r.input_path, r.status) for r in manifest.upsert(old, new).collect())
    twice = spark.createDataFrame([("p1", "b", 1), ("p1", "a", 2)], "input_path string, status string, n int")
    for parts in (1, 5):
        assert [r.status for r in manifest.upsert(old.limit(0), twice.repartition(parts), order=["n"]).collect()] == ["a"]
    assert got == [("", "error"), ("", "error"), ("p1", "skipped"), ("p2", "processed")]


def test_verification_limits(spark):
    """Mean signal must be above 1; a shape that differs ends the checks; nothing is said of a file that isn't there."""
    schema = "output_path string, load_error string, input_shape string, output_shape string, n_volumes long, n_brain_voxels long, n_nonzero_outside_brain long, n_outside long, mean_signal_brain double, n_zero_volumes long"
    rows = [(p, e, "(2, 2)", s, 5, 3, z, 4, m, 0) for p, e, s, z, m in (("a", None, "(2, 2)", 0, 1.5), ("b", None, "(2, 2)", 0, 1.0), ("c", None, "(2, 3)", 9, 0.0), ("d", "bad", None, 0, 2.0), ("e", "", "(2, 2)", 1, 0.5))]
    expected = spark.createDataFrame([(x,) for x in "abcdef"], "output_path string")
    got = {r.output_path: r for r in manifest.verification(expected, spark.createDataFrame(rows, schema)).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "PASS", "b": "FAIL", "c": "FAIL", "d": "FAIL", "e": "FAIL", "f": "MISSING"}
    assert got["b"].notes == "Brain signal unexpectedly low." and got["c"].notes == "Shape mismatch: input=(2, 2) output=(2, 3)" and got["c"].mean_signal_brain is None
    assert got["d"].notes == "Load error: bad" and got["f"].notes == "" and got["e"].pct_outside_zeroed == 75.0


def test_summary(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 4.0, 8.0, math.nan)], "m double")
    r = qc.distribution_summary(df, ["m", "absent"]).first()
    assert (r.n, r["mean"], r["median"], r.q25, r.q75, r["min"], r["max"]) == (4, 3.75, 3.0, 1.75, 5.0, 1.0, 8.0)
    assert r["std"] == pytest.approx(3.095696, abs=1e-6)


def test_flags_are_strict(spark):
    df = spark.createDataFrame([(0.5, 10.0), (0.6124, 9.5), (math.nan, None)], "par_fd_mean double, tsnr_mean double")
    got = qc.qc_flags(df, QcLimits()).collect()
    assert [r.qc_flags for r in got] == ["high_fd_mean:0.612|low_tsnr:9.50"]


def test_bins(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.5, 2.0, 2.1, -0.1)], "x double")
    edges = [F.lit(0.0), F.lit(1.0), F.lit(2.0)]
    assert [r[0] for r in df.select(arrays.bin_index(F.col("x"), edges)).collect()] == [0, 0, 1, 1, None, None]


def test_scores_and_rates(spark):
    one = spark.range(1)
    score = arrays.validation_score(F.lit(1.0), F.lit(0.5), F.lit(0.1), F.lit(1.3))
    assert one.select(score).first()[0] == pytest.approx(-0.4)
    rates = spark.range(31).select("id", arrays.learning_rate(F.col("id"), 1.0, 30).alias("r"))
    by = {r.id: r.r for r in rates.collect()}
    assert by[0] == pytest.approx(1e-6) and by[5] == 1.0 and by[19] == 1.0 and by[30] == pytest.approx(1e-6)


def test_epoch_queue_discards_the_rest(spark):
    a = spark.createDataFrame([(k,) for k in range(7)], "id int")
    got = dataset.epoch_queue(a, "id", 3)
    assert got.count() == 6 == got.select("id").distinct().count()
    assert sorted(r[0] for r in got.select("epoch").distinct().collect()) == [0, 1]
    again = dataset.epoch_queue(a, "id", 3, cycle=1)
    assert sorted(r[0] for r in again.select("epoch").distinct().collect()) == [2, 3]
    assert dataset.epoch_queue(a, "id", 10).count() == 10


def test_student_t():
    assert stats.student_t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert stats.student_t_two_sided(12.7062, 1) == pytest.approx(0.05, abs=1e-6)
    assert stats.student_t_two_sided(0.0, 5) == 1.0


def test_density(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 400)
    y = 0.5 * x + rng.normal(0, 2, 400)
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y, strict=True)] + [("few", 1.0, 2.0)], "g string, x double, y double")
    got = stats.density(df, "x", "y", "g").toPandas()
    assert set(got.g) == {"g"} and len(got) == 400
    pts = np.stack([got.x, got.y])
    cov = np.cov(pts) * 400 ** (-1 / 3)
    d = pts[:, :, None] - pts[:, None, :]
    want = np.exp(-0.5 * np.einsum("iab,ij,jab->ab", d, np.linalg.inv(cov), d)).sum(0) / (400 * 2 * np.pi * np.sqrt(np.linalg.det(cov)))
    assert np.abs(got.density / want - 1).max() < 0.02


@pytest.mark.parametrize("bad", [dict(size=0), dict(min_fraction=0), dict(min_streak=21), dict(threshold=11)])
def test_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        Corruption(**bad)


def test_split_names():
    assert splits() == ["val", "test"] and splits(["test", "train", "test"]) == ["train", "test"]
    with pytest.raises(ValueError):
        splits(["all"])


def test_required_columns(spark):
    with pytest.raises(ValueError, match="b"):
        dataset.require_columns(spark.range(1), ["id", "b"])


def test_motion_files(spark, tmp_path):
    (tmp_path / "a.par").write_bytes(b"# head\r\n0 0 0 0 0 0\r\n\r\n 1e-2\t0 0  .5 0 0 \r\n")
    (tmp_path / "b.par").write_text("1 2 3 4 5 6")
    (tmp_path / "c.par").write_text("1 2 3 4 5\n1 2 3 4 5\n")
    got = motion_params.read_motion_parameters(spark, str(tmp_path), "skip").collect()
    rows = sorted((r.path[-5], r.vol, r.rot_x, r.trans_x) for r in got)
    assert rows == [("a", 0, 0.0, 0.0), ("a", 1, 0.01, 0.5), ("b", 0, 1.0, 4.0)]
    null = motion_params.read_motion_parameters(spark, str(tmp_path), "null")
    assert null.count() == 5 and null.filter("rot_x IS NULL").count() == 2
    assert [(r.path[-5:], r.problem) for r in motion_params.bad_files(spark, str(tmp_path)).collect()] == [("c.par", "not six columns")]
    with pytest.raises(Exception, match="six columns"):
        motion_params.read_motion_parameters(spark, str(tmp_path)).collect()
    (tmp_path / "c.par").write_text("1 2 3 4 5 x\n1 2 3 4 5 6\n")
    assert motion_params.read_motion_parameters(spark, str(tmp_path), "null").filter("rot_x IS NULL").count() == 2  # the whole file


def test_ranks_of_rows_with_payload(spark):
    """Ranks are 1..n whatever other columns there are, ties of partitions, nulls and strings included."""
    from framewise.operators.ranks import ordered_rank

    df = spark.range(50_000).selectExpr("xxhash64(id) % 30000 AS a", "CASE WHEN id % 7 > 0 THEN md5(string(id)) END AS b", "id AS c", "repeat('x', 20) AS more")
    got = ordered_rank(df, ["a", "b", "c"], parts=23).toPandas()
    assert sorted(got["rank"]) == list(range(1, 50_001))
    keys = [(a, b is not None, b or "", c) for a, b, c in got.sort_values("rank")[["a", "b", "c"]].astype(object).itertuples(index=False, name=None)]
    assert keys == sorted(keys)
    assert ordered_rank(df.limit(0), ["a"]).count() == 0


def test_quantiles_beyond_one_task(spark):
    from framewise.operators.quantiles import quantiles

    df = spark.range(5_000).selectExpr("id % 3 AS g", "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 2 = 0 THEN 7.0 ELSE double(xxhash64(id) % 1000) END AS v")
    shares = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    for by in (["g"], []):
        small = sorted(map(tuple, quantiles(df, by, "v", shares).collect()))
        large = sorted(map(tuple, quantiles(df, by, "v", shares, small=10).collect()))
        assert len(small) == len(large) and all(x == pytest.approx(y) for x, y in zip(small, large, strict=True))


def test_running_best_in_ranges(spark):
    df = spark.range(3_000).selectExpr("id % 4 AS g", "id AS k", "double(xxhash64(id) % 500) AS v", "'x' AS more")
    got = sorted(map(tuple, stats.running_best(df, ["k"], "v", ["g"], parts=17).select("g", "k").collect()))
    best, want = {}, []
    for r in df.orderBy("k").collect():
        if r.v > best.get(r.g, float("-inf")):
            best[r.g] = r.v
            want.append((r.g, r.k))
    assert got == sorted(want)


def test_infinities_are_flagged_and_summed_up(spark):
    df = spark.createDataFrame([(math.inf, -math.inf), (0.1, 20.0), (math.nan, math.nan)], "par_fd_mean double, tsnr_mean double")
    assert [r.qc_flags for r in qc.qc_flags(df).collect()] == ["high_fd_mean:inf|low_tsnr:-inf"]
    r = qc.distribution_summary(df, ["par_fd_mean"]).first()
    assert (r.n, r["max"], r["min"]) == (2, math.inf, 0.1)


def test_safe_chunks_hold_no_spike(spark):
    import random

    rnd = random.Random(3)
    values = [rnd.expovariate(8) for _ in range(400)]
    p = SafeZone(size=7, before=2, after=3)
    spikes = [k for k, v in enumerate(values) if v >= p.threshold]
    for r in chunks.safe_chunks(series(spark, values), ["run"], "vol", "fd", p).collect():
        assert r.chunk_end - r.chunk_start == 6
        assert not any(r.chunk_start - p.after <= s <= r.chunk_end + p.before for s in spikes)
