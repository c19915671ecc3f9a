"""Queries of motion and chunk selection, with independent DuckDB formulations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.operators import chunks, motion
from framewise.plans.series import EVENT_CORRUPTION, EVENT_SAFE, EVENTS_SQL, VECTORS_SQL, event_series, vector_series

KEY = ["run_key"]


def _rounded(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def fd_6dof(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vector_series(spark, sf_dir)
    x = [F.get("x", F.lit(k)) for k in range(6)]
    fd = motion.framewise_displacement(v, KEY, "vol", x[:3], x[3:])
    return _rounded(fd.select("run_key", "vol", "fd"), ["fd"])


FD_6DOF = f"""
WITH {VECTORS_SQL}
SELECT b.run_key, b.vol, round(coalesce(50 * (abs(b.x[1] - a.x[1]) + abs(b.x[2] - a.x[2]) + abs(b.x[3] - a.x[3]))
       + abs(b.x[4] - a.x[4]) + abs(b.x[5] - a.x[5]) + abs(b.x[6] - a.x[6]), 0), 4) AS fd
FROM v b LEFT JOIN v a ON a.run_key = b.run_key AND a.vol = b.vol - 1
"""


def corrupted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.corrupted_chunks(event_series(spark, sf_dir), KEY, "vol", "fd", EVENT_CORRUPTION)
    return _rounded(out, ["chunk_mean_fd", "chunk_max_fd", "frac_vols_above_thr"]).withColumn(
        "max_sustained_streak", F.col("max_sustained_streak").cast("long")
    )


CORRUPTED = f"""
WITH {EVENTS_SQL},
n AS (SELECT run_key, count(*) AS n FROM e GROUP BY run_key),
s AS (SELECT e.run_key, e.vol AS s FROM e JOIN n USING (run_key) WHERE e.vol + 20 <= n.n),
i AS (SELECT run_key, vol, vol - row_number() OVER (PARTITION BY run_key ORDER BY vol) AS island FROM e WHERE fd >= 50),
k AS (SELECT run_key, vol, row_number() OVER (PARTITION BY run_key, island ORDER BY vol) AS streak FROM i),
w AS (SELECT s.run_key, s.s, avg(e.fd) AS m, max(e.fd) AS x, count(*) FILTER (e.fd >= 50) AS a, max(least(coalesce(k.streak, 0), e.vol - s.s + 1)) AS streak
      FROM s JOIN e ON e.run_key = s.run_key AND e.vol BETWEEN s.s AND s.s + 19 LEFT JOIN k ON k.run_key = e.run_key AND k.vol = e.vol GROUP BY ALL)
SELECT w.run_key, s AS chunk_start, s + 19 AS chunk_end, round(m, 4) AS chunk_mean_fd, round(x, 4) AS chunk_max_fd, a AS n_vols_above_thr,
       round(a / 20, 4) AS frac_vols_above_thr, n.n AS n_total_vols_in_run, CAST(streak AS BIGINT) AS max_sustained_streak
FROM w JOIN n USING (run_key) WHERE a >= 10 AND streak >= 3 AND m >= 50 AND x < 500
"""


def chunk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of both kinds of chunks with their digits, rounded as Python does."""
    series = event_series(spark, sf_dir)
    corrupted = chunks.reported(chunks.corrupted_chunks(series, KEY, "vol", "fd", EVENT_CORRUPTION))
    safe = chunks.reported(chunks.safe_chunks(series, KEY, "vol", "fd", EVENT_SAFE)).withColumn("frac_vols_above_thr", F.lit(0.0))
    kept = ["run_key", "chunk_start", "chunk_end", "chunk_mean_fd", "chunk_max_fd", "frac_vols_above_thr"]
    return corrupted.select(F.lit("A_corrupted").alias("domain"), *kept).unionByName(safe.select(F.lit("B_motion_free").alias("domain"), *kept))


def safe_zone_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.safe_chunks(event_series(spark, sf_dir), KEY, "vol", "fd", EVENT_SAFE)
    return _rounded(out, ["chunk_mean_fd", "chunk_max_fd"])


_SAFE = f"""
{EVENTS_SQL},
safe AS (SELECT * FROM e WHERE NOT EXISTS (
  SELECT 1 FROM e p WHERE p.run_key = e.run_key AND p.fd >= 100 AND e.vol BETWEEN p.vol - 1 AND p.vol + 2)),
c AS (SELECT run_key, count(*) AS n_total_vols_in_run FROM e GROUP BY run_key),
sc AS (SELECT run_key, count(*) AS n FROM safe GROUP BY run_key)"""

SAFE_ZONE = f"""
WITH {_SAFE},
st AS (SELECT a.run_key, a.vol FROM safe a WHERE NOT EXISTS (SELECT 1 FROM safe b WHERE b.run_key = a.run_key AND b.vol = a.vol - 1)),
r AS (SELECT s.run_key, s.vol, s.fd, (SELECT max(st.vol) FROM st WHERE st.run_key = s.run_key AND st.vol <= s.vol) AS region FROM safe s),
g AS (SELECT run_key, region, (vol - region) // 5 AS k, min(vol) AS a, max(vol) AS b, avg(fd) AS m, max(fd) AS x, count(*) AS n FROM r GROUP BY ALL)
SELECT run_key, a AS chunk_start, b AS chunk_end, round(m, 4) AS chunk_mean_fd, round(x, 4) AS chunk_max_fd, sc.n AS n_safe_vols_in_run, n_total_vols_in_run
FROM g JOIN sc USING (run_key) JOIN c USING (run_key) WHERE g.n = 5
"""


#: A number printed to so many places is rounded by its exact binary value, halves to the even digit.
CHUNK_REPORT = f"""
WITH a AS ({CORRUPTED.replace("round(m, 4)", "format('{:.6f}', m)::DOUBLE").replace("round(x, 4)", "format('{:.6f}', x)::DOUBLE").replace("round(a / 20, 4)", "format('{:.4f}', a / 20)::DOUBLE")}),
b AS ({SAFE_ZONE.replace("round(m, 4)", "format('{:.6f}', m)::DOUBLE").replace("round(x, 4)", "format('{:.6f}', x)::DOUBLE")})
SELECT 'A_corrupted' AS domain, run_key, chunk_start, chunk_end, chunk_mean_fd, chunk_max_fd, frac_vols_above_thr FROM a
UNION ALL SELECT 'B_motion_free', run_key, chunk_start, chunk_end, chunk_mean_fd, chunk_max_fd, 0.0::DOUBLE FROM b
"""


def safe_volume_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.safe_counts(event_series(spark, sf_dir), KEY, "vol", "fd", EVENT_SAFE)


SAFE_COUNTS = f"""
WITH {_SAFE}
SELECT run_key, coalesce(sc.n, 0) AS n_safe_vols_in_run, n_total_vols_in_run FROM c LEFT JOIN sc USING (run_key)
"""


def _fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 20 volumes, one after another, of every run."""
    e = event_series(spark, sf_dir)
    cut = e.groupBy("run_key", F.floor(F.col("vol") / 20).alias("k")).agg(F.min("vol").alias("chunk_start"), F.max("vol").alias("chunk_end"))
    return cut.filter(F.col("chunk_end") - F.col("chunk_start") == 19).drop("k")


_FIXED = f"""
{EVENTS_SQL},
ch AS (SELECT run_key, min(vol) AS chunk_start, max(vol) AS chunk_end FROM e GROUP BY run_key, vol // 20 HAVING count(*) = 20)"""


def chunk_local_vs_run_fd(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = motion.chunk_fd(_fixed_chunks(spark, sf_dir), event_series(spark, sf_dir), KEY, "vol")
    return _rounded(out, ["run_fd_mean", "run_fd_max", "par_fd_mean", "par_fd_max", "par_fd_std"])


CHUNK_FD = f"""
WITH {_FIXED}
SELECT ch.run_key, chunk_start, chunk_end, round(avg(fd), 4) AS run_fd_mean, round(max(fd), 4) AS run_fd_max,
       round(avg(fd) FILTER (vol > chunk_start), 4) AS par_fd_mean, round(max(fd) FILTER (vol > chunk_start), 4) AS par_fd_max,
       round(stddev_pop(fd) FILTER (vol > chunk_start), 4) AS par_fd_std
FROM ch JOIN e ON e.run_key = ch.run_key AND e.vol BETWEEN chunk_start AND chunk_end GROUP BY ALL
"""


def range_join_chunk_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = motion.chunk_volumes(_fixed_chunks(spark, sf_dir), event_series(spark, sf_dir), KEY, "vol")
    return rows.groupBy("run_key", "chunk_start", "chunk_end").agg(F.count(F.lit(1)).alias("n_vols"), F.round(F.sum("fd"), 4).alias("sum_fd"))


RANGE_JOIN = f"""
WITH {_FIXED}
SELECT ch.run_key, chunk_start, chunk_end, count(*) AS n_vols, round(sum(fd), 4) AS sum_fd
FROM ch JOIN e ON e.run_key = ch.run_key AND e.vol BETWEEN chunk_start AND chunk_end GROUP BY ALL
"""


def chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks.corrupted_chunks(event_series(spark, sf_dir), KEY, "vol", "fd", EVENT_CORRUPTION)
    return _rounded(chunks.chunk_summary(found, KEY), ["mean_fd", "median_fd"])


CHUNK_SUMMARY = f"""
WITH w AS ({CORRUPTED.replace("round(m, 4)", "m").replace("round(x, 4)", "x")})
SELECT count(DISTINCT run_key) AS n_runs, count(*) AS n_chunks, round(avg(chunk_mean_fd), 4) AS mean_fd, round(median(chunk_mean_fd), 4) AS median_fd FROM w
"""


def chunk_run_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks.corrupted_chunks(event_series(spark, sf_dir), KEY, "vol", "fd", EVENT_CORRUPTION)
    return _rounded(chunks.run_ranges(found, KEY), ["min_mean_fd", "max_mean_fd"])


RUN_RANGES = f"""
WITH w AS ({CORRUPTED.replace("round(m, 4)", "m").replace("round(x, 4)", "x")})
SELECT run_key, round(min(chunk_mean_fd), 4) AS min_mean_fd, round(max(chunk_mean_fd), 4) AS max_mean_fd, count(*) AS n_chunks FROM w GROUP BY run_key
"""


def sliding_window_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full windows at a step of 7, before any selection."""
    from dataclasses import replace

    w = chunks.sliding_windows(event_series(spark, sf_dir), KEY, "vol", "fd", replace(EVENT_CORRUPTION, step=7)).drop("values")
    return _rounded(w, ["chunk_mean_fd", "chunk_max_fd", "frac_vols_above_thr"])


WINDOW_STEP = f"""
WITH {EVENTS_SQL},
n AS (SELECT run_key, count(*) AS n FROM e GROUP BY run_key),
s AS (SELECT e.run_key, e.vol AS s, n FROM e JOIN n USING (run_key) WHERE e.vol + 20 <= n.n AND e.vol % 7 = 0)
SELECT s.run_key, s.s AS chunk_start, s.s + 19 AS chunk_end, round(avg(e.fd), 4) AS chunk_mean_fd, round(max(e.fd), 4) AS chunk_max_fd,
       count(*) FILTER (e.fd >= 50) AS n_vols_above_thr, round(count(*) FILTER (e.fd >= 50) / 20, 4) AS frac_vols_above_thr, s.n AS n_total_vols_in_run
FROM s JOIN e ON e.run_key = s.run_key AND e.vol BETWEEN s.s AND s.s + 19 GROUP BY ALL
"""

QUERIES = {
    "fd_6dof": (fd_6dof, FD_6DOF),
    "corrupted_windows": (corrupted_windows, CORRUPTED),
    "sliding_window_step": (sliding_window_step, WINDOW_STEP),
    "chunk_report": (chunk_report, CHUNK_REPORT),
    "safe_zone_chunks": (safe_zone_chunks, SAFE_ZONE),
    "safe_volume_counts": (safe_volume_counts, SAFE_COUNTS),
    "chunk_local_vs_run_fd": (chunk_local_vs_run_fd, CHUNK_FD),
    "range_join_chunk_vol": (range_join_chunk_vol, RANGE_JOIN),
    "chunk_summary": (chunk_summary, CHUNK_SUMMARY),
    "chunk_run_ranges": (chunk_run_ranges, RUN_RANGES),
}
