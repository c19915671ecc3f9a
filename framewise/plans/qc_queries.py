"""Queries of quality metrics, summaries, flags and the tables behind plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.functions import arrays, text
from framewise.operators import chunks, losses, qc, stats, volumes
from framewise.params import QcLimits
from framewise.plans.motion_queries import CORRUPTED
from framewise.plans.series import EVENT_CORRUPTION, VECTORS_SQL, event_series, table, vector_series

KEY = ["run_key"]


def rounded(df: DataFrame, columns: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Rounds the named columns, or all doubles."""
    columns = columns or [f.name for f in df.schema if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})  # no negative zeros


def dvars(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = qc.dvars(vector_series(spark, sf_dir), KEY, "vol", "x").filter("dvars IS NOT NULL")
    return rounded(d.select("run_key", "vol", "dvars"))


DVARS = f"""
WITH {VECTORS_SQL}, d AS (SELECT b.run_key, b.vol, unnest(a.x) AS p, unnest(b.x) AS q FROM v a JOIN v b ON a.run_key = b.run_key AND a.vol = b.vol - 1)
SELECT run_key, vol, round(sqrt(avg((q - p) * (q - p))), 4) AS dvars FROM d GROUP BY ALL
"""


def voxel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = qc.voxel_statistics(vector_series(spark, sf_dir), KEY, "x")
    return rounded(s)


_VOXELS = f"""
{VECTORS_SQL}, l AS (SELECT run_key, CAST(unnest(range(len(x))) AS INTEGER) AS voxel, unnest(x) AS x FROM v),
s AS (SELECT run_key, voxel, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std_pop, stddev_samp(x) AS std_samp FROM l GROUP BY ALL)"""

VOXELS = f"WITH {_VOXELS} SELECT run_key, voxel, n, round(mean, 4) + 0.0 AS mean, round(std_pop, 4) + 0.0 AS std_pop, round(std_samp, 4) + 0.0 AS std_samp FROM s"


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors moved up by their first value's magnitude, so that means are positive."""
    return vector_series(spark, sf_dir).withColumn("x", F.transform("x", lambda y: y + 1.0))


def tsnr_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qc.tsnr_qc(qc.voxel_statistics(_shifted(spark, sf_dir), KEY, "x"), KEY))


TSNR_QC = f"""
WITH {_VOXELS.replace("unnest(x) AS x FROM v", "unnest(x) + 1 AS x FROM v")}, m AS (SELECT run_key, avg(mean) AS level FROM s GROUP BY run_key)
SELECT run_key, round(avg(CASE WHEN std_pop > 0 THEN mean / std_pop ELSE 0 END), 4) AS tsnr_mean,
       round(median(CASE WHEN std_pop > 0 THEN mean / std_pop ELSE 0 END), 4) AS tsnr_median
FROM s JOIN m USING (run_key) WHERE mean > 0.1 * level GROUP BY run_key
"""


def tsnr_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qc.tsnr_train(qc.voxel_statistics(_shifted(spark, sf_dir), KEY, "x"), KEY))


TSNR_TRAIN = f"""
WITH {_VOXELS.replace("unnest(x) AS x FROM v", "unnest(x) + 1 AS x FROM v")}
SELECT run_key, round(coalesce(avg(CASE WHEN abs(mean) > 0 THEN abs(mean) / greatest(std_samp, 1e-6) END), 0), 4) AS tsnr FROM s GROUP BY run_key
"""


def global_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qc.global_signal(vector_series(spark, sf_dir), KEY, "x"))


GLOBAL_SIGNAL = f"""
WITH {VECTORS_SQL}, g AS (SELECT run_key, list_avg(x) AS g FROM v)
SELECT run_key, round(avg(g), 4) AS gs_mean, round(stddev_pop(g), 4) AS gs_std, round(stddev_samp(g), 4) AS gs_std_samp FROM g GROUP BY run_key
"""


def intensity_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector gets a NaN in front and every eleventh an infinity."""
    v = vector_series(spark, sf_dir)
    first = F.when(F.col("vec_id") % 7 == 0, float("nan")).when(F.col("vec_id") % 11 == 0, float("inf")).otherwise(F.get("x", F.lit(0)))
    bad = v.withColumn("x", F.concat(F.array(first), F.slice("x", 2, 1000)))
    return rounded(qc.intensity(bad, ["vec_id"], "x"))


INTENSITY = f"""
WITH {VECTORS_SQL}, z AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 OR vec_id % 11 = 0 THEN list_concat([0.0::DOUBLE], x[2:]) ELSE x END AS x FROM v)
SELECT vec_id, round(list_min(x), 4) + 0.0 AS intensity_min, round(list_max(x), 4) + 0.0 AS intensity_max, round(list_avg(x), 4) + 0.0 AS intensity_mean,
       vec_id % 7 = 0 AS has_nan, vec_id % 7 <> 0 AND vec_id % 11 = 0 AS has_inf FROM z
"""


def temporal_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First value, and root sum of squares, of the channels with differences appended."""
    a = qc.append_differences(vector_series(spark, sf_dir), KEY, "vol", "x")
    norm = F.sqrt(F.aggregate("values", F.lit(0.0), lambda s, y: s + y * y))
    return rounded(a.select("run_key", F.col("channel").cast("long").alias("channel"), F.get("values", F.lit(0)).alias("first"), norm.alias("norm")))


TEMPORAL = f"""
WITH {VECTORS_SQL}, n AS (SELECT run_key, count(*) AS n FROM v GROUP BY run_key),
c AS (SELECT run_key, vol::BIGINT AS channel, x FROM v UNION ALL
      SELECT a.run_key, n + a.vol, list_transform(list_zip(b.x, a.x), lambda p: p[1] - p[2]) FROM v a JOIN v b ON a.run_key = b.run_key AND b.vol = a.vol + 1 JOIN n ON n.run_key = a.run_key)
SELECT run_key, channel, round(x[1], 4) AS first, round(sqrt(list_sum(list_transform(x, lambda y: y * y))), 4) AS norm FROM c
"""


def distribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("l_tax", F.when(F.col("l_linenumber") == 1, float("nan")).otherwise(F.col("l_tax")))
    return rounded(qc.distribution_summary(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "absent"], ["l_returnflag"]), digits=3)


SUMMARY = """
WITH l AS (UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_tax END AS l_tax FROM lineitem)
           ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME metric VALUE v)
SELECT l_returnflag, metric, count(v) AS n, round(avg(v), 3) AS mean, round(stddev_samp(v), 3) AS std, round(median(v), 3) AS median,
       round(quantile_cont(v, 0.25), 3) AS q25, round(quantile_cont(v, 0.75), 3) AS q75, round(min(v), 3) AS min, round(max(v), 3) AS max
FROM l GROUP BY ALL
"""


def shape_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang and source stand for shape and voxel size; the counts are rendered as text."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", (F.col("doc_id") % 3).alias("part"))
    r = qc.shape_report(docs, "lang", "source", ["part"])
    shown = F.array_join(F.transform(F.map_entries("shape_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return r.withColumn("shape_counts", shown)


SHAPES = """
WITH d AS (SELECT doc_id % 3 AS part, lang, source FROM documents), l AS (SELECT part, lang, count(*) AS n FROM d GROUP BY ALL), s AS (SELECT part, source, count(*) AS n FROM d GROUP BY ALL),
a AS (SELECT part, count(*) AS unique_shapes, arg_min(lang, (-n, lang)) AS most_common_lang, sum(n)::BIGINT AS n_chunks, string_agg(lang || '=' || n, ',' ORDER BY lang) AS shape_counts FROM l GROUP BY part),
b AS (SELECT part, count(*) AS unique_voxsizes, arg_min(source, (-n, source)) AS most_common_source FROM s GROUP BY part)
SELECT a.*, unique_voxsizes, most_common_source, unique_shapes > 1 AS shape_inconsistent FROM a JOIN b USING (part)
"""


def top_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.top_shapes(table(spark, sf_dir, "part"), "p_type", 10)


TOP = "SELECT p_type, count(*) AS count FROM part GROUP BY p_type ORDER BY count DESC, p_type LIMIT 10"


def qc_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    m = lab.select(
        "doc_id",
        (F.col("toxic") == 1).alias("has_nan"),
        F.when(F.col("doc_id") % 50 == 0, "truncated").alias("load_error"),
        F.when(F.col("doc_id") % 29 == 0, float("inf")).when(F.col("doc_id") % 31 == 0, float("nan")).otherwise(F.col("doc_id") % 17 / 20).alias("par_fd_mean"),
        (F.col("doc_id") % 23 + 0.5).cast("double").alias("tsnr_mean"),
    )
    return qc.qc_flags(m, QcLimits()).select("doc_id", "qc_flags")


FLAGS = """
SELECT * FROM (SELECT doc_id, concat_ws('|', CASE WHEN toxic = 1 THEN 'has_nan' END, CASE WHEN doc_id % 50 = 0 THEN 'load_error:truncated' END,
       CASE WHEN doc_id % 29 = 0 THEN 'high_fd_mean:inf' WHEN doc_id % 31 = 0 THEN NULL WHEN doc_id % 17 / 20 > 0.5 THEN 'high_fd_mean:' || printf('%.3f', doc_id % 17 / 20) END,
       CASE WHEN doc_id % 23 + 0.5 < 10 THEN 'low_tsnr:' || printf('%.2f', doc_id % 23 + 0.5) END) AS qc_flags FROM labels) WHERE qc_flags <> ''
"""


def all_null_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumns({"lost": F.lit(None).cast("double"), "nan": F.lit(float("nan"))})
    return qc.all_null_columns(e, ["value", "lost", "nan", "event_type"])


ALL_NULL = """
WITH e AS (SELECT value, NULL::DOUBLE AS lost, 'NaN'::DOUBLE AS nan, event_type FROM events),
c AS (SELECT count(*) FILTER (NOT isnan(value)) AS value, count(*) FILTER (NOT isnan(lost)) AS lost, count(*) FILTER (NOT isnan(nan)) AS nan, count(event_type) AS event_type FROM e)
SELECT metric FROM (UNPIVOT c ON value, lost, nan, event_type INTO NAME metric VALUE n) WHERE n = 0
"""


def chunk_bad_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.bad_counts(intensity_range(spark, sf_dir))


def ols_fd_dvars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.regression(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"], with_p=False), digits=3)


OLS = """
SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept,
       round(corr(l_extendedprice, l_quantity), 3) + 0.0 AS r, round(regr_r2(l_extendedprice, l_quantity), 3) AS r2 FROM lineitem GROUP BY l_returnflag
"""


def ols_p_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits with their p-values and formatted p: small samples of lineitem by supplier."""
    li = table(spark, sf_dir, "lineitem")
    fit = stats.regression(li, "l_quantity", "l_discount", ["l_suppkey"])
    return rounded(fit.withColumn("p_text", text.p_text(F.col("p"))), digits=6)


#: The continued fraction by a recursive table, a row for each group and term.
OLS_P = """
WITH RECURSIVE f AS (
  SELECT l_suppkey, count(*) AS n, regr_slope(l_discount, l_quantity) AS slope, regr_intercept(l_discount, l_quantity) AS intercept, corr(l_discount, l_quantity) AS r, regr_r2(l_discount, l_quantity) AS r2
  FROM lineitem GROUP BY l_suppkey),
g AS (SELECT *, (n - 2) / 2 AS a0, r * r AS y0, 1 - r * r AS x0 FROM f),
o AS (SELECT *, x0 < (a0 + 1) / (a0 + 2.5) AS low, exp(lgamma(a0 + 0.5) - lgamma(a0) - lgamma(0.5) + a0 * ln(x0) + 0.5 * ln(y0)) AS front FROM g WHERE n > 2 AND y0 > 0 AND y0 < 1),
s AS (SELECT l_suppkey, CASE WHEN low THEN x0 ELSE y0 END AS x, CASE WHEN low THEN a0 ELSE 0.5 END::DOUBLE AS a, CASE WHEN low THEN 0.5 ELSE a0 END::DOUBLE AS b FROM o),
t AS (
  SELECT l_suppkey, x, a, b, 1::DOUBLE AS m, 1::DOUBLE AS c, 1 / (1 - (a + b) * x / (a + 1)) AS d, 1 / (1 - (a + b) * x / (a + 1)) AS h FROM s
  UNION ALL
  SELECT l_suppkey, x, a, b, m + 1, 1 + v / c1, 1 / (1 + v * d1), h * c1 * d1 * (1 + v / c1) / (1 + v * d1)
  FROM (SELECT *, 1 + u / c AS c1, 1 / (1 + u * d) AS d1 FROM (
    SELECT *, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) AS u, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)) AS v FROM t WHERE m <= 400))),
e AS (SELECT l_suppkey, arg_max(h, m) AS h FROM t GROUP BY l_suppkey),
p AS (SELECT g.*, CASE WHEN g.y0 <= 0 THEN 1 WHEN g.y0 >= 1 THEN 0 WHEN low THEN front * h / o.a0 ELSE 1 - front * h / 0.5 END AS p FROM g LEFT JOIN o USING (l_suppkey) LEFT JOIN e USING (l_suppkey))
SELECT l_suppkey, n, round(slope, 6) + 0.0 AS slope, round(intercept, 6) + 0.0 AS intercept, round(r, 6) + 0.0 AS r, round(r2, 6) + 0.0 AS r2, round(p, 6) + 0.0 AS p, CASE WHEN p < 0.001 THEN 'p<0.001' ELSE printf('p=%.3f', p) END AS p_text
FROM p
"""


def regression_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = stats.regression(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"], with_p=False)
    return rounded(stats.regression_line(fit, F.lit(0.0), F.lit(50.0)).select("l_returnflag", "x", "y_hat"), digits=2)


POINTS = """
WITH f AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, round(50.0 * k / 199, 2) AS x, round(i + s * (50.0 * k / 199), 2) AS y_hat FROM f, range(200) t(k)
"""


def violin_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Densities of the events' values by type, at a hundred places each."""
    return rounded(stats.violin(table(spark, sf_dir, "events"), "value", ["event_type"]), digits=8)


VIOLIN = """
WITH m AS (SELECT event_type, count(*) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) * pow(count(*)::DOUBLE, -0.2) AS h FROM events GROUP BY event_type),
g AS (SELECT *, (hi - lo) / ceil(64 * (hi - lo) / h) AS w FROM m WHERE n > 1 AND hi > lo),
v AS (SELECT g.*, (value - lo) / w AS u FROM events JOIN g USING (event_type)),
c AS (SELECT event_type, floor(u) AS i, 1 - (u - floor(u)) AS c FROM v UNION ALL SELECT event_type, floor(u) + 1, u - floor(u) FROM v),
d AS (SELECT event_type, i, sum(c) AS c FROM c GROUP BY ALL),
p AS (SELECT g.*, k, (hi - lo) / 99 * k AS x FROM g, range(100) t(k))
SELECT event_type, k::INT AS k, round(lo + x, 8) + 0.0 AS x, round(sum(c * exp(-0.5 * ((x - i * w) / h) * ((x - i * w) / h))) / (n * h * sqrt(2 * pi())), 8) + 0.0 AS density
FROM p JOIN d USING (event_type) GROUP BY event_type, k, lo, x, n, h
"""


def spread_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.spread_summary(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], ["l_linestatus"]))


SPREAD = """
SELECT l_linestatus, count(*) AS n, round(avg(l_quantity), 4) AS l_quantity_mean, round(stddev_pop(l_quantity), 4) AS l_quantity_std, round(stddev_samp(l_quantity), 4) AS l_quantity_std_samp,
       round(avg(l_discount), 4) AS l_discount_mean, round(stddev_pop(l_discount), 4) AS l_discount_std, round(stddev_samp(l_discount), 4) AS l_discount_std_samp
FROM lineitem GROUP BY l_linestatus
"""


def finite_and_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("y", F.when(F.col("l_linenumber") == 2, float("inf")).otherwise(F.col("l_extendedprice")))
    kept = stats.clipped(stats.clean(li, ["l_quantity", "y"]), "l_quantity", "y", 25.0, 30000.0)
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


CLIPPED = "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linenumber <> 2 AND l_quantity <= 25 AND l_extendedprice <= 30000 GROUP BY l_returnflag"


def fd_bins_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.binned_boxes(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return rounded(out, ["q1", "median", "q3", "whisker_low", "whisker_high"])


BOXES = """
WITH t AS (SELECT quantile_cont(l_quantity, 0.99) AS top FROM lineitem),
b AS (SELECT l_returnflag, l_extendedprice AS y, CASE WHEN l_quantity < 0 OR l_quantity > top THEN NULL WHEN l_quantity = 0 THEN 0 ELSE CAST(ceil(l_quantity / (top / 8)) - 1 AS INTEGER) END AS bin, top FROM lineitem, t),
q AS (SELECT bin, l_returnflag, printf('%.2f–%.2f', bin * any_value(top) / 8, (bin + 1) * any_value(top) / 8) AS label, count(*) AS n,
             quantile_cont(y, 0.25) AS q1, median(y) AS median, quantile_cont(y, 0.75) AS q3 FROM b WHERE bin IS NOT NULL GROUP BY bin, l_returnflag)
SELECT q.bin, q.l_returnflag, label, n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
       round(min(y) FILTER (y >= q1 - 1.5 * (q3 - q1)), 4) AS whisker_low, round(max(y) FILTER (y <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_high
FROM q JOIN b ON b.bin = q.bin AND b.l_returnflag = q.l_returnflag GROUP BY ALL
"""


def marginal_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.histogram(table(spark, sf_dir, "events"), "value", by=["event_type"]), ["density"], 6)


HIST = """
WITH m AS (SELECT max(value) AS m FROM events), h AS (SELECT event_type, CAST(least(floor(value / m * 49), 48) AS INTEGER) AS bin, m FROM events, m WHERE value >= 0),
t AS (SELECT event_type, count(*) AS a FROM h GROUP BY event_type)
SELECT event_type, bin, count(*) AS n, round(count(*) / (any_value(a) * (any_value(m) / 49)), 6) AS density FROM h JOIN t USING (event_type) GROUP BY event_type, bin
"""


def kde_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density of quantity and discount by supplier."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).alias("part"), "l_quantity", "l_discount")
    return stats.density(li, "l_quantity", "l_discount", "part")


def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return stats.running_best(o, ["o_orderkey"], "o_totalprice", ["o_orderpriority"])


BEST = """
SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM orders)
WHERE b IS NULL OR o_totalprice > b
"""


def epoch_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_orderkey") % 7).alias("batch"), "l_quantity", "l_discount")
    return rounded(stats.mean_of_batch_means(li, ["l_returnflag"], "batch", ["l_quantity", "l_discount"]))


EPOCHS = """
WITH b AS (SELECT l_returnflag, l_orderkey % 7 AS batch, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY ALL)
SELECT l_returnflag, round(avg(q), 4) AS l_quantity, round(avg(d), 4) AS l_discount, count(*) AS n_batches FROM b GROUP BY l_returnflag
"""


def val_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and learning rates of epochs made of lines: improvements are quantities, the ratio a price."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    ratio = arrays.ratio(F.col("l_extendedprice"), F.lit(40000.0))
    score = arrays.validation_score(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), ratio)
    rate = arrays.learning_rate(F.col("l_orderkey") % 30, 2e-4, 30)
    return li.select("l_orderkey", "l_linenumber", F.round(score, 4).alias("score"), F.round(rate * 1e6, 4).alias("rate_micro"))


VAL_SCORE = """
WITH l AS (SELECT *, l_extendedprice / (40000.0 + 1e-8) AS r, l_orderkey % 30 AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, round(l_quantity + l_discount + l_tax - 10.0 * greatest(0.0, r - 1.1), 4) AS score,
       round(200.0 * CASE WHEN e < 5 THEN 1e-6 + (1 - 1e-6) * e / 5.0 WHEN e < 20 THEN 1.0 ELSE 1 + (1e-6 - 1) * least(1.0, (e - 20) / 10.0) END, 4) AS rate_micro FROM l
"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive vectors of each run: x and the next one, y."""
    from framewise.operators.motion import series_window

    v = vector_series(spark, sf_dir)
    return v.withColumn("y", F.lead("x").over(series_window(KEY, "vol"))).filter("y IS NOT NULL")


def loss_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir).select("run_key", arrays.l1(F.col("x"), F.col("y")).alias("l"))
    return rounded(p.groupBy("run_key").agg(F.avg("l").alias("l1")))


def loss_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir).select("run_key", arrays.mse(F.col("x"), F.col("y")).alias("l"))
    return rounded(p.groupBy("run_key").agg(F.avg("l").alias("mse")))


_PAIRS = f"""
{VECTORS_SQL}, p AS (SELECT a.run_key, a.vol, unnest(a.x) AS x, unnest(b.x) AS y FROM v a JOIN v b ON a.run_key = b.run_key AND b.vol = a.vol + 1)"""
L1 = f"WITH {_PAIRS}, l AS (SELECT run_key, vol, avg(abs(x - y)) AS l FROM p GROUP BY ALL) SELECT run_key, round(avg(l), 4) AS l1 FROM l GROUP BY run_key"
MSE = f"WITH {_PAIRS}, l AS (SELECT run_key, vol, avg((x - y) * (x - y)) AS l FROM p GROUP BY ALL) SELECT run_key, round(avg(l), 4) AS mse FROM l GROUP BY run_key"


def weighted_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each loss term and their weighted sum, on pairs of vectors."""
    x, y = F.col("x"), F.col("y")
    terms = {
        "adv": losses.generator(x, y),
        "cyc": losses.two_sided_l1(x, y, y, x),
        "idt": losses.two_sided_l1(x, x, y, x),
        "con": losses.content(x, y, x, y),
        "art": losses.artefact(x, y),
        "disc": losses.discriminator(x, y),
    }
    p = _pairs(spark, sf_dir).select("run_key", "vol", *(c.alias(k) for k, c in terms.items()))
    total = losses.weighted_total(*(F.col(k) for k in ("adv", "cyc", "idt", "con", "art")))
    return rounded(p.withColumn("total", total).groupBy("run_key").agg(*(F.avg(k).alias(k) for k in [*terms, "total"])))


WEIGHTED = f"""
WITH {_PAIRS}, t AS (SELECT run_key, vol, 0.5 * avg((x-1)*(x-1)) + 0.5 * avg((y-1)*(y-1)) AS adv, 2 * avg(abs(x - y)) AS cyc, avg(abs(x - y)) AS idt,
  2 * avg((x-y)*(x-y)) AS con, avg(x*x) + avg(y*y) AS art, 0.5 * avg((x-1)*(x-1)) + 0.5 * avg(y*y) AS disc FROM p GROUP BY ALL)
SELECT run_key, round(avg(adv), 4) AS adv, round(avg(cyc), 4) AS cyc, round(avg(idt), 4) AS idt, round(avg(con), 4) AS con, round(avg(art), 4) AS art, round(avg(disc), 4) AS disc,
       round(avg(adv + 10 * cyc + 5 * idt + con + 0.1 * art), 4) AS total FROM t GROUP BY run_key
"""


def _volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 4 x 4 x 4 volumes, chunked by run."""
    v = vector_series(spark, sf_dir)
    shape = F.array(F.lit(4), F.lit(4), F.lit(4))
    return v.select(F.col("run_key").cast("string").alias("chunk_id"), "vol", shape.alias("shape"), F.col("x").cast("array<float>").alias("data"))


def psc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of squares of each normalised volume, and the largest error of the way back on the brain."""
    raw = _volumes(spark, sf_dir).withColumn("data", F.transform("data", lambda x: (x + F.lit(2).cast("float")).cast("float")))
    psc = volumes.percent_signal_change(raw)
    back = volumes.undo_percent_signal_change(psc).select("chunk_id", "vol", F.col("data").alias("back"))
    j = psc.join(raw.select("chunk_id", "vol", F.col("data").alias("raw")), ["chunk_id", "vol"]).join(back, ["chunk_id", "vol"])
    error = F.array_max(F.zip_with("raw", "back", lambda a, b: F.abs(a - b)))
    energy = F.aggregate(F.col("data").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)
    return j.select("chunk_id", "vol", F.round(energy, 3).alias("energy"), (error < 1e-3).alias("round_trip"))


PSC = """
WITH v AS (SELECT label::VARCHAR AS chunk_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS vol, embedding AS x FROM embeddings),
l AS (SELECT chunk_id, vol, unnest(range(len(x))) AS k, (unnest(x) + 2::FLOAT)::DOUBLE AS x FROM v),
m AS (SELECT chunk_id, k, avg(x) AS m FROM l GROUP BY ALL), t AS (SELECT chunk_id, max(m) AS t FROM m GROUP BY ALL), p AS (SELECT chunk_id, vol, x, m, CASE WHEN m > 0.01 * t THEN (x - m) / (abs(m) + 1e-6) ELSE 0 END AS p FROM l JOIN m USING (chunk_id, k) JOIN t USING (chunk_id))
SELECT chunk_id, vol, round(sum(p * p), 3) AS energy, max(abs(p * (abs(m) + 1e-6) + m - x)) < 1e-3 AS round_trip FROM p GROUP BY chunk_id, vol
"""


def smoothness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(volumes.smoothness(_volumes(spark, sf_dir)))


SMOOTH = """
WITH v AS (SELECT label::VARCHAR AS chunk_id, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
l AS (SELECT chunk_id, vec_id, unnest(range(64)) AS k, x FROM v),
d AS (SELECT chunk_id, vec_id, avg(abs(x[k+17] - x[k+1])) FILTER (k // 16 < 3) AS a, avg(abs(x[k+5] - x[k+1])) FILTER (k // 4 % 4 < 3) AS b, avg(abs(x[k+2] - x[k+1])) FILTER (k % 4 < 3) AS c FROM l GROUP BY ALL)
SELECT chunk_id, round(avg((a + b + c) / 3), 4) AS smoothness FROM d GROUP BY chunk_id
"""


def lr_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last value of every volume after the chunk's coin."""
    f = volumes.flip_x(_volumes(spark, sf_dir), epoch=3, seed=42)
    return f.select("chunk_id", "vol", F.round(F.get("data", F.lit(0)).cast("double"), 4).alias("first"), F.round(F.get("data", F.lit(63)).cast("double"), 4).alias("last"))


FLIP = """
WITH v AS (SELECT label::VARCHAR AS chunk_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS vol, embedding::DOUBLE[] AS x FROM embeddings),
c AS (SELECT *, ('0x' || md5(chunk_id || '#3#42')[1:8])::BIGINT / 4294967296 < 0.5 AS f FROM v)
SELECT chunk_id, vol, round(CASE WHEN f THEN x[49] ELSE x[1] END, 4) AS first, round(CASE WHEN f THEN x[16] ELSE x[64] END, 4) AS last FROM c
"""


def resample_trilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 x 4 x 4 volumes to 8 x 6 x 2 and back: shape, sum and the sum after the way back."""
    v = _volumes(spark, sf_dir)
    small = volumes.resample(v, (8, 6, 2))
    back = volumes.resample_back(small, v.select("chunk_id", F.col("shape").alias("orig_shape")).distinct())
    total = lambda name: F.round(F.aggregate(F.col("data").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 3) + 0.0
    a = small.select("chunk_id", "vol", text.shape_text("shape").alias("shape"), total("sum").alias("sum"))
    return a.join(back.select("chunk_id", "vol", total("back_sum").alias("back_sum")), ["chunk_id", "vol"])


# the sums of both are weighted sums of the volume's values; weights multiply over the axes
RESAMPLED = """
WITH s AS (SELECT * FROM (VALUES (0, 8), (1, 6), (2, 2)) s(axis, m)),
c AS (SELECT axis, m, 4 AS n, unnest(range(m)) AS i FROM s UNION ALL SELECT axis + 3, 4, m, unnest(range(4)) FROM s),
p AS (SELECT axis, n, i, greatest(0, least(n - 1, (i + 0.5) * n / m - 0.5)) AS t FROM c),
r AS (SELECT axis, i, floor(t)::INTEGER AS j, 1 - (t - floor(t)) AS w FROM p UNION ALL SELECT axis, i, least(floor(t)::INTEGER + 1, n - 1), t - floor(t) FROM p),
a AS (SELECT axis, j, sum(w) AS w FROM r WHERE axis < 3 GROUP BY ALL),
b AS (SELECT x.axis, x.j, sum(x.w * y.w) AS w FROM r x JOIN r y ON y.axis = x.axis + 3 AND y.j = x.i WHERE x.axis < 3 GROUP BY ALL),
k AS (SELECT k, x.w * y.w * z.w AS a, u.w * v.w * t.w AS b FROM range(64) q(k) JOIN a x ON x.axis = 0 AND x.j = k // 16 JOIN a y ON y.axis = 1 AND y.j = k // 4 % 4 JOIN a z ON z.axis = 2 AND z.j = k % 4
      JOIN b u ON u.axis = 0 AND u.j = k // 16 JOIN b v ON v.axis = 1 AND v.j = k // 4 % 4 JOIN b t ON t.axis = 2 AND t.j = k % 4),
e AS (SELECT label::VARCHAR AS chunk_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS vol, embedding::DOUBLE[] AS x FROM embeddings),
l AS (SELECT chunk_id, vol, unnest(range(64)) AS k, unnest(x) AS x FROM e)
SELECT chunk_id, vol, '(8, 6, 2)' AS shape, round(sum(x * a), 3) + 0.0 AS sum, round(sum(x * b), 3) + 0.0 AS back_sum FROM l JOIN k USING (k) GROUP BY chunk_id, vol
"""


def chunk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QC metrics of runs as chunks of volumes, some with NaN or infinities, and of every run's first volume as a chunk of one."""
    v = vector_series(spark, sf_dir)
    bad = F.when(F.col("vec_id") % 50 == 7, float("nan")).when(F.col("vec_id") % 60 == 11, float("-inf"))
    data = F.transform("x", lambda x, k: F.coalesce(F.when(k == 3, bad), x + 1.5).cast("float"))
    affine = F.array(*(F.lit(float(x)) for x in (-2, 0, 0, 90, 0, 3, 0, -126, 0, 4, 2, -72, 0, 0, 0, 1)))
    shape = F.array(F.lit(4), F.lit(4), F.lit(4))
    rows = v.select(F.col("run_key").cast("string").alias("chunk_id"), "vol", shape.alias("shape"), data.alias("data"), affine.alias("affine"))
    one = rows.filter("vol = 0").withColumn("chunk_id", F.concat(F.lit("one-"), "chunk_id"))
    return rounded(volumes.chunk_metrics(rows.unionByName(one)).drop("load_error"), digits=3)


METRICS = """
WITH w AS (SELECT label::VARCHAR AS chunk_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS vol, vec_id % 50 = 7 AS nan, vec_id % 50 <> 7 AND vec_id % 60 = 11 AS inf,
                  list_transform(embedding, lambda x: (x::DOUBLE + 1.5)::FLOAT::DOUBLE) AS y FROM embeddings),
a AS (SELECT chunk_id, vol, nan, inf, CASE WHEN nan OR inf THEN list_concat(y[1:3], [0.0::DOUBLE], y[5:]) ELSE y END AS x FROM w),
v AS (SELECT * FROM a UNION ALL SELECT 'one-' || chunk_id, vol, nan, inf, x FROM a WHERE vol = 0),
i AS (SELECT chunk_id, count(*)::INTEGER AS n_vols, bool_or(nan) AS has_nan, bool_or(inf) AS has_inf, min(list_min(x)) AS a, max(list_max(x)) AS b, avg(list_avg(x)) AS m, stddev_pop(list_avg(x)) AS s FROM v GROUP BY chunk_id),
p AS (SELECT b.chunk_id, b.vol, unnest(a.x) AS x, unnest(b.x) AS y FROM v a JOIN v b ON a.chunk_id = b.chunk_id AND b.vol = a.vol + 1),
d AS (SELECT chunk_id, vol, sqrt(avg((x-y)*(x-y))) AS d FROM p GROUP BY ALL), e AS (SELECT chunk_id, avg(d) AS dm, max(d) AS dx FROM d GROUP BY chunk_id),
k AS (SELECT chunk_id, unnest(range(64)) AS k, unnest(x) AS x FROM v), t AS (SELECT chunk_id, k, avg(x) AS m, stddev_pop(x) AS s FROM k GROUP BY ALL HAVING count(*) > 1),
l AS (SELECT chunk_id, 0.1 * avg(m) AS l FROM t GROUP BY chunk_id),
q AS (SELECT chunk_id, avg(CASE WHEN s > 0 THEN m / s ELSE 0 END) AS tm, median(CASE WHEN s > 0 THEN m / s ELSE 0 END) AS td FROM t JOIN l USING (chunk_id) WHERE m > l GROUP BY chunk_id)
SELECT chunk_id, n_vols, '(4, 4, 4, ' || n_vols || ')' AS shape, '[' || round(sqrt(4), 3) || ', ' || round(sqrt(9 + 16), 3) || ', ' || round(sqrt(4), 3) || ']' AS voxel_size, has_nan, has_inf,
       round(i.a, 3) + 0.0 AS intensity_min, round(i.b, 3) + 0.0 AS intensity_max, round(i.m, 3) + 0.0 AS intensity_mean, round(dm, 3) + 0.0 AS dvars_mean, round(dx, 3) + 0.0 AS dvars_max,
       round(tm, 3) + 0.0 AS tsnr_mean, round(td, 3) + 0.0 AS tsnr_median, round(i.m, 3) + 0.0 AS gs_mean, round(i.s, 3) + 0.0 AS gs_std FROM i LEFT JOIN e USING (chunk_id) LEFT JOIN q USING (chunk_id)
"""


def metric_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics before and after halving the distance to the run's mean."""
    v = _volumes(spark, sf_dir)
    half = v.withColumn("data", F.transform("data", lambda x: (x * F.lit(0.5).cast("float")).cast("float")))
    return rounded(volumes.metric_bundle(v, half).select("chunk_id", "dvars_input", "dvars_improvement", "gs_std_input", "gs_std_improvement", "smoothness_ratio"), digits=3)


BUNDLE = f"""
WITH {VECTORS_SQL.replace("CAST(embedding AS DOUBLE[]) AS x", "embedding::DOUBLE[] AS x, list_transform(embedding, lambda y: (y * 0.5::FLOAT)::FLOAT)::DOUBLE[] AS h")},
p AS (SELECT b.run_key, b.vol, unnest(a.x) AS x, unnest(b.x) AS y, unnest(a.h) AS g, unnest(b.h) AS h FROM v a JOIN v b ON a.run_key = b.run_key AND b.vol = a.vol + 1),
c AS (SELECT run_key, vol, sqrt(avg((y-x)*(y-x))) AS d, sqrt(avg((h-g)*(h-g))) AS e FROM p GROUP BY ALL), d AS (SELECT run_key, avg(d) AS d, avg(e) AS e FROM c GROUP BY run_key),
g AS (SELECT run_key, stddev_samp(list_avg(x)) AS s, stddev_samp(list_avg(h)) AS t FROM v GROUP BY run_key),
l AS (SELECT run_key, vec_id, unnest(range(64)) AS k, x, h FROM v),
f AS (SELECT run_key, vec_id, avg(abs(x[k+17] - x[k+1])) FILTER (k // 16 < 3) + avg(abs(x[k+5] - x[k+1])) FILTER (k // 4 % 4 < 3) + avg(abs(x[k+2] - x[k+1])) FILTER (k % 4 < 3) AS a,
             avg(abs(h[k+17] - h[k+1])) FILTER (k // 16 < 3) + avg(abs(h[k+5] - h[k+1])) FILTER (k // 4 % 4 < 3) + avg(abs(h[k+2] - h[k+1])) FILTER (k % 4 < 3) AS b FROM l GROUP BY ALL),
r AS (SELECT run_key, avg(b / 3) / (avg(a / 3) + 1e-8) AS r FROM f GROUP BY run_key)
SELECT run_key::VARCHAR AS chunk_id, round(d, 3) AS dvars_input, round(d - e, 3) AS dvars_improvement, round(s, 3) AS gs_std_input, round(s - t, 3) AS gs_std_improvement, round(r, 3) AS smoothness_ratio
FROM d JOIN g USING (run_key) JOIN r USING (run_key)
"""


def mask_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of every volume inside a fixed mask: even places."""
    import numpy as np

    mask = (np.arange(64).reshape(4, 4, 4) % 2 == 0).astype(float)
    m = volumes.apply_mask(_volumes(spark, sf_dir), mask)
    return m.select("chunk_id", "vol", F.round(F.aggregate(F.col("data").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 4).alias("sum"))


MASK = """
WITH v AS (SELECT label::VARCHAR AS chunk_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS vol, embedding::DOUBLE[] AS x FROM embeddings),
l AS (SELECT chunk_id, vol, unnest(range(64)) AS k, unnest(x) AS x FROM v) SELECT chunk_id, vol, round(sum(x) FILTER (k % 2 = 0), 4) AS sum FROM l GROUP BY ALL
"""


def volume_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verification numbers of runs masked by even places; every run's first volume has leaked at place 1, and
    negligibly at place 3, and every seventh volume is empty."""
    import numpy as np

    mask = (np.arange(64).reshape(4, 4, 4) % 2 == 0).astype(float)
    m = volumes.apply_mask(_volumes(spark, sf_dir), mask)
    leak = lambda x, k: F.when((k == 1) & (F.col("vol") == 0), 1.0).when((k == 3) & (F.col("vol") == 0), 5e-7).when((k % 2 == 0) & (F.col("vol") % 7 == 3), 0.0).otherwise(x).cast("float")
    return rounded(volumes.volume_checks(m.withColumn("data", F.transform("data", leak)), mask))


CHECKS = """
WITH v AS (SELECT label::VARCHAR AS chunk_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS vol, embedding::DOUBLE[] AS x FROM embeddings),
l AS (SELECT chunk_id, vol, len(x) AS n, unnest(range(len(x))) AS k, unnest(x) AS x FROM v),
y AS (SELECT *, k % 2 = 0 AS brain, CASE WHEN k % 2 = 0 THEN CASE WHEN vol % 7 = 3 THEN 0 ELSE x END WHEN vol = 0 AND k = 1 THEN 1 WHEN vol = 0 AND k = 3 THEN 5e-7 ELSE 0 END AS y FROM l),
s AS (SELECT chunk_id, vol, any_value(n) AS n, count(*) FILTER (brain) AS b, count(*) FILTER (NOT brain) AS o, count(*) FILTER (NOT brain AND abs(y) > 1e-6) AS z, avg(abs(y)) FILTER (brain) AS s FROM y GROUP BY ALL)
SELECT chunk_id, count(*) AS n_volumes, max(b) FILTER (vol = 0) AS n_brain_voxels, max(o) FILTER (vol = 0) AS n_outside, max(z) FILTER (vol = 0) AS n_nonzero_outside_brain, round(avg(s), 4) AS mean_signal_brain,
       count(*) FILTER (s < 1e-6) AS n_zero_volumes, bool_and(n = 64) AS dims_match FROM s GROUP BY chunk_id
"""


def _age_masks():
    import numpy as np

    place = np.arange(64).reshape(4, 4, 4)
    return {"younger": (place % 2 == 0).astype(float), "older": (place < 40).astype(float)}


def _runs_to_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of younger and older subjects; one can't be read, one has volumes of another shape, one of two axes."""
    v = _volumes(spark, sf_dir)
    label = F.col("chunk_id").cast("int")
    shape = lambda *n: F.array(*map(F.lit, n))
    return v.withColumns(
        {
            "subject": F.concat(F.lit("ICC"), "chunk_id", F.when(label % 2 == 1, "A").otherwise("")),
            "load_error": F.when(label == 3, "truncated"),
            "shape": F.when(label == 5, shape(8, 4, 2)).when(label == 7, shape(8, 8)).otherwise(F.col("shape")),
        }
    )


def preprocess_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each volume's sum after the mask of its subject's age group."""
    out, _ = volumes.preprocess(_runs_to_mask(spark, sf_dir), _age_masks())
    return out.select("chunk_id", "vol", F.round(F.aggregate(F.col("data").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 4).alias("sum"))


def preprocess_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log rows of the same runs."""
    log = volumes.preprocess(_runs_to_mask(spark, sf_dir), _age_masks())[1]
    return log.withColumns({c: F.col(c).cast("double") for c in ("n_volumes", "n_brain_voxels")})


PREPROCESS_MASKS = """
WITH v AS (SELECT label::VARCHAR AS chunk_id, label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS vol, embedding::DOUBLE[] AS x FROM embeddings WHERE label NOT IN (3, 5, 7)),
l AS (SELECT chunk_id, label, vol, unnest(range(64)) AS k, unnest(x) AS x FROM v)
SELECT chunk_id, vol, round(sum(x) FILTER (CASE WHEN label % 2 = 1 THEN k < 40 ELSE k % 2 = 0 END), 4) AS sum FROM l GROUP BY chunk_id, vol
"""

PREPROCESS_LOG = """
SELECT label::VARCHAR AS chunk_id, 'ICC' || label || CASE WHEN label % 2 = 1 THEN 'A' ELSE '' END AS subject, CASE WHEN label % 2 = 1 THEN 'older' ELSE 'younger' END AS mask_used,
       CASE label WHEN 3 THEN 'load_error' WHEN 5 THEN 'shape_mismatch' WHEN 7 THEN 'shape_error' ELSE 'processed' END AS status,
       CASE WHEN label NOT IN (3, 5, 7) THEN count(*) END::DOUBLE AS n_volumes,
       CASE WHEN label NOT IN (3, 5, 7) THEN (SELECT count(*) FILTER (CASE WHEN label % 2 = 1 THEN k < 40 ELSE k % 2 = 0 END) FROM range(64) q(k)) END::DOUBLE AS n_brain_voxels
FROM embeddings GROUP BY label
"""


def psc_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range, deviation, asymmetry and coverage of normalised runs, odd and even ones as domains."""
    raw = _volumes(spark, sf_dir).withColumn("data", F.transform("data", lambda x, k: F.when(k % 8 == 5, 0.0).otherwise(x + F.lit(2).cast("float")).cast("float")))
    psc = volumes.percent_signal_change(raw).withColumn("domain", (F.col("chunk_id").cast("int") % 2).cast("string"))
    return rounded(volumes.psc_report(psc, "domain"), digits=3)


PSC_REPORT = """
WITH v AS (SELECT label::VARCHAR AS chunk_id, vec_id, embedding AS x FROM embeddings),
w AS (SELECT chunk_id, vec_id, unnest(range(len(x))) AS k, (unnest(x) + 2::FLOAT)::DOUBLE AS x FROM v), l AS (SELECT chunk_id, vec_id, k, CASE WHEN k % 8 = 5 THEN 0 ELSE x END AS x FROM w), m AS (SELECT chunk_id, k, avg(x) AS m FROM l GROUP BY ALL),
t AS (SELECT chunk_id, max(m) AS t FROM m GROUP BY ALL),
p AS (SELECT (chunk_id::INTEGER % 2)::VARCHAR AS domain, CASE WHEN m > 0.01 * t THEN (x - m) / (abs(m) + 1e-6) ELSE 0 END AS p FROM l JOIN m USING (chunk_id, k) JOIN t USING (chunk_id)),
q AS (SELECT domain, avg(p) FILTER (p <> 0) AS a, stddev_pop(p) FILTER (p <> 0) AS s FROM p GROUP BY domain)
SELECT domain, round(min(p) FILTER (p <> 0), 3) AS min, round(max(p) FILTER (p <> 0), 3) AS max, round(any_value(s), 3) AS std, round(avg(pow((p - a) / s, 3)) FILTER (p <> 0), 3) AS asymmetry,
       round(count(*) FILTER (p <> 0) / count(*), 3) AS coverage FROM p JOIN q USING (domain) GROUP BY domain
"""


def minmax_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals scaled to 0..1 by priority."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    lim = o.groupBy("o_orderpriority").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    scaled = arrays.min_max(F.col("o_totalprice"), F.col("lo"), F.col("hi"))
    return rounded(o.join(lim, "o_orderpriority").select("o_orderkey", scaled.alias("scaled")))


MINMAX = """
WITH l AS (SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY ALL)
SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo + 1e-9), 4) AS scaled FROM orders JOIN l USING (o_orderpriority)
"""


def chunk_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes of every full chunk of five, one after another, of each run."""
    v = _volumes(spark, sf_dir).withColumnRenamed("chunk_id", "run_key")
    runs = v.groupBy("run_key").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")
    c = runs.select("run_key", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 5).cast("int") * 5 - 5, F.lit(5))).alias("chunk_start")).withColumn("chunk_end", F.col("chunk_start") + 4)
    c = c.withColumn("chunk_id", F.concat_ws("-", "run_key", "chunk_start", "chunk_end"))
    return volumes.extract_chunks(v, c).select("chunk_id", "vol", F.round(F.get("data", F.lit(0)).cast("double"), 4).alias("first"))


EXTRACTION = """
WITH v AS (SELECT label::VARCHAR AS r, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS vol, count(*) OVER (PARTITION BY label) AS n, embedding::DOUBLE[] AS x FROM embeddings)
SELECT r || '-' || (vol // 5 * 5) || '-' || (vol // 5 * 5 + 4) AS chunk_id, (vol % 5)::INTEGER AS vol, round(x[1], 4) AS first FROM v WHERE vol // 5 < n // 5
"""


def corrupted_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of the selected chunks' statistics."""
    c = chunks.corrupted_chunks(event_series(spark, sf_dir), KEY, "vol", "fd", EVENT_CORRUPTION)
    return rounded(qc.distribution_summary(c, ["chunk_mean_fd", "chunk_max_fd"]), digits=6)


CORRUPTED_SUMMARY = f"""
WITH w AS ({CORRUPTED.replace("round(m, 4)", "m").replace("round(x, 4)", "x")}), l AS (UNPIVOT (SELECT chunk_mean_fd, chunk_max_fd FROM w) ON chunk_mean_fd, chunk_max_fd INTO NAME metric VALUE v)
SELECT metric, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(median(v), 6) AS median, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.75), 6) AS q75,
       round(min(v), 6) AS min, round(max(v), 6) AS max FROM l GROUP BY metric
"""


QUERIES = {
    "dvars": (dvars, DVARS),
    "voxel_stats": (voxel_stats, VOXELS),
    "tsnr_qc": (tsnr_qc, TSNR_QC),
    "tsnr_train": (tsnr_train, TSNR_TRAIN),
    "global_signal": (global_signal, GLOBAL_SIGNAL),
    "intensity_range": (intensity_range, INTENSITY),
    "temporal_diff": (temporal_diff, TEMPORAL),
    "distribution_summary": (distribution_summary, SUMMARY),
    "corrupted_summary": (corrupted_summary, CORRUPTED_SUMMARY),
    "shape_report": (shape_report, SHAPES),
    "top_shapes": (top_shapes, TOP),
    "qc_flags": (qc_flags, FLAGS),
    "all_null_columns": (all_null_columns, ALL_NULL),
    "chunk_bad_counts": (
        chunk_bad_counts,
        "SELECT count(*) FILTER (vec_id % 7 = 0) AS n_nan, count(*) FILTER (vec_id % 7 <> 0 AND vec_id % 11 = 0) AS n_inf, count(*) AS n_chunks FROM embeddings",
    ),
    "ols_fd_dvars": (ols_fd_dvars, OLS),
    "violin_density": (violin_density, VIOLIN),
    "ols_p_value": (ols_p_value, OLS_P),
    "regression_points": (regression_points, POINTS),
    "spread_summary": (spread_summary, SPREAD),
    "finite_and_clipped": (finite_and_clipped, CLIPPED),
    "fd_bins_box": (fd_bins_box, BOXES),
    "marginal_hist": (marginal_hist, HIST),
    "kde_density": (kde_density, None),
    "running_best": (running_best, BEST),
    "epoch_means": (epoch_means, EPOCHS),
    "val_score": (val_score, VAL_SCORE),
    "loss_l1": (loss_l1, L1),
    "loss_mse": (loss_mse, MSE),
    "weighted_total": (weighted_total, WEIGHTED),
    "psc_normalise": (psc_normalise, PSC),
    "smoothness": (smoothness, SMOOTH),
    "lr_flip": (lr_flip, FLIP),
    "resample_trilinear": (resample_trilinear, RESAMPLED),
    "chunk_metrics": (chunk_metrics, METRICS),
    "metric_bundle": (metric_bundle, BUNDLE),
    "mask_volumes": (mask_volumes, MASK),
    "volume_checks": (volume_checks, CHECKS),
    "preprocess_masks": (preprocess_masks, PREPROCESS_MASKS),
    "preprocess_log": (preprocess_log, PREPROCESS_LOG),
    "psc_report": (psc_report, PSC_REPORT),
    "minmax_scaled": (minmax_scaled, MINMAX),
    "chunk_extraction": (chunk_extraction, EXTRACTION),
}
