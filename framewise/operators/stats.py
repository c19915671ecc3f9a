"""The tables behind the plots: regression, bins with box statistics, histograms and densities."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from framewise.functions.arrays import bin_index, finite_or_null, let
from framewise.functions.text import range_label
from framewise.operators.quantiles import quantiles
from framewise.operators.ranks import bounds, range_bucket
from framewise.operators.storage import stored


def clean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose values are all finite."""
    out = df
    for c in columns:
        out = out.filter(finite_or_null(F.col(c)).isNotNull())
    return out


def clipped(df: DataFrame, x: str, y: str, max_x: float | None = None, max_y: float | None = None) -> DataFrame:
    """Rows within the axes, limits included."""
    out = df if max_x is None else df.filter(F.col(x) <= max_x)
    return out if max_y is None else out.filter(F.col(y) <= max_y)


def student_t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|), by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2.0, 0.5
    if x in (0.0, 1.0):
        return x

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
        d = 1.0 / (d if abs(d) > tiny else tiny)
        out = d
        for m in range(1, 400):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1.0 + top * d, 1.0 + top / c
                d = 1.0 / (d if abs(d) > tiny else tiny)
                c = c if abs(c) > tiny else tiny
                out *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return out

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * fraction(x, a, b) / a
    return 1 - front * fraction(1 - x, b, a) / b


#: Terms of the continued fraction at most; it has come to its end long before for groups of a million rows.
TERMS = 2000
# Lanczos' coefficients for the logarithm of the gamma function (g = 7); fixed values.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_gamma(z: Column) -> Column:
    """For z of a half and more."""
    total = sum((F.lit(c) / (z + (k - 1)) for k, c in enumerate(LANCZOS) if k), F.lit(LANCZOS[0]))
    return 0.5 * math.log(2 * math.pi) + (z - 0.5) * F.log(z + 6.5) - (z + 6.5) + F.log(total)


def beta_fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method: a step for each term, none after its end."""
    tiny = 1e-300
    away = lambda v: F.when(F.abs(v) > tiny, v).otherwise(tiny)
    first = let(1.0 / away(1.0 - (a + b) * x / (a + 1.0)), lambda d: F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("out"), F.lit(False).alias("end")))

    def grown(s: Column, top: Column) -> Column:
        new = F.struct((1.0 / away(1.0 + top * s["d"])).alias("d"), away(1.0 + top / s["c"]).alias("c"))
        return let(new, lambda v: F.struct(v["c"].alias("c"), v["d"].alias("d"), (s["out"] * v["c"] * v["d"]).alias("out"), (F.abs(v["c"] * v["d"] - 1.0) < 1e-15).alias("end")))

    def step(s: Column, m: Column) -> Column:
        even = grown(s, m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m)))
        odd = let(even, lambda e: grown(e, -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))))
        return F.when(s["end"], s).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, lambda s, m: step(s, m.cast("double")), lambda s: s["out"])


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation r of n pairs: the incomplete beta function of 1 - r^2 with (n - 2) / 2 and 1/2; NaN below 3 pairs."""

    def value(v: Column) -> Column:
        x, y, a, b = v["x"], v["y"], v["a"], F.lit(0.5)
        front = F.exp(log_gamma(a + 0.5) - log_gamma(a) - 0.5 * math.log(math.pi) + a * F.log(x) + 0.5 * F.log(y))
        low = front * beta_fraction(x, a, b) / a
        high = 1.0 - front * beta_fraction(y, b, a) / b
        return F.when(y >= 1, 0.0).when(y <= 0, 1.0).when(x < (a + 1.0) / (a + 2.5), low).otherwise(high)

    terms = F.struct((1.0 - r * r).alias("x"), (r * r).alias("y"), ((n - 2) / 2.0).cast("double").alias("a"))
    return F.when((n < 3) | r.isNull() | n.isNull() | F.isnan(r), float("nan")).otherwise(let(terms, value))


def regression(df: DataFrame, x: str, y: str, by: list[str] | None = None, with_p: bool = True) -> DataFrame:
    """n, slope, intercept, r and r2 of y on x, and the slope's p-value."""
    out = df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.corr(y, x).alias("r"),
        F.regr_r2(y, x).alias("r2"),
    )
    return out.withColumn("p", correlation_p(F.col("r"), F.col("n"))) if with_p else out


def regression_line(fit: DataFrame, lo: Column, hi: Column, points: int = 200) -> DataFrame:
    """(fit's columns, x, y_hat): evenly spaced points of each line."""
    at = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    line = fit.select("*", at.alias("_k")).withColumn("x", lo + (hi - lo) * F.col("_k") / F.lit(points - 1))
    return line.withColumn("y_hat", F.col("intercept") + F.col("slope") * F.col("x")).drop("_k")


def spread_summary(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Means with population and sample deviations of each column."""
    parts = [(F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.stddev_samp(c).alias(f"{c}_std_samp")) for c in columns]
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *(c for p in parts for c in p))


def binned_boxes(df: DataFrame, x: str, y: str, by: list[str], bins: int = 8, quantile: float = 0.99) -> DataFrame:
    """Quartiles and whiskers of y for bins of x, equal in width from 0 to a quantile of x; values beyond have no bin.

    Whiskers are the outermost values within 1.5 interquartile ranges of the box.
    """
    top = quantiles(df, [], x, {"_top": quantile})
    edges = [F.col("_top") * F.lit(k / bins) for k in range(bins + 1)]
    binned = df.join(F.broadcast(top)).withColumn("bin", bin_index(F.col(x), edges)).filter("bin IS NOT NULL")  # one row
    width = F.col("_top") / F.lit(float(bins))
    binned = binned.withColumn("label", range_label(F.col("bin") * width, (F.col("bin") + 1) * width))
    key = ["bin", *by]
    boxes = binned.groupBy(*key).agg(F.first("label").alias("label"), F.count(F.lit(1)).alias("n"))
    boxes = boxes.join(quantiles(binned, key, y, {"q1": 0.25, "median": 0.5, "q3": 0.75}), key)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = binned.select(*key, y).join(boxes.select(*key, "q1", "q3"), key)
    ends = inside.groupBy(*key).agg(
        F.min(F.when(F.col(y) >= F.col("q1") - reach, F.col(y))).alias("whisker_low"),
        F.max(F.when(F.col(y) <= F.col("q3") + reach, F.col(y))).alias("whisker_high"),
    )
    return boxes.join(ends, key)


def histogram(df: DataFrame, x: str, edges: int = 50, by: list[str] | None = None) -> DataFrame:
    """(by, bin, n, density): edges from 0 to the maximum, one bin fewer; the last bin holds its right edge."""
    by, bins = by or [], edges - 1
    top = df.agg(F.max(x).alias("_max"))
    inside = df.join(F.broadcast(top)).filter((F.col(x) >= 0) & (F.col("_max") > 0))  # one row
    k = F.least(F.floor(F.col(x) / F.col("_max") * bins), F.lit(bins - 1)).cast("int")
    counts = inside.withColumn("bin", k).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.first("_max").alias("_max"))
    totals = inside.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    both = counts.join(totals, by) if by else counts.join(F.broadcast(totals))  # one row without groups
    width = F.col("_max") / F.lit(float(bins))
    return both.select(*by, "bin", "n", (F.col("n") / (F.col("_all") * width)).alias("density"))


#: Nodes of the density grid for each whitened standard deviation, and deviations that it covers on each side.
NODES, REACH = 32, 16


def density(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Two-dimensional Gaussian density of each group at its own points, scaled to 0..1; for groups of more than 10 rows.

    Scott's bandwidth with the full covariance, in whitened coordinates. Points are counted in the
    cells of a fixed grid, a group's counts are smoothed on the grid, and each point is interpolated
    between the nodes of its cell; so no group's points are gathered and the work is linear in them.
    Points more than REACH deviations from the mean have the density that they have by themselves.
    """
    m = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"),
        F.var_samp(x).alias("_vx"), F.var_samp(y).alias("_vy"), F.covar_samp(x, y).alias("_c"),
    )
    m = m.filter((F.col("_n") > 10) & (F.col("_vx") * F.col("_vy") - F.col("_c") * F.col("_c") > 0))
    h = F.pow(F.col("_n"), F.lit(-1 / 6))
    sx = F.sqrt("_vx")
    sy = F.sqrt(F.col("_vy") - F.col("_c") * F.col("_c") / F.col("_vx"))
    u = (F.col(x) - F.col("_mx")) / sx * NODES
    v = (F.col(y) - F.col("_my") - F.col("_c") / F.col("_vx") * (F.col(x) - F.col("_mx"))) / sy * NODES
    scale = 2 * math.pi * F.col("_n") * h * h * sx * sy
    pts = df.join(m, by).withColumns({"_u": u, "_v": v, "_h": h * NODES, "_scale": scale})
    pts = pts.withColumns({"_cu": F.floor("_u").cast("int"), "_cv": F.floor("_v").cast("int")})
    cells = pts.groupBy(by, "_cu", "_cv").agg(
        F.count(F.lit(1)).alias("k"), F.avg("_u").alias("u"), F.avg("_v").alias("v"), F.first("_h").alias("h")
    )

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        edge = NODES * REACH
        inside = (pdf["_cu"].abs() < edge - 1) & (pdf["_cv"].abs() < edge - 1)
        near = pdf[inside]
        out = pdf[[by, "_cu", "_cv"]].copy()
        for c in ("d00", "d01", "d10", "d11"):
            out[c] = pdf["k"].astype(float)
        if len(near):
            grid = np.zeros((2 * edge, 2 * edge))
            cu, cv = near["_cu"].to_numpy() + edge, near["_cv"].to_numpy() + edge
            fu, fv, k = near["u"] - near["_cu"], near["v"] - near["_cv"], near["k"]
            for du, dv, w in ((0, 0, (1 - fu) * (1 - fv)), (0, 1, (1 - fu) * fv), (1, 0, fu * (1 - fv)), (1, 1, fu * fv)):
                np.add.at(grid, (cu + du, cv + dv), (w * k).to_numpy())
            step = np.arange(2 * edge)
            kernel = np.exp(-0.5 * ((step[:, None] - step[None, :]) / near["h"].iloc[0]) ** 2)
            grid = kernel @ grid @ kernel
            for c, du, dv in (("d00", 0, 0), ("d01", 0, 1), ("d10", 1, 0), ("d11", 1, 1)):
                out.loc[near.index, c] = grid[cu + du, cv + dv]
        return out

    kind = df.schema[by].dataType.simpleString()
    nodes = cells.groupBy(by).applyInPandas(smooth, f"`{by}` {kind}, _cu int, _cv int, d00 double, d01 double, d10 double, d11 double")
    fu, fv = F.col("_u") - F.col("_cu"), F.col("_v") - F.col("_cv")
    between = (F.col("d00") * (1 - fv) + F.col("d01") * fv) * (1 - fu) + (F.col("d10") * (1 - fv) + F.col("d11") * fv) * fu
    dense = pts.join(nodes, [by, "_cu", "_cv"]).withColumn("density", between / F.col("_scale"))
    lim = dense.groupBy(by).agg(F.min("density").alias("_lo"), F.max("density").alias("_hi"))
    scaled = (F.col("density") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9)
    return dense.join(lim, by).select(by, x, y, "density", scaled.alias("scaled"))


#: Nodes of a violin's grid for each bandwidth, and bandwidths beyond which a node doesn't count (below 1e-14 of the peak).
FINE, FAR = 64, 8


def violin(df: DataFrame, value: str, by: list[str], points: int = 100) -> DataFrame:
    """(by, k, x, density): the Gaussian density of each group at ``points`` places from its least to its largest value.

    Scott's bandwidth. Finite values count; a group of one value, or of equal ones, has no density. Values are
    counted at the nodes of a grid of FINE nodes a bandwidth, shared between their two neighbours, so a group is
    as many rows as its grid has nodes however large it is; a node then adds to the places within FAR bandwidths.
    The error is below 1e-4 of the density's peak.
    """
    x = F.col(value).cast("double")
    rows = df.select(*by, finite_or_null(x).alias("_x")).filter("_x IS NOT NULL")
    m = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.stddev_samp("_x").alias("_sd"))
    m = m.filter((F.col("_n") > 1) & (F.col("_hi") > F.col("_lo"))).withColumn("_h", F.pow(F.col("_n").cast("double"), F.lit(-0.2)) * F.col("_sd"))
    m = m.withColumn("_w", (F.col("_hi") - F.col("_lo")) / F.ceil(FINE * (F.col("_hi") - F.col("_lo")) / F.col("_h")))
    m = stored(m, "violin")  # the deviation's last digits depend on the order of merging; both uses below need the same
    same = lambda a, b: [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    at = rows.alias("a").join(m.alias("b"), same("a", "b")).select("b.*", ((F.col("_x") - F.col("_lo")) / F.col("_w")).alias("_at"))
    cells = at.withColumn("_i", F.floor("_at")).groupBy(*m.columns, "_i").agg(F.count(F.lit(1)).alias("_k"), F.sum(F.col("_at") - F.floor("_at")).alias("_f"))
    shared = F.explode(F.array(F.struct(F.col("_i").alias("i"), (F.col("_k") - F.col("_f")).alias("c")), F.struct((F.col("_i") + 1).alias("i"), F.col("_f").alias("c"))))
    nodes = cells.select(*m.columns, shared.alias("_s")).groupBy(*m.columns, F.col("_s.i").alias("_i")).agg(F.sum("_s.c").alias("_c"))
    step = (F.col("_hi") - F.col("_lo")) / (points - 1)
    middle = F.col("_i") * F.col("_w")  # from the least value on
    first = F.greatest(F.lit(0), F.ceil((middle - FAR * F.col("_h")) / step).cast("int"))
    last = F.least(F.lit(points - 1), F.floor((middle + FAR * F.col("_h")) / step).cast("int"))
    near = nodes.withColumn("k", F.explode(F.sequence(first, last)))
    apart = (F.col("k") * step - middle) / F.col("_h")
    adds = near.select(*m.columns, "k", (F.col("_c") * F.exp(-0.5 * apart * apart)).alias("_v"))
    every = m.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"), F.lit(0.0).alias("_v"))  # places without a node near
    total = F.sum("_v") / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))
    return adds.unionByName(every).groupBy(*m.columns, "k").agg(total.alias("density")).select(*by, "k", (F.col("_lo") + F.col("k") * step).alias("x"), "density")


def running_best(df: DataFrame, order: list[str], value: str, by: list[str], parts: int | None = None) -> DataFrame:
    """Rows whose value is strictly above all before it in their group.

    Each group is cut into ranges of the order; a range starts from the best value of those before it, of
    which there are ``parts`` at most (by default the session's shuffle partitions), so a large group is
    dealt to many tasks.
    """
    parts = parts or min(512, max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cut = df.withColumn("_p", range_bucket(df, order, bounds(df, order, parts)))
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    best = cut.groupBy(*by, "_p").agg(F.max(value).alias("_m")).select(*by, "_p", F.max("_m").over(earlier).alias("_best"))
    joined = cut.alias("c").join(best.alias("b"), [F.col(f"c.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*by, "_p"]]).select("c.*", "b._best")
    within = F.max(value).over(Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    before = F.greatest("_best", within)  # nulls don't count
    return joined.withColumn("_best", before).filter(F.col("_best").isNull() | (F.col(value) > F.col("_best"))).drop("_best", "_p")


def mean_of_batch_means(df: DataFrame, epoch: list[str], batch: str, values: list[str]) -> DataFrame:
    """Epoch means in which every batch counts alike, whatever its size."""
    per_batch = df.groupBy(*epoch, batch).agg(*(F.avg(v).alias(v) for v in values))
    return per_batch.groupBy(*epoch).agg(*(F.avg(v).alias(v) for v in values), F.count(F.lit(1)).alias("n_batches"))
