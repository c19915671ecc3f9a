"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewise.operators.storage import stored

#: Rows up to which one task may hold a group's distinct values; and ranges of the values beyond that.
SMALL, RANGES = 2_000_000, 64


def quantiles(df: DataFrame, by: list[str], value: str, probabilities: dict[str, float], small: int = SMALL) -> DataFrame:
    """(by, a column for each named probability), interpolated between the two nearest values; null values don't count.

    Up to ``small`` rows, one buffer serves all probabilities of a group. Beyond, values are counted first, in
    as many tasks as there are, and the counts are written, so that ``df`` is read once; ranges of the distinct
    values, from an approximate pass whose result is written too, have their rows summed, and only the ranges that
    hold a wanted place are gone through in order.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    names, shares = list(probabilities), [float(x) for x in probabilities.values()]
    if rows.count() <= small:  # a limit would bring that many rows to one task
        found = rows.groupBy(*by).agg(F.percentile("_v", F.array(*map(F.lit, shares))).alias("_q"))
        return found.select(*by, *(F.get("_q", F.lit(k)).alias(n) for k, n in enumerate(names)))
    counted = stored(rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c")), "quantiles")
    cuts = counted.groupBy(*by).agg(F.sum("_c").alias("_n"), F.percentile_approx("_v", [k / RANGES for k in range(1, RANGES)], 10_000).alias("_cuts"))
    cuts = stored(cuts, "quantiles")  # approximate ones depend on the order of merging; both uses below need the same
    keyed = (lambda a, b: a.join(F.broadcast(b))) if not by else (lambda a, b: a.join(b, by))  # one row without groups
    ranged = keyed(counted, cuts).withColumn("_r", F.size(F.filter("_cuts", lambda x: x < F.col("_v"))))
    sums = ranged.groupBy(*by, "_r", "_n").agg(F.sum("_c").alias("_s"))
    earlier = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(earlier), F.lit(0)))
    place = F.explode(F.array(*(F.struct(F.lit(k).alias("_k"), (F.lit(p) * (F.col("_n") - 1)).alias("at")) for k, p in enumerate(shares))))
    wanted = sums.select(*by, "_r", "_before", "_s", place.alias("_w")).select(*by, "_r", "_before", "_s", F.col("_w._k").alias("_k"), F.explode(F.array(F.struct(F.floor("_w.at").alias("i"), (1 - (F.col("_w.at") - F.floor("_w.at"))).alias("w")), F.struct((F.floor("_w.at") + 1).alias("i"), (F.col("_w.at") - F.floor("_w.at")).alias("w")))).alias("_x"))
    wanted = wanted.filter((F.col("_x.w") > 0) & (F.col("_x.i") >= F.col("_before")) & (F.col("_x.i") < F.col("_before") + F.col("_s")))
    wanted = wanted.select(*by, "_r", "_before", "_k", F.col("_x.i").alias("_i"), F.col("_x.w").alias("_weight"))
    # two rows at most for each group and probability
    hit = ranged.join(F.broadcast(wanted.select(*by, "_r", "_before").distinct()), [*by, "_r"])
    upto = F.sum("_c").over(Window.partitionBy(*by, "_r").orderBy("_v")) + F.col("_before")
    hit = hit.withColumn("_upto", upto).select(*by, "_r", "_v", "_upto", (F.col("_upto") - F.col("_c")).alias("_from"))
    both = hit.join(F.broadcast(wanted.drop("_before")), [*by, "_r"]).filter((F.col("_i") >= F.col("_from")) & (F.col("_i") < F.col("_upto")))
    return both.groupBy(*by).agg(*(F.sum(F.when(F.col("_k") == k, F.col("_v") * F.col("_weight"))).alias(n) for k, n in enumerate(names)))
