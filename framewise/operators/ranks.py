"""Seeded orders and exact global ranks without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hexadecimal digits of a seeded hash that make a bucket; 4096 buckets.
PREFIX = 3


def seeded(key: Column | str, seed: int | str) -> Column:
    """A pseudo-random order that depends on the key and the seed alone."""
    return F.md5(F.concat(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit(f"#{seed}")))


def seeded_rank(df: DataFrame, key: str, seed: int | str, out: str = "rank") -> DataFrame:
    """Adds the rank (from 1) of each row in seeded order, ties by ``key``.

    Rows are ranked within buckets of their hash, and each bucket starts after the rows of those
    before it; only the bucket counts, 4096 at most, are ranked in one task.
    """
    h = df.withColumn("_h", seeded(key, seed)).withColumn("_b", F.substring("_h", 1, PREFIX))
    counts = h.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_b", before.alias("_s"))
    within = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    ranked = h.withColumn("_r", within).join(F.broadcast(starts), "_b")  # 4096 rows at most
    return ranked.withColumn(out, (F.col("_s") + F.col("_r")).cast("long")).drop("_h", "_b", "_r", "_s")


def bounds(df: DataFrame, order: list[str], parts: int) -> list[tuple]:
    """Least rows of about equal ranges of the order, ascending, as many as ``parts`` at most; they come from one pass."""
    keys = df.select(*order)
    least = keys.repartitionByRange(parts, *order).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*order)).alias("m"))
    return [tuple(r["m"]) for r in least.orderBy("m").collect()]


def range_bucket(df: DataFrame, order: list[str], cuts: list[tuple]) -> Column:
    """How many of the bounds a row has reached: the same wherever and however often it is worked out."""
    kinds = [df.schema[c].dataType for c in order]
    cut = [F.struct(*(F.lit(v).cast(k).alias(c) for v, k, c in zip(row, kinds, order, strict=True))) for row in cuts]
    return F.size(F.filter(F.array(*cut), lambda x: x <= F.struct(*order))) if cut else F.lit(0)


def ordered_rank(df: DataFrame, order: list[str], out: str = "rank", parts: int | None = None) -> DataFrame:
    """Adds the rank (from 1) of each row in the order of columns, which should be unique; nulls are first.

    Rows go to ranges of the order, by bounds that are fixed first, and are ranked there; only the ranges'
    counts meet in one task. ``parts`` is the number of ranges, the session's shuffle partitions by default.
    """
    parts = parts or min(512, max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = df.withColumn("_p", range_bucket(df, order, bounds(df, order, parts)))
    counts = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_p", before.alias("_s"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    ranked = dealt.withColumn("_r", within).join(F.broadcast(starts), "_p")  # one row for each part
    return ranked.withColumn(out, (F.col("_s") + F.col("_r")).cast("long")).drop("_p", "_r", "_s")
