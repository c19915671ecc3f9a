"""Framewise displacement from motion parameters, for whole runs and inside chunks.

A series is a table with key columns and an integer ordinal; every window here is partitioned by the
keys, so one exchange serves all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewise.params import RADIUS


def series_window(keys: list[str], ordinal: str):
    return Window.partitionBy(*keys).orderBy(ordinal)


def ordinals(df: DataFrame, keys: list[str], order: list[str], out: str = "vol") -> DataFrame:
    """Adds each row's place in its series, from 0."""
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("int"))


def displacement(rotations: list[Column], translations: list[Column], window, radius: float = RADIUS) -> Column:
    """Sum of absolute changes since the row before, rotations as arc lengths; null in the first row."""
    changes = [F.abs(F.lag(x).over(window) - x) * radius for x in rotations]
    changes += [F.abs(F.lag(x).over(window) - x) for x in translations]
    total = changes[0]
    for c in changes[1:]:
        total = total + c
    return total


def framewise_displacement(
    df: DataFrame, keys: list[str], ordinal: str, rotations: list[Column], translations: list[Column], radius: float = RADIUS
) -> DataFrame:
    """Adds ``fd``; the first row of a series has 0."""
    fd = displacement(rotations, translations, series_window(keys, ordinal), radius)
    return df.withColumn("fd", F.coalesce(fd, F.lit(0.0)))


def chunk_volumes(chunks: DataFrame, series: DataFrame, keys: list[str], ordinal: str, width: int = 64) -> DataFrame:
    """Rows of each chunk. Chunks go to the stretches of ``width`` ordinals that they touch, so that a chunk meets
    the rows of these stretches only, not all of its run, and a long run is dealt to many tasks.
    """
    stretch = F.explode(F.sequence(F.floor(F.col("chunk_start") / width), F.floor(F.col("chunk_end") / width)))
    held = chunks.select(*keys, "chunk_start", "chunk_end", stretch.alias("_stretch"))
    rows = series.withColumn("_stretch", F.floor(F.col(ordinal) / width))
    return held.join(rows, [*keys, "_stretch"]).filter(F.col(ordinal).between(F.col("chunk_start"), F.col("chunk_end"))).drop("_stretch")


def chunk_fd(chunks: DataFrame, series: DataFrame, keys: list[str], ordinal: str, fd: str = "fd") -> DataFrame:
    """Run-level FD over all volumes of a chunk, and chunk-local FD, which has no value for the first volume."""
    inside = F.when(F.col(ordinal) > F.col("chunk_start"), F.col(fd))
    return (
        chunk_volumes(chunks, series, keys, ordinal)
        .groupBy(*keys, "chunk_start", "chunk_end")
        .agg(
            F.avg(fd).alias("run_fd_mean"),
            F.max(fd).alias("run_fd_max"),
            F.avg(inside).alias("par_fd_mean"),
            F.max(inside).alias("par_fd_max"),
            F.stddev_pop(inside).alias("par_fd_std"),
        )
    )
