"""Chunk selection: sliding windows with much motion, and chunks of safe stretches between spikes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewise.functions.arrays import exact_round
from framewise.operators.motion import series_window
from framewise.operators.quantiles import quantiles
from framewise.params import Corruption, SafeZone


def longest_streak(values: Column, threshold: float) -> Column:
    """Longest run of values at or above the threshold in an array."""
    grown = lambda s: s["now"] + 1
    step = lambda s, x: F.when(
        x >= threshold, F.struct(grown(s).alias("now"), F.greatest(s["best"], grown(s)).alias("best"))
    ).otherwise(F.struct(F.lit(0).alias("now"), s["best"].alias("best")))
    return F.aggregate(values, F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")), step, lambda s: s["best"])


def border_mean(mean: Column, values: Column, border: float) -> Column:
    """The mean; where it is so near the border that the order of adding would decide, that of the values' decimals.

    A double counts as the shortest decimal that stands for it. Their sum is exact, so the mean is the same in any order.
    """
    kind = "decimal(37,17)"
    total = F.aggregate(values, F.lit(0).cast(kind), lambda s, x: (s + x.try_cast(kind)).try_cast(kind), lambda s: s.cast("double"))
    near = F.abs(mean - border) <= 1e-9 * abs(border)
    return F.when(near, F.coalesce(total / F.size(values), mean)).otherwise(mean)


def sliding_windows(series: DataFrame, keys: list[str], ordinal: str, fd: str, p: Corruption = Corruption()) -> DataFrame:
    """Each full window that starts at a multiple of the step: bounds, statistics and the values themselves.

    All windows share one exchange on the keys; a run's number of volumes comes from the same one.
    """
    ahead = series_window(keys, ordinal).rowsBetween(0, p.size - 1)
    above = F.sum((F.col(fd) >= p.threshold).cast("long")).over(ahead)
    framed = series.withColumns(
        {
            "_n": F.count(F.lit(1)).over(ahead),
            "chunk_mean_fd": F.avg(fd).over(ahead),
            "chunk_max_fd": F.max(fd).over(ahead),
            "n_vols_above_thr": above,
            "_values": F.collect_list(fd).over(ahead),
            "n_total_vols_in_run": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
        }
    )
    full = framed.filter((F.col("_n") == p.size) & (F.col(ordinal) % p.step == 0))
    return full.select(
        *keys,
        F.col(ordinal).alias("chunk_start"),
        (F.col(ordinal) + (p.size - 1)).alias("chunk_end"),
        "chunk_mean_fd",
        "chunk_max_fd",
        "n_vols_above_thr",
        (F.col("n_vols_above_thr") / F.lit(float(p.size))).alias("frac_vols_above_thr"),
        "n_total_vols_in_run",
        F.col("_values").alias("values"),
    )


def corrupted_chunks(series: DataFrame, keys: list[str], ordinal: str, fd: str, p: Corruption = Corruption()) -> DataFrame:
    """Windows with enough high volumes, a long enough streak and mean, and no volume at the limit or above.

    A mean at the limit passes whatever the order of adding (see border_mean). The streak is worked out only for
    windows that pass the cheap tests.
    """
    cheap = (
        (F.col("frac_vols_above_thr") >= p.min_fraction) & (F.col("chunk_mean_fd") >= p.min_mean - 1e-9 * abs(p.min_mean)) & (F.col("chunk_max_fd") < p.max_fd)
    )
    windows = sliding_windows(series, keys, ordinal, fd, p).filter(cheap)
    passed = windows.withColumn("chunk_mean_fd", border_mean(F.col("chunk_mean_fd"), F.col("values"), p.min_mean)).filter(F.col("chunk_mean_fd") >= p.min_mean)
    streak = passed.withColumn("max_sustained_streak", longest_streak(F.col("values"), p.threshold))
    return streak.filter(F.col("max_sustained_streak") >= p.min_streak).drop("values")


def safe_volumes(series: DataFrame, keys: list[str], ordinal: str, fd: str, p: SafeZone = SafeZone()) -> DataFrame:
    """Adds ``safe``: no spike within the buffers.

    A spike at i excludes i - before to i + after; seen from a volume, a spike excludes it from
    ``after`` volumes back to ``before`` volumes ahead.
    """
    around = series_window(keys, ordinal).rowsBetween(-p.after, p.before)
    spike = (F.col(fd) >= p.threshold).cast("int")
    return series.withColumn("safe", F.max(spike).over(around) == 0)


def safe_counts(series: DataFrame, keys: list[str], ordinal: str, fd: str, p: SafeZone = SafeZone()) -> DataFrame:
    """n_safe_vols_in_run and n_total_vols_in_run of every run."""
    marked = safe_volumes(series, keys, ordinal, fd, p)
    return marked.groupBy(*keys).agg(
        F.count_if("safe").alias("n_safe_vols_in_run"), F.count(F.lit(1)).alias("n_total_vols_in_run")
    )


def safe_chunks(series: DataFrame, keys: list[str], ordinal: str, fd: str, p: SafeZone = SafeZone()) -> DataFrame:
    """Chunks of ``size`` volumes, one after another, of each unbroken safe stretch; what is left over is dropped."""
    run = Window.partitionBy(*keys)
    marked = safe_volumes(series, keys, ordinal, fd, p).withColumns(
        {"n_safe_vols_in_run": F.count_if("safe").over(run), "n_total_vols_in_run": F.count(F.lit(1)).over(run)}
    )
    safe = marked.filter("safe")
    island = safe.withColumn("_island", F.col(ordinal) - F.row_number().over(series_window(keys, ordinal)))
    place = F.row_number().over(Window.partitionBy(*keys, "_island").orderBy(ordinal)) - 1
    cut = island.withColumn("_chunk", F.floor(place / F.lit(p.size)))
    out = cut.groupBy(*keys, "_island", "_chunk").agg(
        F.min(ordinal).alias("chunk_start"),
        F.max(ordinal).alias("chunk_end"),
        F.avg(fd).alias("chunk_mean_fd"),
        F.max(fd).alias("chunk_max_fd"),
        F.first("n_safe_vols_in_run").alias("n_safe_vols_in_run"),
        F.first("n_total_vols_in_run").alias("n_total_vols_in_run"),
        F.count(F.lit(1)).alias("_n"),
    )
    return out.filter(F.col("_n") == p.size).drop("_island", "_chunk", "_n")


def reported(chunks: DataFrame) -> DataFrame:
    """Chunks with the digits that their tables have: means and maxima to 6 decimals, shares to 4, as Python rounds."""
    digits = {"chunk_mean_fd": 6, "chunk_max_fd": 6, "frac_vols_above_thr": 4}
    return chunks.withColumns({c: exact_round(c, d) for c, d in digits.items() if c in chunks.columns})


def chunk_summary(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """One row: runs, chunks, and mean and median of the chunks' mean FD."""
    sums = chunks.agg(F.count_distinct(F.struct(*keys)).alias("n_runs"), F.count(F.lit(1)).alias("n_chunks"), F.avg("chunk_mean_fd").alias("mean_fd"))
    return sums.crossJoin(quantiles(chunks, [], "chunk_mean_fd", {"median_fd": 0.5}))  # one row each


def run_ranges(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest and largest chunk mean of each run."""
    return chunks.groupBy(*keys).agg(
        F.min("chunk_mean_fd").alias("min_mean_fd"), F.max("chunk_mean_fd").alias("max_mean_fd"), F.count(F.lit(1)).alias("n_chunks")
    )
