"""Quality metrics of chunks, their summaries, flags and shape reports.

Arrays here are one volume per row, small enough for column functions; for whole chunks of large volumes
see ``volumes.chunk_metrics``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewise.functions.arrays import doubles, finite_or_zero, mean, rms_difference
from framewise.operators.motion import series_window
from framewise.operators.quantiles import quantiles
from framewise.params import QcLimits

# The names of the metrics that summaries cover, where a table has them.
METRICS = (
    "csv_mean_fd csv_max_fd par_fd_mean par_fd_max par_fd_std intensity_min intensity_max intensity_mean "
    "dvars_mean dvars_max tsnr_mean tsnr_median gs_mean gs_std"
).split()


def dvars(df: DataFrame, keys: list[str], ordinal: str, values: str) -> DataFrame:
    """Adds ``dvars``: root mean square change of the array since the row before; null in the first row."""
    w = series_window(keys, ordinal)
    now = doubles(values)
    return df.withColumn("dvars", rms_difference(now, F.lag(now).over(w)))


def temporal_difference(df: DataFrame, keys: list[str], ordinal: str, values: str) -> DataFrame:
    """Adds ``diff``: the next row's array less this one; null in the last row."""
    w = series_window(keys, ordinal)
    ahead = F.lead(doubles(values)).over(w)
    return df.withColumn("diff", F.when(ahead.isNotNull(), F.zip_with(ahead, doubles(values), lambda x, y: x - y)))


def append_differences(df: DataFrame, keys: list[str], ordinal: str, values: str) -> DataFrame:
    """Rows of the series, then T - 1 rows of differences as further channels: T becomes 2 T - 1."""
    w = series_window(keys, ordinal)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    place = F.row_number().over(w) - 1
    base = temporal_difference(df.withColumns({"_n": n, "_k": place}), keys, ordinal, values)
    own = base.select(*keys, F.col("_k").alias("channel"), doubles(values).alias("values"))
    more = base.filter("diff IS NOT NULL").select(*keys, (F.col("_n") + F.col("_k")).alias("channel"), F.col("diff").alias("values"))
    return own.unionByName(more)


def voxel_statistics(df: DataFrame, keys: list[str], values: str) -> DataFrame:
    """(keys, voxel, n, mean, std_pop, std_samp) over the rows of each key."""
    voxels = df.select(*keys, F.posexplode(doubles(values)).alias("voxel", "x"))
    return voxels.groupBy(*keys, "voxel").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std_pop"), F.stddev_samp("x").alias("std_samp")
    )


def tsnr_qc(stats: DataFrame, keys: list[str], share: float = 0.1) -> DataFrame:
    """Mean and median of mean/std (0 where std is 0) over voxels above ``share`` of the mean of means."""
    level = stats.groupBy(*keys).agg(F.avg("mean").alias("_level"))
    tsnr = F.when(F.col("std_pop") > 0, F.col("mean") / F.col("std_pop")).otherwise(0.0)
    inside = stats.join(level, keys).filter(F.col("mean") > share * F.col("_level")).select(*keys, tsnr.alias("_t"))
    means = inside.groupBy(*keys).agg(F.avg("_t").alias("tsnr_mean"))
    return means.join(quantiles(inside, keys, "_t", {"tsnr_median": 0.5}), keys)


def tsnr_train(stats: DataFrame, keys: list[str], epsilon: float = 1e-6) -> DataFrame:
    """Mean of |mean| / max(sample std, epsilon) over voxels with |mean| > 0; 0 if there are none."""
    value = F.abs("mean") / F.greatest(F.col("std_samp"), F.lit(epsilon))
    return stats.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.abs("mean") > 0, value)), F.lit(0.0)).alias("tsnr"))


def global_signal(df: DataFrame, keys: list[str], values: str) -> DataFrame:
    """Mean, population and sample deviation over rows of the arrays' means."""
    signal = df.withColumn("_gs", mean(doubles(values)))
    return signal.groupBy(*keys).agg(
        F.avg("_gs").alias("gs_mean"), F.stddev_pop("_gs").alias("gs_std"), F.stddev_samp("_gs").alias("gs_std_samp")
    )


def intensity(df: DataFrame, keys: list[str], values: str) -> DataFrame:
    """Adds min, max and mean with NaN and infinities as 0, and whether there are any."""
    a = doubles(values)
    clean = F.transform(a, finite_or_zero)
    inf = float("inf")
    return df.select(
        *keys,
        F.array_min(clean).alias("intensity_min"),
        F.array_max(clean).alias("intensity_max"),
        mean(clean).alias("intensity_mean"),
        F.exists(a, F.isnan).alias("has_nan"),
        F.exists(a, lambda x: (x == inf) | (x == -inf)).alias("has_inf"),
    )


def distribution_summary(df: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, metric, n, mean, std, median, q25, q75, min, max) of each metric that the table has; a metric without values has no row.

    Metrics become rows first, so all are summed up in one exchange; percentiles are exact. NaN don't count; infinities do.
    """
    by = by or []
    have = [m for m in metrics if m in df.columns]
    long = df.unpivot(by, [F.col(m).cast("double").alias(m) for m in have], "metric", "value")
    rows = long.select(*by, "metric", F.when(~F.isnan("value"), F.col("value")).alias("v")).filter("v IS NOT NULL")
    key = [*by, "metric"]
    sums = rows.groupBy(*key).agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    middle = quantiles(rows, key, "v", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return sums.join(middle, key).select(*key, "n", "mean", "std", "median", "q25", "q75", "min", "max")


def shape_report(df: DataFrame, shape: str, voxel: str, by: list[str] | None = None) -> DataFrame:
    """Chunks, distinct shapes and voxel sizes, the most common of each (ties: the smallest), and the counts."""
    by = by or []
    counts = df.groupBy(*by, shape, voxel).agg(F.count(F.lit(1)).alias("_n"))
    shapes = counts.groupBy(*by, shape).agg(F.sum("_n").alias("n"))
    voxels = counts.groupBy(*by, voxel).agg(F.sum("_n").alias("n"))

    def most(of: DataFrame, c: str, alias: str, *more: Column) -> DataFrame:
        top = F.min(F.when(F.col(c).isNotNull(), F.struct((-F.col("n")).alias("n"), F.col(c).alias("v"))))["v"]
        return of.groupBy(*by).agg(F.count_distinct(c).alias(alias), top.alias(f"most_common_{c}"), *more)

    entries = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col(shape).isNotNull(), F.struct(shape, "n")))))
    a = most(shapes, shape, "unique_shapes", F.sum("n").alias("n_chunks"), entries.alias("shape_counts"))
    b = most(voxels, voxel, "unique_voxsizes")
    joined = a.join(b, by) if by else a.crossJoin(b)  # one row each
    return joined.withColumn("shape_inconsistent", F.col("unique_shapes") > 1)


def top_shapes(df: DataFrame, shape: str, k: int = 10) -> DataFrame:
    return df.groupBy(shape).count().orderBy(F.desc("count"), shape).limit(k)


def _shown(label: str, form: str, column: str) -> Column:
    c = F.col(column)
    return F.concat(F.lit(label), F.when(c == float("inf"), "inf").when(c == -float("inf"), "-inf").otherwise(F.format_string(form, c)))


def qc_flags(df: DataFrame, p: QcLimits = QcLimits()) -> DataFrame:
    """Flagged rows with ``qc_flags``; columns that the table lacks, and NaN, flag nothing; infinities do. Limits themselves are not flagged.

    The flags' texts are fixed values.
    """
    have = set(df.columns)
    tests = {
        "has_nan": lambda: F.when(F.col("has_nan"), "has_nan"),
        "has_inf": lambda: F.when(F.col("has_inf"), "has_inf"),
        "load_error": lambda: F.when(F.col("load_error") != "", F.concat(F.lit("load_error:"), "load_error")),
        "par_fd_mean": lambda: F.when(~F.isnan("par_fd_mean") & (F.col("par_fd_mean") > p.fd), _shown("high_fd_mean:", "%.3f", "par_fd_mean")),
        "tsnr_mean": lambda: F.when(~F.isnan("tsnr_mean") & (F.col("tsnr_mean") < p.tsnr), _shown("low_tsnr:", "%.2f", "tsnr_mean")),
    }
    found = F.concat_ws("|", *(test() for c, test in tests.items() if c in have))
    return df.withColumn("qc_flags", found).filter("qc_flags <> ''")


def all_null_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(metric) of the columns without any value that is not null or NaN, in one pass."""
    nums = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    value = lambda c: F.when(~F.isnan(c), F.col(c)) if c in nums else F.col(c)
    counts = df.agg(*(F.count(value(c)).alias(c) for c in columns))
    return counts.unpivot([], columns, "metric", "n").filter("n = 0").select("metric")


def bad_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if("has_nan").alias("n_nan"), F.count_if("has_inf").alias("n_inf"), F.count(F.lit(1)).alias("n_chunks"))


def patch_column(df: DataFrame, column: str, value: Column) -> DataFrame:
    """Fills a column that is missing or has no value at all; any other stays as it is."""
    if column in df.columns and not df.filter(F.col(column).isNotNull() & (F.col(column).cast("string") != "")).isEmpty():
        return df
    return df.withColumn(column, value)


def domain_reports(df: DataFrame, p: QcLimits = QcLimits()) -> dict[str, DataFrame]:
    """The four reports of a domain's chunk metrics: the metrics, their summary, the flagged chunks and the shapes."""
    shapes = shape_report(df, "shape", "voxel_size").withColumnRenamed("most_common_voxel_size", "most_common_vox")
    return {"chunk_level_metrics": df, "distribution_summary": distribution_summary(df, METRICS), "qc_flags": qc_flags(df, p), "shape_report": shapes}
