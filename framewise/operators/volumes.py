"""Kernels on whole volumes and chunks, with numpy inside tasks.

A chunk table has one row for each volume: chunk_id, vol, shape (of three axes, C order) and data
(array<float>). Kernels that need one volume run batch by batch, and Spark ends a batch at
``spark.sql.execution.arrow.maxBytesPerBatch``; those that need a chunk's whole series
are grouped sums by voxel and windows over volumes, so a chunk may have any number of volumes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewise.functions.arrays import voxel_sizes
from framewise.functions.text import list_text, mask_kind
from framewise.operators.quantiles import quantiles

VOLUME = "chunk_id string, vol int, shape array<int>, data array<float>"
#: Shape that volumes are resampled to for models.
MODEL_SHAPE = (80, 96, 72)


def _each(df: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply ``f`` to every volume (x, y, z), and to its ``mean_data`` where ``df`` has that."""
    more = ["mean_data"] if "mean_data" in df.columns else []

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            shapes = [tuple(s) for s in pdf["shape"]]
            for c in ("data", *more):
                made = [f(np.asarray(d, np.float32).reshape(s)) for d, s in zip(pdf[c], shapes, strict=True)]
                pdf = pdf.assign(**{"shape": [list(m.shape) for m in made], c: [m.ravel() for m in made]})
            yield pdf

    return df.select("chunk_id", "vol", "shape", "data", *more).mapInPandas(run, VOLUME + ", mean_data array<float>" * len(more))


def axis_weights(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For m samples at half-pixel centres of n values: lower index, upper index and weight of the upper."""
    at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    low = np.floor(at).astype(np.int64)
    return low, np.minimum(low + 1, n - 1), (at - low).astype(np.float32)


def resample_volume(v: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    """Trilinear, one axis after another."""
    for axis, m in enumerate(shape):
        if v.shape[axis] != m:
            low, high, w = axis_weights(v.shape[axis], m)
            w = w.reshape([-1 if k == axis else 1 for k in range(3)])
            v = np.take(v, low, axis) * (1 - w) + np.take(v, high, axis) * w
    return v.astype(np.float32)


def resample(df: DataFrame, shape: tuple[int, int, int] = MODEL_SHAPE) -> DataFrame:
    return _each(df, lambda v: resample_volume(v, shape))


def resample_back(df: DataFrame, original: DataFrame) -> DataFrame:
    """Resample each chunk to its shape in ``original`` (chunk_id, orig_shape)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            made = [
                resample_volume(np.asarray(d, np.float32).reshape(s), tuple(o))
                for d, s, o in zip(pdf["data"], pdf["shape"], pdf["orig_shape"], strict=True)
            ]
            yield pdf.assign(shape=[list(m.shape) for m in made], data=[m.ravel() for m in made])[["chunk_id", "vol", "shape", "data"]]

    both = df.join(original.select("chunk_id", "orig_shape"), "chunk_id")
    return both.select("chunk_id", "vol", "shape", "data", "orig_shape").mapInPandas(run, VOLUME)


def flip_x(df: DataFrame, epoch: int, seed: int, rate: float = 0.5) -> DataFrame:
    """Left-right flips of the chunks whose coin, a hash of (chunk, epoch, seed), says so; a chunk's volumes all share it."""
    coin = F.conv(F.substring(F.md5(F.concat("chunk_id", F.lit(f"#{epoch}#{seed}"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    marked = df.withColumn("_flip", coin < rate)
    columns = ["chunk_id", "vol", "shape", "data", *(["mean_data"] if "mean_data" in df.columns else [])]
    whole = marked.filter("NOT _flip").select(*columns)
    return whole.unionByName(_each(marked.filter("_flip"), lambda v: v[::-1]))


def smoothness_of(v: np.ndarray) -> float:
    """Mean absolute forward differences, averaged over the axes that have any."""
    parts = [np.abs(np.diff(v.astype(np.float64), axis=k)).mean() for k in range(3) if v.shape[k] > 1]
    return float(np.mean(parts)) if parts else 0.0


def smoothness(df: DataFrame) -> DataFrame:
    """(chunk_id, smoothness): mean over the chunk's volumes."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            v = [smoothness_of(np.asarray(d, np.float32).reshape(s)) for d, s in zip(pdf["data"], pdf["shape"], strict=True)]
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "s": v})

    each = df.select("chunk_id", "shape", "data").mapInPandas(run, "chunk_id string, s double")
    return each.groupBy("chunk_id").agg(F.avg("s").alias("smoothness"))


def apply_mask(df: DataFrame, mask: np.ndarray) -> DataFrame:
    """Zero outside the mask (value > 0.5). The mask is one volume; its shape is checked against each."""
    keep = np.asarray(mask) > 0.5

    def one(v: np.ndarray) -> np.ndarray:
        if v.shape != keep.shape:
            raise ValueError(f"shape_mismatch: volume {v.shape}, mask {keep.shape}")
        return np.where(keep, v, np.float32(0))

    return _each(df, one)


def preprocess(df: DataFrame, masks: dict[str, np.ndarray], subject: str = "subject") -> tuple[DataFrame, DataFrame]:
    """(volumes, log): every run's volumes, zero outside the mask of its subject's age group, and one log row for each run.

    df: chunk_id, ``subject``, vol, shape, data and load_error (null, or why the file couldn't be read). masks: by
    the kinds of ``text.mask_kind``. log: chunk_id, subject, mask_used, status (processed, load_error, shape_error
    of volumes without three axes, or shape_mismatch), n_volumes and n_brain_voxels; both null unless processed.
    Only processed runs have volumes.
    """
    kind = mask_kind(F.col(subject))
    shapes = F.map_from_arrays(F.array(*map(F.lit, masks)), F.array(*(F.array(*map(F.lit, m.shape)) for m in masks.values())))
    brain = F.map_from_arrays(F.array(*map(F.lit, masks)), F.array(*(F.lit(int((np.asarray(m) > 0.5).sum())).cast("long") for m in masks.values())))
    status = (
        F.when(F.coalesce("load_error", F.lit("")) != "", "load_error")
        .when(F.size("shape") != 3, "shape_error")
        .when(F.col("shape") != F.element_at(shapes, kind), "shape_mismatch")
        .otherwise("processed")
    )
    marked = df.withColumns({"mask_used": kind, "status": status})
    worst = F.min_by("status", F.when(F.col("status") == "processed", 1).otherwise(0))
    log = marked.groupBy("chunk_id", subject, "mask_used").agg(worst.alias("status"), F.count("vol").alias("_n"))
    done = F.col("status") == "processed"
    log = log.select("chunk_id", subject, "mask_used", "status", F.when(done, F.col("_n")).alias("n_volumes"), F.when(done, F.element_at(brain, F.col("mask_used"))).alias("n_brain_voxels"))
    good = marked.join(log.filter(done).select("chunk_id"), "chunk_id", "left_semi")
    parts = [apply_mask(good.filter(F.col("mask_used") == k), m) for k, m in masks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, log


def _voxels(df: DataFrame, *by: str) -> DataFrame:
    """One row for each voxel of each volume: ``by``, vol, k and x as a double."""
    return df.select(*by, "vol", F.posexplode("data").alias("k", "x")).withColumn("x", F.col("x").cast("double"))


def percent_signal_change(df: DataFrame, level: float = 0.01, epsilon: float = 1e-6) -> DataFrame:
    """(chunk_id, vol, shape, data, mean_data): (x - mean) / (|mean| + epsilon) where the mean over time
    exceeds ``level`` of the largest mean, 0 elsewhere; and the mean.

    Means are grouped sums by voxel, so a chunk may have any number of volumes.
    """
    mean = _voxels(df, "chunk_id").groupBy("chunk_id", "k").agg(F.avg("x").alias("m"))
    mean = mean.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("_mean"))

    def psc(x, m):
        on = m > level * F.array_max("_mean")
        return F.when(on, (x.cast("double") - m) / (F.abs(m) + epsilon)).otherwise(0.0).cast("float")

    both = df.select("chunk_id", "vol", "shape", "data").join(mean, "chunk_id")
    return both.select("chunk_id", "vol", "shape", F.zip_with("data", "_mean", psc).alias("data"), F.col("_mean").cast("array<float>").alias("mean_data"))


def undo_percent_signal_change(df: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """psc (|mean| + epsilon) + mean."""
    back = F.zip_with("data", "mean_data", lambda p, m: (p * (F.abs(m) + F.lit(epsilon).cast("float")) + m).cast("float"))
    return df.select("chunk_id", "vol", "shape", back.alias("data"))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def _signals(df: DataFrame, *by: str) -> DataFrame:
    """``df`` with each volume's mean (signal) and its root mean square change from the one before (change; null for the first)."""
    before = F.lag("data").over(Window.partitionBy(*by).orderBy("vol"))
    squares = F.zip_with("data", "_before", lambda x, y: (x - y) * (x - y))
    return df.withColumn("_before", before).select("*", _mean(F.col("data")).alias("signal"), F.sqrt(_mean(squares)).alias("change")).drop("_before")


def _or_null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def chunk_metrics(df: DataFrame) -> DataFrame:
    """One row of QC metrics for each chunk; NaN and infinities count as 0 after they have been flagged.

    A chunk of one volume has neither changes nor tSNR. voxel_size is there where ``df`` has an affine.
    """
    infinite = lambda x: F.abs(x) == float("inf")
    clean = F.transform(F.col("data").cast("array<double>"), lambda x: F.when(F.isnan(x) | infinite(x), 0.0).otherwise(x))
    flags = [F.exists("data", F.isnan).alias("nan"), F.exists("data", infinite).alias("inf")]
    affine = F.col("affine") if "affine" in df.columns else F.lit(None).cast("array<double>")
    v = df.select("chunk_id", "vol", "shape", affine.alias("affine"), *flags, clean.alias("data"))
    n = F.count(F.lit(1)).cast("int")
    each = _signals(v, "chunk_id").groupBy("chunk_id").agg(
        n.alias("n_vols"),
        F.concat(F.lit("("), F.array_join(F.concat(F.min_by("shape", "vol"), F.array(n)).cast("array<string>"), ", "), F.lit(")")).alias("shape"),
        F.when(F.min_by("affine", "vol").isNotNull(), list_text(voxel_sizes(F.min_by("affine", "vol")))).alias("voxel_size"),
        F.bool_or("nan").alias("has_nan"),
        F.bool_or("inf").alias("has_inf"),
        F.min(F.array_min("data")).alias("intensity_min"),
        F.max(F.array_max("data")).alias("intensity_max"),
        F.avg("signal").alias("intensity_mean"),
        F.avg("change").alias("dvars_mean"),
        F.max("change").alias("dvars_max"),
        F.avg("signal").alias("gs_mean"),
        F.stddev_pop("signal").alias("gs_std"),
    )
    voxels = _voxels(v, "chunk_id").groupBy("chunk_id", "k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count(F.lit(1)).alias("n"))
    voxels = voxels.filter("n > 1")
    level = voxels.groupBy("chunk_id").agg((0.1 * F.avg("m")).alias("level"))
    tsnr = F.when(F.col("s") > 0, F.col("m") / F.col("s")).otherwise(0.0)
    inside = voxels.join(level, "chunk_id").filter("m > level").withColumn("t", tsnr)
    middle = quantiles(inside, ["chunk_id"], "t", {"tsnr_median": 0.5})
    inside = inside.groupBy("chunk_id").agg(F.avg("t").alias("tsnr_mean")).join(middle, "chunk_id")
    names = "chunk_id n_vols shape voxel_size has_nan has_inf intensity_min intensity_max intensity_mean dvars_mean dvars_max tsnr_mean tsnr_median gs_mean gs_std".split()
    return each.join(inside, "chunk_id", "left").select(*names, F.lit(None).cast("string").alias("load_error"))


CHECKS = "chunk_id string, vol int, n_brain long, n_outside long, n_nonzero long, signal double, zero boolean, fits boolean"


def volume_checks(df: DataFrame, mask: np.ndarray) -> DataFrame:
    """What a verification report needs of each masked series: n_volumes, n_brain_voxels, n_outside,
    n_nonzero_outside_brain (of the first volume only), mean_signal_brain, n_zero_volumes and dims_match. What is at most 1e-6 counts as zero, of a volume the mean.

    Volumes are looked at one by one; only a few numbers of each are exchanged.
    """
    keep = np.asarray(mask) > 0.5

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for name, vol, shape, data in zip(pdf["chunk_id"], pdf["vol"], pdf["shape"], pdf["data"], strict=True):
                v, fits = np.asarray(data, np.float64), tuple(shape) == keep.shape
                brain = keep.ravel() if fits else np.zeros(len(v), bool)
                signal = float(np.abs(v[brain]).mean()) if brain.any() else None
                out.append((name, vol, int(brain.sum()), int((~brain).sum()), int((np.abs(v[~brain]) > 1e-6).sum()), signal, signal is not None and signal < 1e-6, fits))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHECKS.split(", ")])

    each = df.select("chunk_id", "vol", "shape", "data").mapInPandas(run, CHECKS)
    first = lambda c: F.min_by(c, "vol").alias
    return each.groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("n_volumes"),
        first("n_brain")("n_brain_voxels"),
        first("n_outside")("n_outside"),
        first("n_nonzero")("n_nonzero_outside_brain"),
        F.avg("signal").alias("mean_signal_brain"),
        F.count_if("zero").alias("n_zero_volumes"),
        F.bool_and("fits").alias("dims_match"),
    )


def training_metrics(x: np.ndarray, shape: tuple[int, ...]) -> dict[str, float]:
    """DVARS, tSNR (sample deviation), global signal deviation (sample) and smoothness of (T, voxels)."""
    x = x.astype(np.float64)
    mean, std = x.mean(axis=0), x.std(axis=0, ddof=1)
    on = np.abs(mean) > 0
    return {
        "dvars": float(np.sqrt((np.diff(x, axis=0) ** 2).mean(axis=1)).mean()),
        "tsnr": float((np.abs(mean) / np.maximum(std, 1e-6))[on].mean()) if on.any() else 0.0,
        "gs_std": float(x.mean(axis=1).std(ddof=1)),
        "smoothness": float(np.mean([smoothness_of(v.reshape(shape)) for v in x])),
    }


def metric_bundle(before: DataFrame, after: DataFrame) -> DataFrame:
    """Metrics of each chunk before and after correction; improvements are positive where correction helped."""

    i, o = _training(before, "input"), _training(after, "corrected")
    out = ["chunk_id"]
    for m, better in (("dvars", -1), ("tsnr", 1), ("gs_std", -1)):
        a, b = F.col(f"{m}_input"), F.col(f"{m}_corrected")
        out += [_or_null(a).alias(f"{m}_input"), _or_null(b).alias(f"{m}_corrected"), _or_null(better * (b - a)).alias(f"{m}_improvement")]
    a, b = F.col("smoothness_input"), F.col("smoothness_corrected")
    out += [_or_null(a).alias("smoothness_input"), _or_null(b).alias("smoothness_corrected"), _or_null(b / (a + 1e-8)).alias("smoothness_ratio")]
    return i.join(o, "chunk_id").select(*out)


def _training(df: DataFrame, side: str) -> DataFrame:
    """``training_metrics`` of each chunk, with names that end in ``side``."""
    v = df.select("chunk_id", "vol", F.col("data").cast("array<double>").alias("data"))
    each = _signals(v, "chunk_id").groupBy("chunk_id").agg(F.avg("change").alias(f"dvars_{side}"), F.stddev_samp("signal").alias(f"gs_std_{side}"))
    voxels = _voxels(v, "chunk_id").groupBy("chunk_id", "k").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    on = (F.abs("m") > 0) & ~F.isnan("m")
    t = F.when(on & F.col("s").isNotNull(), F.abs("m") / F.greatest("s", F.lit(1e-6)))
    tsnr = voxels.groupBy("chunk_id").agg(F.when(F.bool_or(on), F.avg(t)).otherwise(0.0).alias(f"tsnr_{side}"))
    return each.join(tsnr, "chunk_id").join(smoothness(df).withColumnRenamed("smoothness", f"smoothness_{side}"), "chunk_id")


def psc_report(psc: DataFrame, by: str) -> DataFrame:
    """Range, deviation, asymmetry and coverage (share of voxels that are not zero) of normalised data, by domain."""
    v = psc.select(by, F.explode("data").alias("x"))
    on = F.when(F.col("x") != 0, F.col("x").cast("double"))
    return v.groupBy(by).agg(
        F.min(on).alias("min"),
        F.max(on).alias("max"),
        F.stddev_pop(on).alias("std"),
        F.skewness(on).alias("asymmetry"),
        (F.count(on) / F.count(F.lit(1))).alias("coverage"),
    )


def correct(df: DataFrame, make_predict: Callable, shape: tuple[int, int, int], batch_size: int = 4) -> DataFrame:
    """Volumes of one shape through a model: ``make_predict`` returns a function of (batch, values) to the same, once for each worker."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T

    model = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size, input_tensor_shapes=[[int(np.prod(shape))]])
    return df.select("chunk_id", "vol", "shape", model("data").alias("data"))


def extract_chunks(volumes: DataFrame, chunks: DataFrame, key: str = "run_key") -> DataFrame:
    """Volumes of each chunk as rows (chunk_id, vol from 0, shape, data): volumes are dealt by run once."""
    held = chunks.select(key, "chunk_id", "chunk_start", "chunk_end")
    inside = volumes.join(held, key).filter(F.col("vol").between(F.col("chunk_start"), F.col("chunk_end")))
    return inside.select("chunk_id", (F.col("vol") - F.col("chunk_start")).cast("int").alias("vol"), "shape", "data")
