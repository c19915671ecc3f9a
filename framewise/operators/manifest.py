"""Manifests, logs and verification reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions.arrays import exact_round, percent_outside
from framewise.functions.text import chunk_name, iso_seconds
from framewise.operators.dataset import slice_status


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by ``order``; ties are the caller's to exclude.

    One aggregate, combined before the exchange, instead of a sorted window.
    """
    rest = [c for c in df.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(last).select(*(c if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns))


def upsert(old: DataFrame, new: DataFrame, key: str = "input_path", order: list[str] | None = None) -> DataFrame:
    """Old and new rows, the newer one where both have the key; rows without a key all stay.

    Of several new (or old) rows of one key the last by ``order`` stays, by default by all columns, so that
    the result doesn't depend on partitions.
    """
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    rest = order or sorted(c for c in both.columns if c not in (key, "_seq"))
    named = keep_last(both.filter(F.col(key).isNotNull() & (F.col(key) != "")), [key], ["_seq", *rest])
    return named.unionByName(both.filter(F.col(key).isNull() | (F.col(key) == ""))).drop("_seq")


def status_pivot(df: DataFrame, by: str, status: str, values: list[str]) -> DataFrame:
    """Counts of each status by group; the values are given, so no pass looks for them."""
    return df.groupBy(by).agg(*(F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values), F.count(F.lit(1)).alias("n_all"))


def extraction_log(chunks: DataFrame, runs: DataFrame, existing: DataFrame, folder: str, split: str, domain: str, at: Column) -> DataFrame:
    """One log row for each chunk: ok, skipped_exists or error with its message, and the output's path unless it is an error.

    chunks: subject_id, session_id, run_id, task, preprocessed_bold_file, chunk_start, chunk_end; runs: the same
    preprocessed_bold_file with n_vols, n_axes and load_error; existing: the names of files that are there.
    """
    name = chunk_name(*(F.col(c) for c in ("subject_id", "session_id", "task", "run_id", "chunk_start", "chunk_end")))
    j = chunks.join(runs, "preprocessed_bold_file", "left").withColumn("_name", name)
    j = j.join(existing.select(F.col("name").alias("_name"), F.lit(True).alias("_there")).distinct(), "_name", "left")
    sliced = slice_status(F.col("chunk_start"), F.col("chunk_end"), F.coalesce("n_vols", F.lit(0)))
    problem = (
        F.when(F.coalesce("load_error", F.lit("")) != "", F.concat(F.lit("Load failed: "), "load_error"))
        .when(F.col("n_axes").isNull(), "Load failed: no such file")
        .when(F.col("n_axes") != 4, F.concat(F.lit("Not 4D: "), F.col("n_axes").cast("string"), F.lit(" axes")))
        .when(F.col("_there"), "")
        .when(sliced != "ok", sliced)
        .otherwise("")
    )
    status = F.when(problem != "", "error").when(F.col("_there"), "skipped_exists").otherwise("ok")
    path = F.when(problem == "", F.concat_ws("/", F.lit(folder.rstrip("/")), "_name")).otherwise("")
    return j.select(
        F.lit(split).alias("split"), F.lit(domain).alias("domain"), "subject_id", "session_id", "run_id", "task", "chunk_start", "chunk_end",
        path.alias("output_path"), status.alias("status"), problem.alias("message"), iso_seconds(at).alias("timestamp"),
    )


def verification(expected: DataFrame, outputs: DataFrame, path: str = "output_path") -> DataFrame:
    """Report of each expected output: MISSING without a file, else FAIL with notes, else PASS.

    outputs: path, load_error, input_shape, output_shape, n_volumes, n_brain_voxels, n_nonzero_outside_brain,
    n_outside, mean_signal_brain, n_zero_volumes and, where there are such, input_error and mask_error. A file that
    can't be loaded, or has another shape than its input, is not looked at further; without its input it is, and
    fails with a note; without its mask nothing more can be said. The count of non-zero voxels outside the brain
    keeps its customary name ``n_zero_outside_brain`` here. A brain's mean signal must be above 1.
    """
    error = lambda c: F.coalesce(F.col(c), F.lit("")) if c in outputs.columns else F.lit("")
    j = expected.join(outputs.withColumn("_has", F.lit(True)), path, "left")
    exists = F.coalesce("_has", F.lit(False))
    loaded = exists & (F.coalesce("load_error", F.lit("")) == "")
    no_input = loaded & (error("input_error") != "")
    dims = loaded & ~no_input & F.coalesce(F.col("input_shape") == F.col("output_shape"), F.lit(False))
    no_mask = (dims | no_input) & (error("mask_error") != "")
    looked = (dims | no_input) & ~no_mask
    seen = lambda c: F.when(looked, c)
    signal, outside, zero = F.col("mean_signal_brain"), F.col("n_nonzero_outside_brain"), F.col("n_zero_volumes")
    # the report's texts are fixed values
    notes = (
        F.when(~exists, "")
        .when(~loaded, F.concat(F.lit("Load error: "), "load_error"))
        .when(~dims & ~no_input, F.concat(F.lit("Shape mismatch: input="), F.coalesce("input_shape", F.lit("none")), F.lit(" output="), F.coalesce("output_shape", F.lit("none"))))
        .when(no_mask, F.concat(F.lit("Mask load error: "), error("mask_error")))
        .otherwise(
            F.concat_ws(
                " ",
                F.when(no_input, F.concat(F.lit("Input load error: "), error("input_error"))),
                F.when(outside > 0, F.format_string("Non-brain voxels not fully zeroed (%d non-zero outside brain).", outside.cast("long"))),
                F.when(~F.coalesce(signal > 1.0, F.lit(False)), "Brain signal unexpectedly low."),
                F.when(zero > 0, F.format_string("%d all-zero brain volume(s).", zero.cast("long"))),
            )
        )
    )
    status = F.when(~exists, "MISSING").when(notes != "", "FAIL").otherwise("PASS")
    return j.select(
        *expected.columns,
        exists.alias("output_exists"),
        loaded.alias("file_loadable"),
        dims.alias("dims_match"),
        F.when(loaded, F.col("n_volumes")).alias("n_volumes"),
        F.when(loaded & ~no_input, F.col("input_shape")).alias("input_shape"),
        F.when(loaded, F.col("output_shape")).alias("output_shape"),
        seen(F.col("n_brain_voxels")).alias("n_brain_voxels"),
        seen(outside).alias("n_zero_outside_brain"),
        seen(exact_round(percent_outside(F.col("n_outside"), outside), 2)).alias("pct_outside_zeroed"),
        seen(exact_round(signal, 4)).alias("mean_signal_brain"),
        (looked & F.coalesce(signal > 1.0, F.lit(False))).alias("brain_has_signal"),
        seen(zero).alias("n_zero_volumes"),
        status.alias("status"),
        notes.alias("notes"),
    )
