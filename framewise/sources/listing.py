"""Listings of files as tables, with what their paths say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.functions.text import DIRECTORY_PATTERNS, STRICT_SESSION, basename, entity, is_wanted_task, mask_kind, masked_name, parent


def patterns(spark: SparkSession, root: str, glob: str, depth: int = 6) -> list[str]:
    """Path patterns of the files under ``root``, one for each depth that has any.

    A recursive listing passes over folders whose names begin with an underscore, as those of
    subjects and runs do; patterns that name every level do not.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for k in range(depth + 1):
        pattern = root.rstrip("/") + "/*" * k + "/" + glob
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        if path.getFileSystem(conf).globStatus(path):
            found.append(pattern)
    return found


def binary_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path, modificationTime, length and content of the files under ``root``; empty if there are none."""
    found = patterns(spark, root, glob)
    if not found:
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    return spark.read.format("binaryFile").load(found)


def list_files(spark: SparkSession, root: str, glob: str = "*.nii*", required: bool = False) -> DataFrame:
    """(path, length, modificationTime, name); contents are not read, as their column is not selected."""
    out = binary_files(spark, root, glob).select("path", "length", "modificationTime", basename("path").alias("name"))
    if required and out.isEmpty():
        raise FileNotFoundError(f"no {glob} under {root}")
    return out


def discover_runs(files: DataFrame, strict: bool = True) -> DataFrame:
    """subject, session, run, task, input_path, output_path and mask of the wanted, unmasked volumes.

    The session's customary pattern runs on over underscores; ``strict`` stops at the session itself.
    """
    folder = basename(parent("path"))
    found = files.select(
        entity("path", DIRECTORY_PATTERNS["subject"]).alias("subject"),
        entity(folder, STRICT_SESSION if strict else DIRECTORY_PATTERNS["session"]).alias("session"),
        entity(folder, DIRECTORY_PATTERNS["run"]).alias("run"),
        entity(folder, DIRECTORY_PATTERNS["task"], "").alias("task"),
        F.col("path").alias("input_path"),
        masked_name("path").alias("output_path"),
    )
    wanted = (F.col("task") != "") & is_wanted_task("task") & ~F.col("input_path").contains("_masked.nii")
    return found.filter(wanted).withColumn("mask_used", mask_kind("subject"))


def subjects(files: DataFrame) -> DataFrame:
    """Distinct subjects of a listing, in order."""
    return files.select(entity("path", DIRECTORY_PATTERNS["subject"], "").alias("subject")).filter("subject <> ''").distinct().orderBy("subject")
