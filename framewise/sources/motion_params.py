"""Motion-parameter files: white-space text, six numbers a line, the line's place being the volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ["rot_x", "rot_y", "rot_z", "trans_x", "trans_y", "trans_z"]


def read_motion_parameters(spark: SparkSession, path: str, bad: str = "raise") -> DataFrame:
    """(path, vol, rot_x, ..., trans_z). Comments from # on and blank lines don't count.

    A file is read whole, since only then its lines have an order; runs have some hundred lines. Of a file
    with a line that has not six numbers, ``bad`` says what becomes: "raise" fails the query with the file's
    name, "skip" leaves its run out (see bad_files()), and "null" gives null values for all its lines.
    """
    if bad not in ("raise", "skip", "null"):
        raise ValueError(f"unknown treatment of bad files {bad}")
    files = _parsed(spark, path)
    good = F.col("problem").isNull()
    if bad == "skip":
        files = files.filter(good)
    elif bad == "raise":
        checked = F.when(good, F.col("lines")).otherwise(F.raise_error(F.concat_ws(": ", "path", "problem")))
        files = files.withColumn("lines", checked)
    rows = files.select("path", good.alias("good"), F.posexplode("lines").alias("vol", "p"))
    return rows.select("path", "vol", *(F.when(F.col("good"), F.get("p", F.lit(k))).alias(n) for k, n in enumerate(NAMES)))


def bad_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, problem) of the files that don't have six numbers in every line, or no line."""
    return _parsed(spark, path).filter("problem IS NOT NULL").select("path", "problem")


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    """path, lines (arrays of numbers, null where they are none) and problem."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    clean = F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "#.*$", ""), r"\s+", " ")))
    lines = F.transform(F.filter(clean, lambda x: x != ""), lambda x: F.transform(F.split(x, " "), lambda y: y.try_cast("double")))
    rows = files.select("path", lines.alias("lines"))
    wide = F.exists("lines", lambda x: F.size(x) != 6)
    text = F.exists("lines", lambda x: F.exists(x, lambda y: y.isNull()))
    return rows.withColumn("problem", F.when(F.size("lines") == 0, "no line").when(wide, "not six columns").when(text, "not a number"))
