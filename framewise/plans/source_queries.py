"""Queries that write a given table in one of the formats and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.operators.motion import series_window
from framewise.operators.storage import shared_dir
from framewise.plans.series import VECTORS_SQL, table, vector_series
from framewise.sources import tables
from framewise.sources.motion_params import NAMES, bad_files, read_motion_parameters


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def csv_chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as a table of corrupted chunks: written as CSV with quotes and commas in it, read by its fixed schema."""
    li, where = table(spark, sf_dir, "lineitem"), _folder(spark, "chunks-csv")
    text = lambda c: F.col(c).cast("string")
    rows = li.select(
        text("l_orderkey").alias("subject_id"), text("l_linenumber").alias("session_id"), text("l_suppkey").alias("run_id"), F.lit("rest5").alias("task"),
        F.concat(F.lit('a "quoted", '), "l_linestatus").alias("bold_file"), F.lit(None).cast("string").alias("motion_parameter_file"),
        F.col("l_linenumber").cast("int").alias("chunk_start"), (F.col("l_linenumber") + 19).cast("int").alias("chunk_end"),
        (F.col("l_extendedprice") / 7).alias("chunk_mean_fd"), F.col("l_extendedprice").alias("chunk_max_fd"), F.col("l_quantity").cast("int").alias("n_vols_above_thr"),
        F.col("l_discount").cast("double").alias("frac_vols_above_thr"), F.lit(3).alias("max_sustained_streak"), F.lit(200).alias("n_total_vols_in_run"),
    )
    tables.write_csv(rows, where)
    back = tables.read_csv(spark, where, tables.CORRUPTED, ["subject_id", "chunk_start"])
    return back.select("subject_id", "session_id", "run_id", "bold_file", F.col("motion_parameter_file").isNull().alias("no_file"), "chunk_end", F.round("chunk_mean_fd", 4).alias("chunk_mean_fd"), "n_vols_above_thr")


CSV_CHUNKS = """
SELECT l_orderkey::VARCHAR AS subject_id, l_linenumber::VARCHAR AS session_id, l_suppkey::VARCHAR AS run_id, 'a "quoted", ' || l_linestatus AS bold_file, true AS no_file,
       (l_linenumber + 19)::INT AS chunk_end, round(l_extendedprice / 7, 4) AS chunk_mean_fd, l_quantity::INT AS n_vols_above_thr FROM lineitem
"""


def motion_parameter_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors' first six values as motion-parameter files, a comment in front; every third run has a line too short and is left out."""
    where = _folder(spark, "motion")
    v = vector_series(spark, sf_dir).withColumn("next", F.lead("vol").over(series_window(["run_key"], "vol")))
    line = F.array_join(F.transform(F.slice("x", 1, 6), lambda x: x.cast("string")), "   ")
    front = F.when(F.col("vol") == 0, "# rotations, then translations")
    short = F.when(F.col("next").isNull() & (F.col("run_key") % 3 == 2), "0.5 1.5")
    # each line comes from its volume's row: a union of tables dealt by run_key is not dealt anew, and left a run's lines in several files
    every = v.select("run_key", "vol", F.posexplode(F.array_compact(F.array(front, line, short))).alias("place", "value"))
    every.repartition("run_key").sortWithinPartitions("run_key", "vol", "place").select("value", "run_key").write.partitionBy("run_key").text(where)
    key = F.regexp_extract("path", r"run_key=(-?\d+)", 1).cast("int").alias("run_key")
    good = read_motion_parameters(spark, f"{where}/run_key=*", "skip").select(key, "vol", *(F.round(c, 6).alias(c) for c in NAMES))
    bad = bad_files(spark, f"{where}/run_key=*").select(key, F.lit(-1).alias("vol"), *(F.lit(0.0).alias(c) for c in NAMES))
    return good.unionByName(bad)


MOTION_SCAN = f"""
WITH {VECTORS_SQL}
SELECT run_key, vol, {", ".join(f"round(x[{k + 1}], 6) AS {c}" for k, c in enumerate(NAMES))} FROM v WHERE run_key % 3 <> 2
UNION ALL SELECT DISTINCT run_key, -1, {", ".join(["0.0"] * 6)} FROM v WHERE run_key % 3 = 2
"""


def domain_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in folders by split and domain, of which those of one split are read."""
    o, where = table(spark, sf_dir, "orders"), _folder(spark, "domains")
    split = F.when(F.col("o_custkey") % 10 < 7, "train").when(F.col("o_custkey") % 10 == 7, "val").otherwise("test")
    domain = F.when(F.col("o_orderstatus") == "F", "A_corrupted").otherwise("B_motion_free")
    tables.write_by_domain(o.select("o_orderkey", "o_totalprice", split.alias("split"), domain.alias("domain")), where)
    return spark.read.parquet(where).filter("split = 'val'").select("o_orderkey", "o_totalprice", "split", "domain")


DOMAIN_FOLDERS = """
SELECT o_orderkey, o_totalprice, 'val' AS split, CASE WHEN o_orderstatus = 'F' THEN 'A_corrupted' ELSE 'B_motion_free' END AS domain FROM orders WHERE o_custkey % 10 = 7
"""


def appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs that append to one log; the second has no messages, so its rows have empty ones."""
    e, where = table(spark, sf_dir, "events"), _folder(spark, "log")
    columns = ["event_id", "status", "message"]
    tables.append_log(e.select("event_id", F.lit("ok").alias("status"), F.concat(F.lit("user "), "user_id").alias("message")), where, columns)
    tables.append_log(e.filter("value > 50").select("event_id", F.lit("skipped_exists").alias("status"), "value"), where, columns)
    back = spark.read.option("header", True).schema("event_id long, status string, message string").csv(where)
    return back.select("event_id", "status", F.coalesce("message", F.lit("")).alias("message"))


APPENDED_LOG = """
SELECT event_id, 'ok' AS status, 'user ' || user_id AS message FROM events UNION ALL SELECT event_id, 'skipped_exists', '' FROM events WHERE value > 50
"""

QUERIES = {
    "csv_chunk_table": (csv_chunk_table, CSV_CHUNKS),
    "motion_parameter_scan": (motion_parameter_scan, MOTION_SCAN),
    "domain_folders": (domain_folders, DOMAIN_FOLDERS),
    "appended_log": (appended_log, APPENDED_LOG),
}
