"""Queries that write a given table as files of volumes and read them by the data source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.functions.text import basename
from framewise.operators.extraction import extract_files
from framewise.operators.storage import shared_dir, stored
from framewise.plans.series import VECTORS_SQL, vector_series
from framewise.sources import volume_source


def _written_runs(spark: SparkSession, sf_dir: str) -> str:
    """The folder with a file for each label: its vectors as volumes of 4 x 4 x 4 voxels, in the order of ids."""
    volume_source.register(spark)
    folder = f"{shared_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    rows = vector_series(spark, sf_dir).select(
        F.format_string("run-%d", "run_key").alias("path"), F.col("vol").cast("int").alias("vol"), F.array(*map(F.lit, (4, 4, 4))).alias("shape"), F.col("x").cast("array<float>").alias("data")
    )
    rows.repartition("path").sortWithinPartitions("path", "vol").write.format("volumes").mode("append").save(folder)
    return folder


def _sums(volumes: DataFrame) -> DataFrame:
    total = F.aggregate(F.col("data").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return volumes.withColumn("sum", F.round(total, 4) + 0.0)


def ranged_volume_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes 3 to 40 of every run, from files that were written from the vectors; tasks read ranges of ten volumes."""
    folder = _written_runs(spark, sf_dir)
    scan = spark.read.format("volumes").option("first", 3).option("last", 40).option("taskbytes", 10 * 4 * 64).load(folder)
    run = F.regexp_extract(basename("path"), r"run-(-?\d+)\.nii\.gz$", 1).cast("int")
    return _sums(scan.filter("load_error IS NULL").withColumn("run_key", run)).select("run_key", "vol", "sum", F.get("data", F.lit(5)).cast("double").alias("sixth"))


#: A volume's voxels lie with x fastest in a file and last in a row; both ways they come back in their order.
RANGED_SCAN = f"""
WITH {VECTORS_SQL}
SELECT run_key, vol, round(list_sum(x), 4) + 0.0 AS sum, x[6] AS sixth FROM v WHERE vol BETWEEN 3 AND 40
"""

SIZE, STEP = 6, 2


def one_pass_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of every run, extracted to files in one pass over each run: the log, and what the files hold.

    The last windows reach beyond their runs. decoded: the volumes that were decoded for all chunks of a stretch.
    """
    folder = _written_runs(spark, sf_dir)
    runs = vector_series(spark, sf_dir).groupBy("run_key").agg(F.count(F.lit(1)).alias("n"))
    starts = F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 3, F.lit(STEP)))
    chunks = runs.filter("n >= 3").select("run_key", starts.alias("chunk_start")).withColumn("chunk_end", F.col("chunk_start") + (SIZE - 1))
    chunks = chunks.select(F.format_string(f"{folder}/run-%d.nii.gz", "run_key").alias("path"), F.format_string("run-%d_chunk-%d.nii.gz", "run_key", "chunk_start").alias("chunk_id"), "chunk_start", "chunk_end")
    out = folder + "-chunks"
    log = stored(extract_files(chunks, out), "extraction-log")
    found = _sums(spark.read.format("volumes").load(out)).filter("load_error IS NULL")
    held = found.groupBy(basename("path").alias("chunk_id")).agg(F.count(F.lit(1)).alias("n_read"), F.round(F.sum("sum"), 2).alias("total"))
    both = log.join(held, "chunk_id", "left")
    return both.select("chunk_id", "chunk_start", "chunk_end", "n_vols", "status", "message", "decoded", F.coalesce("n_read", F.lit(0)).alias("n_read"), (F.coalesce("total", F.lit(0.0)) + 0.0).alias("total"))


ONE_PASS = f"""
WITH {VECTORS_SQL}, s AS (SELECT run_key, vol, round(list_sum(x), 4) AS s FROM v), n AS (SELECT run_key, count(*) AS n FROM v GROUP BY run_key),
c AS (SELECT run_key, n, unnest(range(0, n - 2, {STEP}))::INT AS a FROM n WHERE n >= 3),
k AS (SELECT *, a + {SIZE - 1} < n AS fits, max(CASE WHEN a + {SIZE - 1} < n THEN a + {SIZE} ELSE 0 END) OVER (PARTITION BY run_key) AS decoded FROM c)
SELECT 'run-' || run_key || '_chunk-' || a || '.nii.gz' AS chunk_id, a AS chunk_start, a + {SIZE - 1} AS chunk_end, n::INT AS n_vols, CASE WHEN fits THEN 'ok' ELSE 'error' END AS status,
  CASE WHEN fits THEN '' ELSE 'error: invalid slice [' || a || ', ' || (a + {SIZE - 1}) || '] of ' || n || ' volumes' END AS message, decoded::INT AS decoded,
  CASE WHEN fits THEN {SIZE} ELSE 0 END::BIGINT AS n_read, CASE WHEN fits THEN round((SELECT sum(s.s) FROM s WHERE s.run_key = k.run_key AND s.vol BETWEEN a AND a + {SIZE - 1}), 2) ELSE 0 END + 0.0 AS total
FROM k
"""

QUERIES = {"ranged_volume_scan": (ranged_volume_scan, RANGED_SCAN), "one_pass_extraction": (one_pass_extraction, ONE_PASS)}
