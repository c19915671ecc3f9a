"""Watching runs while they are acquired: displacement summaries by event time, flags, and a manifest sink.

An extension: the batch operators need finished runs, a scanner's operator does not want to wait.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framewise.operators.manifest import upsert
from framewise.operators.qc import qc_flags
from framewise.params import QcLimits


def motion_windows(stream: DataFrame, keys: list[str], ts: str, fd: str, threshold: float, length: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Mean, maximum and share of volumes at or above the threshold in each window; rows later than ``late`` drop out."""
    w = F.window(ts, length)
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    out = stream.withWatermark(ts, late).groupBy(*keys, w).agg(
        F.count(F.lit(1)).alias("n_vols"),
        F.avg(fd).alias("mean_fd"),
        F.max(fd).alias("max_fd"),
        F.count_if(F.col(fd) >= threshold).alias("n_above"),
    )
    return out.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n_vols", "mean_fd", "max_fd", "n_above")


def flag_stream(stream: DataFrame, limits: QcLimits = QcLimits()) -> DataFrame:
    """Flagged chunks, without state."""
    return qc_flags(stream, limits)


def manifest_sink(stream: DataFrame, path: str, checkpoint: str, key: str = "input_path", buckets: int = 64) -> StreamingQuery:
    """Keeps a Parquet manifest up to date: each micro-batch's rows replace older ones with their key.

    The manifest is cut by the key's hash into folders, and a micro-batch rewrites only those that it has keys
    of: into a new version beside the one that is there, which goes when the one after is written. So a
    batch that runs again writes the same again. read_manifest() reads the newest version of every bucket.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", _bucket(key, buckets))
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # as many as there are buckets
        have = _versions(spark, path)
        older = {b: [v for v in have.get(b, []) if v < number] for b in touched}
        old = [f"{path}/bucket={b}/version={v[-1]}" for b, v in older.items() if v]
        before = spark.read.schema(batch.schema).parquet(*old) if old else batch.limit(0)
        made = upsert(before, batch, key).withColumns({"bucket": _bucket(key, buckets), "version": F.lit(number)})
        # by each bucket's own folder: those of a batch that runs again are written over, others stay
        made.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(path)
        for b, versions in older.items():
            for v in versions[:-1]:
                _delete(spark, f"{path}/bucket={b}/version={v}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the newest versions; without any version no rows."""
    newest = [f"{path}/bucket={b}/version={v[-1]}" for b, v in sorted(_versions(spark, path).items())]
    return spark.read.schema(schema).parquet(*newest) if newest else spark.createDataFrame([], schema)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    p, fs = _folder(spark, f"{path}/bucket=*/version=*")
    out: dict[int, list[int]] = {}
    for s in fs.globStatus(p) or []:
        bucket, version = (x.split("=")[1] for x in s.getPath().toString().split("/")[-2:])
        out.setdefault(int(bucket), []).append(int(version))
    return {b: sorted(v) for b, v in out.items()}


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _folder(spark, path)
    fs.delete(p, True)
