"""Discovery of runs as a stream of files: each call lists what no earlier call has listed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.sources.listing import discover_runs

FILES = "path string, modificationTime timestamp, length long, content binary"


def new_runs(spark: SparkSession, pattern: str, state: str, strict: bool = True, files_each: int = 100_000) -> DataFrame:
    """discover_runs() of the files that match ``pattern`` and are new since the last call with this ``state`` folder, with their batch.

    The stream takes all files that are there and ends; the names of those it has seen are its checkpoint, so a
    call looks at file names only. Contents are never read, as their column isn't selected. A batch that runs
    again, after a failure, writes the same folder again. ``pattern`` names every level
    (``root/*/*/*/*.nii.gz``), since a recursive listing passes over folders that begin with an underscore.
    listed_runs() has those of all calls.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_each).load(pattern)

    def write(batch: DataFrame, k: int) -> None:
        discover_runs(batch, strict).write.mode("overwrite").parquet(f"{state}/found/batch={k}")

    query = files.select("path").writeStream.foreachBatch(write).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    batches = [p["batchId"] for p in query.recentProgress if p["numInputRows"] > 0]
    if not batches:
        empty = discover_runs(spark.createDataFrame([], "path string"), strict)
        return empty.withColumn("batch", F.lit(0))
    return listed_runs(spark, state).filter(F.col("batch") >= min(batches))


def listed_runs(spark: SparkSession, state: str) -> DataFrame:
    """What all calls have found, with their batches; the folder's batches are pruned by filters on that column."""
    return spark.read.parquet(f"{state}/found")
