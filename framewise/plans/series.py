"""Bindings of the driver's tables to the operators' contracts: series of one value, and series of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.operators.motion import ordinals
from framewise.params import Corruption, SafeZone

#: events have values about fifty times those of a displacement.
EVENT_CORRUPTION = Corruption(size=20, step=1, threshold=50.0, min_fraction=0.5, min_streak=3, min_mean=50.0, max_fd=500.0)
EVENT_SAFE = SafeZone(size=5, threshold=100.0, before=1, after=2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_key, vol, fd: a user's events in the order of time."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_key"), "ts", "event_id", F.col("value").alias("fd"))
    return ordinals(rows, ["run_key"], ["ts", "event_id"]).select("run_key", "vol", "fd")


def vector_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_key, vol, vec_id, x: a label's vectors in the order of ids, as doubles."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("run_key"), "vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return ordinals(rows, ["run_key"], ["vec_id"]).select("run_key", "vol", "vec_id", "x")


#: The same series for DuckDB.
EVENTS_SQL = """e AS (SELECT user_id AS run_key, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS vol, value AS fd FROM events)"""
VECTORS_SQL = """v AS (SELECT label AS run_key, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS vol, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"""
