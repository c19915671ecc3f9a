"""Many files that are written from a larger table: motion parameters and volumes."""

from collections import Counter

from pyspark.sql import functions as F

from framewise.plans.source_queries import motion_parameter_scan
from framewise.sources import volume_source


def test_runs_are_one_file_each(spark, tmp_path):
    """Short tables beside a long one are coalesced otherwise; a run's lines are in one file all the same."""
    rows = spark.range(0, 10_000, 1, 8).select(F.col("id").alias("vec_id"), F.array(*(F.rand(k).cast("float") for k in range(64))).alias("embedding"), (F.col("id") % 10).cast("int").alias("label"))
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        found = Counter((r.run_key, r.vol < 0) for r in motion_parameter_scan(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == {(k, k % 3 == 2): 1 if k % 3 == 2 else 1000 for k in range(10)}


def test_small_files_share_tasks(spark, tmp_path):
    """Three hundred files of two volumes are two tasks', by their number or by their bytes; a bad file among them is a row."""
    volume_source.register(spark)
    rows = spark.range(0, 600, 1, 2).select(F.format_string("f%03d", F.floor(F.col("id") / 2)).alias("path"), (F.col("id") % 2).cast("int").alias("vol"), F.array(*map(F.lit, (2, 2, 2))).alias("shape"), F.array(*[F.col("id").cast("float")] * 8).alias("data"))
    rows.repartition("path").sortWithinPartitions("path", "vol").write.format("volumes").mode("append").save(str(tmp_path / "many"))
    (tmp_path / "many" / "f100x.nii.gz").write_bytes(b"nothing")
    parts = volume_source.VolumeReader({"path": str(tmp_path / "many")}).partitions()
    assert len(parts) == 3  # the bad file may be of any size
    assert len(volume_source.VolumeReader({"path": str(tmp_path / "many"), "taskbytes": str(64 * 100)}).partitions()) == 5
    read = spark.read.format("volumes").load(str(tmp_path / "many"))
    got = read.agg(F.count("vol").alias("n"), F.count("load_error").alias("bad"), F.sum(F.get("data", F.lit(0))).alias("sum"), F.count_distinct("path").alias("files")).first()
    assert (got.n, got.bad, got.sum, got.files) == (600, 1, 599 * 300, 301)
