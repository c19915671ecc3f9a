"""Volume kernels against plain numpy, and NIfTI round trips."""

import struct

import numpy as np
import pytest

from framewise.operators import volumes
from framewise.sources import listing, nifti, tables


@pytest.fixture(scope="module")
def chunk():
    return np.random.default_rng(0).normal(10, 2, (6, 4, 5, 3)).astype(np.float32)


def frame(spark, x, name="c"):
    rows = [(name, t, list(x.shape[1:]), x[t].ravel().tolist()) for t in range(len(x))]
    return spark.createDataFrame(rows, volumes.VOLUME)


def back(df):
    return np.stack([np.array(r["data"], np.float32).reshape(r["shape"]) for r in df.orderBy("vol").collect()])


def test_percent_signal_change_round_trip(spark, chunk):
    x = chunk.copy()
    x[:, 0, 0, 0] = 0
    psc = volumes.percent_signal_change(frame(spark, x))
    got, mean = back(psc), x.mean(axis=0)
    assert np.allclose(got, np.where(mean > 0.01 * mean.max(), (x - mean) / (np.abs(mean) + 1e-6), 0), atol=1e-5)
    assert np.allclose(back(volumes.undo_percent_signal_change(psc)), x, atol=1e-3)


def test_two_voxels(spark):
    x = np.array([[[[90.0, 0.0]]], [[[110.0, 0.0]]]], np.float32)
    got = back(volumes.percent_signal_change(frame(spark, x)))
    assert np.allclose(got[:, 0, 0, 0], [-0.1, 0.1], atol=1e-6) and not got[:, 0, 0, 1].any()


def test_resample_keeps_constants_and_shapes(spark, chunk):
    got = volumes.resample(frame(spark, np.full((2, 4, 5, 3), 7, np.float32)), (8, 3, 6))
    assert back(got).shape == (2, 8, 3, 6) and np.allclose(back(got), 7)
    line = np.arange(4, dtype=np.float32).reshape(1, 4, 1, 1)
    assert np.allclose(back(volumes.resample(frame(spark, line), (8, 1, 1))).ravel(), [0, 0.25, 0.75, 1.25, 1.75, 2.25, 2.75, 3])


def test_flip_twice_is_the_same(spark, chunk):
    df = frame(spark, chunk)
    flipped = volumes.flip_x(df, 1, 2, rate=1.0)
    assert np.array_equal(back(flipped), chunk[:, ::-1])
    assert np.array_equal(back(volumes.flip_x(df, 1, 2, rate=0.0)), chunk)


def test_metrics(spark, chunk):
    x = chunk.copy()
    x[0, 0, 0, 0] = np.nan
    r = volumes.chunk_metrics(frame(spark, x)).first()
    x = np.where(np.isfinite(x), x, 0).astype(np.float64).reshape(6, -1)
    assert r.has_nan and not r.has_inf and r.shape == "(4, 5, 3, 6)"
    assert r.dvars_mean == pytest.approx(np.sqrt((np.diff(x, axis=0) ** 2).mean(1)).mean())
    assert r.gs_std == pytest.approx(x.mean(1).std())
    t = (x.mean(0) / x.std(0))[x.mean(0) > 0.1 * x.mean(0).mean()]
    assert (r.tsnr_mean, r.tsnr_median) == pytest.approx((t.mean(), np.median(t)))


def test_series_of_a_chunk_is_not_stacked(spark, chunk):
    """No kernel holds a whole chunk in one Python group, and the values are those of the whole series."""
    v, half = frame(spark, chunk), frame(spark, chunk * 0.5)
    for df in (volumes.percent_signal_change(v), volumes.chunk_metrics(v), volumes.metric_bundle(v, half)):
        assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().executedPlan().toString()
    r = volumes.metric_bundle(v, half).first()
    i, o = (volumes.training_metrics(x.reshape(len(x), -1).astype(np.float32), chunk.shape[1:]) for x in (chunk, chunk * 0.5))
    for m in ("dvars", "tsnr", "gs_std", "smoothness"):
        assert (r[f"{m}_input"], r[f"{m}_corrected"]) == pytest.approx((i[m], o[m]))
    assert r.dvars_improvement == pytest.approx(i["dvars"] - o["dvars"]) and r.tsnr_improvement == pytest.approx(o["tsnr"] - i["tsnr"])


def test_single_volumes_have_no_changes(spark, chunk):
    r = volumes.chunk_metrics(frame(spark, chunk[:1])).first()
    assert (r.dvars_mean, r.dvars_max, r.tsnr_mean, r.tsnr_median, r.voxel_size) == (None,) * 5 and r.n_vols == 1


def test_mean_volumes_go_along(spark, chunk):
    psc = volumes.percent_signal_change(frame(spark, chunk))
    mean = lambda df: np.array(df.first()["mean_data"]).reshape(df.first()["shape"])
    assert np.array_equal(mean(volumes.flip_x(psc, 1, 2, rate=1.0)), mean(psc)[::-1])
    assert mean(volumes.resample(psc, (8, 3, 6))).shape == (8, 3, 6)


def test_reports_and_logs(spark, tmp_path):
    from framewise.operators import qc
    from framewise.streaming.monitor import flag_stream

    rows = [("c1", 0.9, 20.0, "(4, 4, 4, 2)", "[2.0, 2.0, 2.0]"), ("c2", 0.1, 5.0, "(4, 4, 4, 2)", "[2.0, 2.0, 2.0]"), ("c3", 0.2, 20.0, "(4, 4, 4, 3)", None)]
    df = spark.createDataFrame(rows, "chunk_id string, par_fd_mean double, tsnr_mean double, shape string, voxel_size string")
    reports = qc.domain_reports(df)
    tables.write_reports(reports, str(tmp_path), "val", "corrupted")
    read = lambda n: spark.read.option("header", True).csv(str(tmp_path / "corrupted" / f"val_{n}.csv"))
    assert read("chunk_level_metrics").count() == 3 and {r.metric for r in read("distribution_summary").collect()} == {"par_fd_mean", "tsnr_mean"}
    assert sorted(r.qc_flags for r in read("qc_flags").collect()) == ["high_fd_mean:0.900", "low_tsnr:5.00"] == sorted(r.qc_flags for r in flag_stream(df).collect())
    r = read("shape_report").first()
    assert (r.n_chunks, r.unique_shapes, r.most_common_shape, r.unique_voxsizes, r.most_common_vox, r.shape_inconsistent) == ("3", "2", "(4, 4, 4, 2)", "1", "[2.0, 2.0, 2.0]", "true")
    for status in ("ok", "error"):
        tables.append_log(spark.createDataFrame([("s", status)], "subject_id string, status string"), str(tmp_path / "log"), ["subject_id", "status", "message"])
    assert sorted(tuple(x) for x in spark.read.option("header", True).csv(str(tmp_path / "log")).collect()) == [("s", "error", None), ("s", "ok", None)]
    tables.write_by_domain(df.selectExpr("*", "'val' AS split", "'A_corrupted' AS domain"), str(tmp_path / "by"))
    assert spark.read.parquet(str(tmp_path / "by")).filter("split = 'val' AND domain = 'A_corrupted'").count() == 3


def test_split_tables_are_read(spark, tmp_path):
    from pyspark.sql.types import StructType

    for name, schema in (("train_corrupted_all", tables.CORRUPTED), ("train_motion_free", tables.MOTION_FREE)):
        kinds = StructType.fromDDL(schema)
        row = tuple({"string": "001", "integer": 1, "double": 0.5}[f.dataType.typeName()] for f in kinds)
        tables.write_csv(spark.createDataFrame([row], kinds), str(tmp_path / f"{name}.csv"), one_file=True)
    got = tables.read_split(spark, str(tmp_path), "train").collect()
    assert sorted((r.domain, r.split, r.subject_id) for r in got) == [("A_corrupted", "train", "001"), ("B_motion_free", "train", "001")]


def test_mask_checks_shapes(spark, chunk):
    mask = np.zeros((4, 5, 3))
    mask[1] = 1
    assert np.array_equal(back(volumes.apply_mask(frame(spark, chunk), mask)), np.where(mask > 0.5, chunk, 0).astype(np.float32))
    with pytest.raises(Exception, match="shape_mismatch"):
        volumes.apply_mask(frame(spark, chunk), np.zeros((2, 2, 2))).collect()


def test_nifti_round_trip(spark, chunk, tmp_path):
    affine = np.array([[-2.0, 0, 0, 90], [0, 2, 0, -126], [0, 0, 2, -72], [0, 0, 0, 1]])
    data, got = nifti.parse(nifti.render(np.moveaxis(chunk, 0, -1), affine))
    assert np.array_equal(data, np.moveaxis(chunk, 0, -1)) and np.allclose(got, affine)
    name = "_subject_id_ICC1A/_run_001_session_1_task_name_videos/x.nii.gz"
    (tmp_path / name).parent.mkdir(parents=True)
    (tmp_path / name).write_bytes(nifti.render(np.moveaxis(chunk, 0, -1), affine))
    (tmp_path / "bad.nii.gz").write_bytes(b"no volume")
    v = nifti.read_volumes(spark, str(tmp_path))
    good = v.filter("load_error IS NULL")
    assert good.count() == 6 and v.filter("load_error IS NOT NULL").count() == 1
    rows = good.selectExpr("'c' AS chunk_id", "vol", "shape", "data")
    assert np.array_equal(back(rows), chunk)
    stepped = bytearray(nifti.header_of(nifti.render(np.moveaxis(chunk, 0, -1), affine)))
    struct.pack_into("<f", stepped, 92, 2.5)  # the time step
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "run.nii.gz").write_bytes(nifti.render(np.moveaxis(chunk, 0, -1), affine, header=bytes(stepped) + b"kept"))
    kept = nifti.read_volumes(spark, str(tmp_path / "h")).filter("vol BETWEEN 1 AND 3").selectExpr("'k' AS chunk_id", "vol", "shape", "data", "header")
    content = bytes(nifti.encode_chunks(kept).first().content)
    head = nifti.header_of(content)
    assert struct.unpack_from("<f", head, 92)[0] == 2.5 and head[-4:] == b"kept" and struct.unpack_from("<8h", head, 40)[4] == 3
    assert np.array_equal(nifti.parse(content)[0], np.moveaxis(chunk[1:4], 0, -1)) and np.allclose(nifti.parse(content)[1], affine)
    with pytest.raises(ValueError):
        nifti.encode_chunks(rows)
    out = tmp_path / "out"
    first = nifti.write_files(nifti.encode_chunks(rows, affine), str(out)).collect()
    assert [r.status for r in first] == ["ok"]
    assert [r.status for r in nifti.write_files(nifti.encode_chunks(rows, affine), str(out)).collect()] == ["skipped_exists"]
    assert np.array_equal(nifti.parse((out / "c.nii.gz").read_bytes())[0], np.moveaxis(chunk, 0, -1))
    files = listing.list_files(spark, str(tmp_path))
    r = listing.discover_runs(files).collect()
    assert [(x.subject, x.session, x.run, x.task, x.mask_used) for x in r] == [("ICC1A", "1", "001", "videos", "older")]
    assert listing.discover_runs(files, strict=False).first().session == "1_task_name_videos"
    with pytest.raises(FileNotFoundError):
        listing.list_files(spark, str(tmp_path), "*.none", required=True)


def test_mask_file_and_paths(spark, tmp_path):
    (tmp_path / "m.nii.gz").write_bytes(nifti.render(np.array([[[0.4, 0.6], [1.0, 0.5]]], np.float32), np.eye(4)))
    assert nifti.read_mask(spark, str(tmp_path / "m.nii.gz")).tolist() == [[[False, True], [True, False]]]
    assert tables.resolve_paths(None, "val", "a", "b") == ("a", "b")
    assert tables.resolve_paths("/r/", "val", "a", "b") == tuple(f"/r/analysis_output/{d}/val_chunk_level_metrics.csv" for d in ("corrupted", "motion_free"))
    with pytest.raises(ValueError):
        tables.resolve_paths(None, "val")


def test_model_seam(spark, chunk):
    def make():
        return lambda x: x * 0.5

    assert np.allclose(back(volumes.correct(frame(spark, chunk), make, (4, 5, 3))), chunk * 0.5)


def test_csv_schema_keeps_zeros_and_fails_on_bad_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text("subject_id,split\n001,train\n")
    assert tables.read_csv(spark, str(tmp_path / "a.csv"), tables.SUBJECT_SPLIT).first().subject_id == "001"
    with pytest.raises(ValueError, match="lacks"):
        tables.read_csv(spark, str(tmp_path / "a.csv"), tables.SUBJECT_SPLIT, ["subject_id", "run_id"])


def test_stream_of_windows(spark, sf_dir):
    from framewise.streaming.monitor import motion_windows

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    import os
    import shutil
    import tempfile

    folder = tempfile.mkdtemp()
    shutil.copy(f"{sf_dir}/events.parquet", os.path.join(folder, "a.parquet"))
    stream = spark.readStream.schema(schema).parquet(folder)
    q = motion_windows(stream, ["user_id"], "ts", "value", 50.0, "1 hour").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    batch = motion_windows(spark.read.parquet(f"{sf_dir}/events.parquet"), ["user_id"], "ts", "value", 50.0, "1 hour")
    assert sorted(spark.table("w").collect()) == sorted(batch.collect())


def test_manifest_stream(spark, tmp_path):
    from framewise.streaming.monitor import manifest_sink, read_manifest

    schema = "input_path string, status string"
    for k, rows in enumerate([[("p1", "processed")], [("p1", "skipped"), ("p2", "processed")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        manifest_sink(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(map(tuple, read_manifest(spark, str(tmp_path / "out"), schema).collect())) == [("p1", "skipped"), ("p2", "processed")]
    assert read_manifest(spark, str(tmp_path / "nothing"), schema).count() == 0
