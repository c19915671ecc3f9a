"""Files of volumes by volume: reader, data source, and extraction in one pass."""

import gzip
import os
import tracemalloc

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from framewise.operators.extraction import bad_slice, extract_files, segments
from framewise.operators.storage import stored
from framewise.sources import nifti, volume_source
from framewise.sources.volume_files import VolumeFile, layout, member, member_size

LOCAL = fs.LocalFileSystem()


def data_of(volumes, shape=(5, 4, 3), seed=0):
    return np.random.default_rng(seed).normal(100, 20, (*shape, volumes)).astype(np.float32)


AFFINE = np.array([[2, 0, 0, 1], [0, 2.5, 0, 2], [0, 0, 3, 3], [0, 0, 0, 1.0]])


@pytest.fixture
def source(spark):
    volume_source.register(spark)
    return spark


def write(folder, name, data, kind="stream"):
    path = str(folder / name)
    raw = nifti.render(data, AFFINE)
    if kind == "plain":
        raw = gzip.decompress(raw)
    elif kind == "members":  # of an ordinary compressor, cut anywhere
        plain = gzip.decompress(raw)
        raw = b"".join(gzip.compress(plain[k : k + 1000]) for k in range(0, len(plain), 1000))
    with open(path, "wb") as f:
        f.write(raw)
    return path


@pytest.mark.parametrize("kind", ["stream", "plain", "members"])
def test_ranges_of_any_file(tmp_path, kind):
    data = data_of(11)
    path = write(tmp_path, "a.nii" + ("" if kind == "plain" else ".gz"), data, kind)
    for first, last in ((0, None), (3, 7), (10, 10), (-5, 99), (11, 12), (6, 5)):
        with VolumeFile(LOCAL, path) as f:
            got = list(f.volumes(first, last))
            assert f.layout.volumes == 11 and f.layout.axes == 4 and np.allclose(f.layout.affine, AFFINE.ravel())
        want = range(max(first, 0), 11 if last is None else min(last + 1, 11))
        assert [t for t, _ in got] == list(want)
        assert all((x == data[..., t].ravel()).all() for t, x in got)


def test_scaled_and_short_files(tmp_path):
    raw = bytearray(gzip.decompress(nifti.render(data_of(3), AFFINE)))
    import struct

    struct.pack_into("<2f", raw, 112, 2.0, -1.0)
    path = tmp_path / "s.nii"
    path.write_bytes(raw)
    with VolumeFile(LOCAL, str(path)) as f:
        assert np.allclose(dict(f.volumes())[1], nifti.parse(bytes(raw))[0][..., 1].ravel())
    for name, content in (("cut.nii", raw[:-9]), ("head.nii", raw[:100]), ("cut.nii.gz", gzip.compress(bytes(raw))[:-40]), ("none.nii", b""), ("text.nii", b"x" * 500)):
        (tmp_path / name).write_bytes(content)
        with pytest.raises((ValueError, EOFError, OSError)), VolumeFile(LOCAL, str(tmp_path / name)) as f:
            list(f.volumes())
    with pytest.raises(ValueError):
        layout(b"x" * 400)


def test_members_say_their_length():
    m = member(b"abc" * 50, 2)
    assert gzip.decompress(m + m) == b"abc" * 100 and member_size(m) == (len(m), 2) and member_size(gzip.compress(b"x" * 90)) is None


def chunk_rows(spark, names, volumes, shape=(5, 4, 3)):
    rows = [(n, t, list(shape), data_of(volumes, shape, k)[..., t].ravel().tolist(), AFFINE.ravel().tolist()) for k, n in enumerate(names) for t in range(volumes)]
    return spark.createDataFrame(rows, "path string, vol int, shape array<int>, data array<float>, affine array<double>")


def save(df, folder, mode="append"):
    df.repartition("path").sortWithinPartitions("path", "vol").write.format("volumes").mode(mode).save(str(folder))


def test_written_files_are_read_by_all_readers(source, tmp_path):
    save(chunk_rows(source, ["a", "b", "c"], 9), tmp_path / "out")
    files = sorted(os.listdir(tmp_path / "out"))
    assert files == ["a.nii.gz", "b.nii.gz", "c.nii.gz"]
    for k, name in enumerate(files):
        data, affine = nifti.parse((tmp_path / "out" / name).read_bytes())
        assert (data == data_of(9, seed=k)).all() and np.allclose(affine, AFFINE)
    old = {(r.path.rpartition("/")[2], r.vol): list(r.data) for r in nifti.read_volumes(source, str(tmp_path / "out")).collect()}
    new = source.read.format("volumes").option("taskbytes", 4 * 60 * 2).load(str(tmp_path / "out"))
    assert new.rdd.getNumPartitions() == 15
    assert {(r.path.rpartition("/")[2], r.vol): list(r.data) for r in new.collect()} == old and len(old) == 27
    again = new.select("path", "vol", "shape", "data", "affine", "header")
    save(again, tmp_path / "second")
    assert (tmp_path / "second" / "b.nii.gz").read_bytes() == (tmp_path / "out" / "b.nii.gz").read_bytes()
    save(chunk_rows(source, ["d"], 2), tmp_path / "out", "overwrite")
    assert os.listdir(tmp_path / "out") == ["d.nii.gz"]


def test_pushed_ranges_decode_their_volumes_only(source, tmp_path):
    save(chunk_rows(source, ["a", "b"], 12), tmp_path / "out")
    path = str(tmp_path / "out" / "b.nii.gz")
    with VolumeFile(LOCAL, path) as f:
        assert [t for t, _ in f.volumes(4, 6)] == [4, 5, 6] and f.inflated == 3
    reader = volume_source.PushingReader({"path": str(tmp_path / "out"), "taskbytes": str(4 * 60 * 2)})
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    filters = [GreaterThan(("vol",), 3), LessThanOrEqual(("vol",), 8), EqualTo(("path",), path)]
    assert list(reader.pushFilters(filters)) == filters
    assert [(p.path, p.first, p.last) for p in reader.partitions()] == [(path, 4, 5), (path, 6, 7), (path, 8, 8)]
    name = "spark.sql.python.filterPushdown.enabled"
    source.conf.set(name, "true")
    try:
        df = source.read.format("volumes").option("pushdown", "true").load(str(tmp_path / "out")).filter((F.col("vol") > 3) & (F.col("vol") <= 8))
        assert sorted((r.path[-8], r.vol) for r in df.select("path", "vol").collect()) == [(x, t) for x in "ab" for t in range(4, 9)]
    finally:
        source.conf.unset(name)


def test_a_long_run_takes_few_volumes_of_memory(source, tmp_path):
    shape, volumes = (40, 40, 20), 300
    size = 4 * int(np.prod(shape))
    path = write(tmp_path, "long.nii.gz", np.broadcast_to(np.float32(7), (*shape, volumes)))
    tracemalloc.start()
    reader = volume_source.VolumeReader({"path": path})
    n = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert n == volumes and peak < 12 * size + 8 * (1 << 20)
    rows = nifti_rows(path, shape, volumes)
    writer = volume_source.VolumeWriter({"path": str(tmp_path / "own")}, ["path", "vol", "shape", "data"], False)
    writer.commit([writer.write(rows)])
    own = volume_source.VolumeReader({"path": str(tmp_path / "own"), "taskbytes": str(size * volumes // 8 + size)})
    parts = own.partitions()
    assert len(parts) == 8 and sum(b.num_rows for p in parts for b in own.read(p)) == volumes


def nifti_rows(path, shape, volumes):
    for t in range(volumes):
        yield {"path": "long", "vol": t, "shape": list(shape), "data": np.full(int(np.prod(shape)), t, np.float32)}


def test_failed_jobs_leave_no_file(source, tmp_path):
    rows = chunk_rows(source, ["a", "b"], 4)
    bad = rows.withColumn("data", F.when((F.col("path") == "b") & (F.col("vol") == 2), F.array(F.lit(1.0).cast("float"))).otherwise(F.col("data")))
    with pytest.raises(Exception):
        save(bad, tmp_path / "out")
    assert not (tmp_path / "out").exists() or os.listdir(tmp_path / "out") == []
    with pytest.raises(Exception):  # one path in two tasks
        rows.orderBy("vol").repartitionByRange(2, "vol").sortWithinPartitions("path", "vol").write.format("volumes").mode("append").save(str(tmp_path / "split"))
    assert os.listdir(tmp_path / "split") == []
    with pytest.raises(Exception):
        rows.drop("shape").write.format("volumes").mode("append").save(str(tmp_path / "none"))


def test_unreadable_and_empty_folders(source, tmp_path):
    write(tmp_path, "good.nii.gz", data_of(2))
    (tmp_path / "bad.nii.gz").write_bytes(b"\x1f\x8bnothing")
    (tmp_path / "_hidden.nii").write_bytes(b"x")
    rows = source.read.format("volumes").load(str(tmp_path)).collect()
    assert sorted((r.path.rpartition("/")[2], r.vol, r.load_error is None) for r in rows if r.vol is not None) == [("good.nii.gz", 0, True), ("good.nii.gz", 1, True)]
    assert [r.path.rpartition("/")[2] for r in rows if r.load_error] == ["bad.nii.gz"]
    assert source.read.format("volumes").load(str(tmp_path / "nowhere")).count() == 0


def test_segments(spark):
    rows = [("f", "a", 0, 4), ("f", "b", 3, 6), ("f", "c", 7, 8), ("f", "d", 12, 13), ("f", "x", 20, 2), ("f", "e", 14, 90), ("g", "y", -3, 1), ("g", "z", 5, 6)]
    got = segments(spark.createDataFrame(rows, "path string, chunk_id string, chunk_start int, chunk_end int")).collect()
    assert sorted((r.path, r.segment, [c.chunk_id for c in r.chunks]) for r in got) == [("f", 0, ["a", "b", "c"]), ("f", 1, ["d", "e", "x"]), ("g", 0, ["y", "z"])]
    assert bad_slice(0, 4, 5) == "" and bad_slice(0, 5, 5) == "error: invalid slice [0, 5] of 5 volumes"


def test_extraction_in_one_pass(source, tmp_path):
    data = data_of(20)
    one, flat = write(tmp_path, "run.nii.gz", data), str(tmp_path / "flat.nii.gz")
    with open(flat, "wb") as f:
        f.write(nifti.render(data[..., 0], AFFINE))
    (tmp_path / "bad.nii.gz").write_bytes(b"nothing")
    chunks = [(one, f"r{a}.nii.gz", a, a + 5) for a in (0, 1, 2, 10, 11, 17)] + [(flat, "f.nii.gz", 0, 1), (str(tmp_path / "bad.nii.gz"), "b.nii.gz", 0, 1), (str(tmp_path / "gone.nii.gz"), "g.nii.gz", 0, 1)]
    df = source.createDataFrame(chunks, "path string, chunk_id string, chunk_start int, chunk_end int")
    existing = source.createDataFrame([("r2.nii.gz",)], "name string")
    log = {r.chunk_id: r for r in stored(extract_files(df, str(tmp_path / "out"), existing), "test-log").collect()}
    assert {k: r.status for k, r in log.items()} == {"r0.nii.gz": "ok", "r1.nii.gz": "ok", "r2.nii.gz": "skipped_exists", "r10.nii.gz": "ok", "r11.nii.gz": "ok", "r17.nii.gz": "error", "f.nii.gz": "error", "b.nii.gz": "error", "g.nii.gz": "error"}
    assert log["r17.nii.gz"].message == "error: invalid slice [17, 22] of 20 volumes" and log["f.nii.gz"].message == "Not 4D: 3 axes" and log["b.nii.gz"].message.startswith("Load failed: ")
    assert log["r0.nii.gz"].segment == 0 and log["r10.nii.gz"].segment == 1 and log["r17.nii.gz"].output_path == ""
    assert sorted(os.listdir(tmp_path / "out")) == ["r0.nii.gz", "r1.nii.gz", "r10.nii.gz", "r11.nii.gz"]
    for a in (0, 1, 10, 11):
        got, affine = nifti.parse((tmp_path / "out" / f"r{a}.nii.gz").read_bytes())
        assert (got == data[..., a : a + 6]).all() and np.allclose(affine, AFFINE)
    assert log["r0.nii.gz"].decoded == 7  # volumes 0 to 6, each once
