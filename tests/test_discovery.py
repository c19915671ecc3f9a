"""Files are discovered once, over several calls."""

from framewise.streaming.discovery import listed_runs, new_runs


def add(root, subject, session, run, task="videos", name="x.nii.gz"):
    folder = root / f"_subject_id_{subject}" / "_referencetype_standard" / f"_run_{run}_session_{session}_task_name_{task}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(b"not read")


def test_second_call_lists_what_is_new(spark, tmp_path):
    root, state = tmp_path / "in", str(tmp_path / "state")
    pattern = str(root / "*/*/*/*.nii.gz")
    add(root, "ICC1", "1", "001")
    add(root, "ICC2A", "2", "002", "rest10")
    add(root, "ICC2A", "2", "002", "other")  # not a wanted task
    first = new_runs(spark, pattern, state).collect()
    assert sorted((r.subject, r.run, r.mask_used) for r in first) == [("ICC1", "001", "younger"), ("ICC2A", "002", "older")]
    assert new_runs(spark, pattern, state).count() == 0
    add(root, "ICC3", "1", "003")
    add(root, "ICC1", "1", "001", name="y.nii.gz")
    second = new_runs(spark, pattern, state, files_each=1).collect()
    assert sorted((r.subject, r.input_path.rpartition("/")[2]) for r in second) == [("ICC1", "y.nii.gz"), ("ICC3", "x.nii.gz")]
    assert listed_runs(spark, state).count() == 4 and len({r.batch for r in second}) == 2
