"""Strings and paths: entity parsing, zero padding, templates and formatted numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of the run keys, in the order subject, session, task, run.
ENTITY_PATTERNS = {
    "subject_id": r"sub-([A-Za-z0-9]+)",
    "session_id": r"ses-([A-Za-z0-9]+)",
    "task": r"task-([A-Za-z0-9]+)",
    "run_id": r"run-([A-Za-z0-9]+)",
}
# Fixed patterns of the directory names of preprocessed runs; strict stops a session at its own value.
DIRECTORY_PATTERNS = {
    "subject": r"_subject_id_([^/_]+)",
    "run": r"_run_(\w+)_session",
    "session": r"session_(\w+)",
    "task": r"task_name_(\w+)",
}
STRICT_SESSION = r"session_([A-Za-z0-9]+)"


def entity(key: Column | str, pattern: str, default: str = "unknown") -> Column:
    """The pattern's first group, or ``default`` where it doesn't match (or the key is null)."""
    return F.coalesce(F.nullif(F.regexp_extract(key, pattern, 1), F.lit("")), F.lit(default))


def entities(key: Column | str) -> list[Column]:
    """subject_id, session_id, task and run_id of a run key; ``unknown`` for each that is missing."""
    return [entity(key, pattern).alias(name) for name, pattern in ENTITY_PATTERNS.items()]


def zfill(value: Column | str, width: int) -> Column:
    """Zeros on the left up to ``width``; longer strings stay whole, unlike with lpad."""
    c = F.col(value) if isinstance(value, str) else value
    c = c.cast("string")
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def chunk_name(subject: Column, session: Column, task: Column, run: Column, start: Column, end: Column) -> Column:
    """File name of an extracted chunk."""
    return F.format_string(
        "sub-%s_ses-%s_task-%s_run-%s_chunk-%d-%d.nii.gz", subject, session, task, zfill(run, 3), start.cast("long"), end.cast("long")
    )


def preprocessed_path(root: str, subject: Column, session: Column, task: Column, run: Column) -> Column:
    """Path of a run's preprocessed volume under ``root``, by the directory convention."""
    padded = zfill(run, 3)
    folder = F.format_string("_run_%s_session_%s_task_name_%s", padded, session, task)
    file = F.format_string("sub-%s_ses-%s_task-%s_dir-AP_run-%s_bold_mcf_corrected_flirt_masked.nii.gz", subject, session, task, padded)
    return F.concat_ws("/", F.lit(root.rstrip("/")), F.concat(F.lit("_subject_id_"), subject), F.lit("_referencetype_standard"), folder, file)


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column | str) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def stem(path: Column | str) -> Column:
    """Base name without ``.nii`` or ``.nii.gz``."""
    return F.regexp_replace(basename(path), r"\.nii(\.gz)?$", "")


def masked_name(path: Column | str) -> Column:
    """Where the masked version of a volume goes."""
    return F.regexp_replace(path, r"\.nii\.gz$", "_masked.nii.gz")


def is_wanted_task(task: Column | str) -> Column:
    """Tasks of videos and of rest."""
    return F.lower(task).rlike("videos|rest")


def mask_kind(subject: Column | str) -> Column:
    """Older subjects' ids end with A."""
    return F.when(F.endswith(F.col(subject) if isinstance(subject, str) else subject, F.lit("A")), "older").otherwise("younger")


def shape_text(values: Column | str) -> Column:
    """``(97, 116, 79, 20)``."""
    c = F.col(values) if isinstance(values, str) else values
    return F.concat(F.lit("("), F.array_join(c.cast("array<string>"), ", "), F.lit(")"))


def list_text(values: Column | str) -> Column:
    """``[2.0, 2.0, 2.0]``; null for null."""
    c = F.col(values) if isinstance(values, str) else values
    return F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]"))


def range_label(lo: Column, hi: Column) -> Column:
    """``0.00–1.00``, with an en dash."""
    return F.format_string("%.2f–%.2f", lo, hi)


def p_text(p: Column, digits: int = 3) -> Column:
    """``p<0.001`` or ``p=0.012``."""
    return F.when(p < 0.001, "p<0.001").otherwise(F.format_string(f"p=%.{digits}f", p))


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def flags(*problems: Column) -> Column:
    """Problems joined by bars; null problems are left out."""
    return F.concat_ws("|", *problems)
