"""CSV tables with explicit schemas, and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.operators.dataset import require_columns

# Fixed schemas of the tables that are exchanged as CSV.
MAPPING = "bids_key string, video_bold_file string, motion_parameter_file string"
_CHUNK = "subject_id string, session_id string, run_id string, task string, bold_file string, motion_parameter_file string, "
_CHUNK += "chunk_start int, chunk_end int, chunk_mean_fd double, chunk_max_fd double, "
CORRUPTED = _CHUNK + "n_vols_above_thr int, frac_vols_above_thr double, max_sustained_streak int, n_total_vols_in_run int"
MOTION_FREE = _CHUNK + "n_safe_vols_in_run int, n_total_vols_in_run int"
SUBJECT_SPLIT = "subject_id string, split string"
EXTRACTION_LOG = (
    "split string, domain string, subject_id string, session_id string, run_id string, task string, chunk_start int, "
    "chunk_end int, output_path string, status string, message string, timestamp string"
)
MANIFEST = (
    "subject string, session string, run string, task string, mask_used string, input_path string, output_path string, "
    "status string, n_volumes int, n_brain_voxels long, processed_at string"
)
#: What the data-set builder needs of a chunk table.
BUILDER_COLUMNS = ["subject_id", "session_id", "run_id", "task", "preprocessed_bold_file", "chunk_start", "chunk_end"]


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str] | None = None) -> DataFrame:
    """A headed CSV. The header is checked by name; a value that doesn't fit its type fails the read."""
    from pyspark.sql.types import StructType

    head = spark.read.option("header", True).csv(path).columns
    kinds = {f.name: f.dataType for f in StructType.fromDDL(schema).fields}
    full = ", ".join(f"`{c}` {kinds[c].simpleString() if c in kinds else 'string'}" for c in head)
    df = spark.read.schema(full).option("header", True).option("mode", "FAILFAST").csv(path)
    return require_columns(df, required if required is not None else [c for c in kinds if c in head], path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Overwrites; one_file is for small reports only."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_by_domain(df: DataFrame, path: str) -> None:
    """Parquet, in folders by split and domain."""
    df.write.mode("overwrite").partitionBy("split", "domain").parquet(path)


def write_reports(reports: dict[str, DataFrame], folder: str, split: str, domain: str) -> None:
    """A domain's reports as CSV, each a folder ``{split}_{name}.csv`` under the domain's; what isn't flat is written as JSON."""
    for name, df in reports.items():
        flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("map", "array", "struct") else F.col(f.name) for f in df.schema]
        write_csv(df.select(*flat), f"{folder.rstrip('/')}/{domain}/{split}_{name}.csv", name != "chunk_level_metrics")


def append_log(df: DataFrame, path: str, columns: list[str]) -> None:
    """Appends rows with the given columns; what a row lacks is empty."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]
    df.select(*cols).write.mode("append").option("header", True).csv(path)


def read_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Both domains' metadata of a split: all corrupted chunks for train, the balanced ones otherwise."""
    kind = "all" if split == "train" else "balanced"
    a = read_csv(spark, f"{folder}/{split}_corrupted_{kind}.csv", CORRUPTED).withColumn("domain", F.lit("A_corrupted"))
    b = read_csv(spark, f"{folder}/{split}_motion_free.csv", MOTION_FREE).withColumn("domain", F.lit("B_motion_free"))
    return a.unionByName(b, allowMissingColumns=True).withColumn("split", F.lit(split))


def resolve_paths(qc_dir: str | None, split: str, corrupted: str | None = None, motion_free: str | None = None) -> tuple[str, str]:
    """The two domains' metric tables: those of the folder with the reports, or else both given."""
    if qc_dir:
        base = f"{qc_dir.rstrip('/')}/analysis_output"
        return f"{base}/corrupted/{split}_chunk_level_metrics.csv", f"{base}/motion_free/{split}_chunk_level_metrics.csv"
    if corrupted and motion_free:
        return corrupted, motion_free
    raise ValueError("give the folder with the reports, or both tables")
