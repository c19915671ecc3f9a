"""A training-corpus pipeline: STAGES one after another, each over all that the one before it kept.

Every stage but the last takes and returns the columns of ``documents``, whatever their names; the last
returns token ids. A stage's result is written to the shared folder as Parquet and read again as the next
one's documents.

Defined results in all stages: an empty table gives no rows; null texts and empty ones are kept by all stages
but the classifier, which scores them by its bias; rows with a null doc_id are kept unless the classifier or
the benchmark take them, and are changed by none; repeated rows stay until near duplicates leaves one of
each; texts are read whole, however long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm import decontamination, line_dedup, near_dedup, quality_classifier, sentence_pieces
from framewise.llm.common import fresh, materialize, named, scratch, semi_by_id


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from ``labels``. A text without words has the score of the bias."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = fresh(docs.columns, "_score", "_predicted")
    scored = quality_classifier.score_texts(docs, quality_classifier.fit(docs, labels), names=tuple(names))
    return scored.filter(F.col(names[1]) == 1).select(*map(named, docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of words go from the texts; so does a document all of whose words go. n_chars follows."""
    (count,) = fresh(docs.columns, "_deleted")
    has_word = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = line_dedup.dedup_lines(docs, count).filter((F.col(count) == 0) | has_word)
    changed = {"n_chars": F.when(F.col(count) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))}
    return out.withColumns(changed if "n_chars" in docs.columns else {}).select(*map(named, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id; and one row of each id and text.

    Different texts under one id all stay or go with it. Of rows equal in id and text, the one with the least hash of its columns stays.
    """
    kept = semi_by_id(docs, near_dedup.near_duplicates(docs).filter("NOT kept"), how="left_anti")
    again = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    columns = [*map(named, docs.columns)]
    least = F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("_row")
    once = semi_by_id(kept, again).groupBy("doc_id", "text").agg(least).select("_row.*")
    return semi_by_id(kept, again, how="left_anti").unionByName(once)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go; those with a null text have none."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.remove_contaminated(docs, items)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text; of a null text null, -1 and true."""
    out = sentence_pieces.encode(docs.select("doc_id", "text"), sentence_pieces.session_pieces(spark), check=True)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "lossless")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("sentence pieces", pieces),
]

#: The stages learn, hash and sample; SQL can't express them. They are tested against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has written for itself goes when it is done."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch() as keep:
        for name, stage in STAGES[:-1]:
            with scratch() as hold:
                docs = hold(materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-")))
        keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
