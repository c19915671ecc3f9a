"""Chunks of runs as files, in one pass over each run: a volume is decoded and compressed once, however many chunks hold it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewise.sources.volume_files import VolumeFile, as_stored, file_header, member, store_of

LOG = "path string, chunk_id string, chunk_start int, chunk_end int, n_vols int, output_path string, status string, message string, segment int, decoded int"


def segments(chunks: DataFrame) -> DataFrame:
    """(path, segment, chunks): a file's chunks by unbroken stretches of volumes; bounds that overlap or touch are one stretch.

    chunks: path, chunk_id, chunk_start, chunk_end (inclusive) and, if there is one, exists. Bounds that can't
    be are with the stretch where they would begin and don't widen it.
    """
    exists = F.col("exists") if "exists" in chunks.columns else F.lit(False)
    rows = chunks.select("path", "chunk_id", F.col("chunk_start").cast("int").alias("a"), F.col("chunk_end").cast("int").alias("b"), exists.alias("exists"))
    order = Window.partitionBy("path").orderBy("a", "b", "chunk_id")
    reached = F.max(F.when((F.col("a") >= 0) & (F.col("b") >= F.col("a")), F.col("b"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = rows.withColumn("_new", (F.col("a") > reached + 1).cast("int"))
    numbered = begins.withColumn("segment", F.coalesce(F.sum("_new").over(order), F.lit(0)).cast("int"))
    return numbered.groupBy("path", "segment").agg(F.array_sort(F.collect_list(F.struct("a", "b", "chunk_id", "exists"))).alias("chunks"))


def extract_files(chunks: DataFrame, folder: str, existing: DataFrame | None = None, level: int = 1) -> DataFrame:
    """Writes each chunk to ``folder``/chunk_id and returns LOG: ok, skipped_exists or error with its message.

    existing: the names of files that are there; these aren't written again. A stretch of a file is a task's: its
    volumes are read once, in order, and each is compressed once and appended to all chunks that hold it. decoded
    counts the volumes that the stretch's task has decoded. A chunk's file appears when it is whole; the log is
    to be written, since reading it again would extract again. Stretches go to many tasks, one by one.
    """
    if existing is not None:
        there = existing.select(F.col("name").alias("chunk_id"), F.lit(True).alias("exists")).distinct()
        chunks = chunks.drop("exists").join(there, "chunk_id", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        store.create_dir(base, recursive=True)
        for batch in it:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(_extracted(r, store, base, folder.rstrip("/"), level), schema=_SCHEMA)

    return segments(chunks).repartition(parts, "path", "segment").mapInArrow(run, LOG)


_SCHEMA = pa.schema([(name, pa.string() if kind == "string" else pa.int32()) for name, kind in (f.split() for f in LOG.split(", "))])


def bad_slice(a: int, b: int, volumes: int) -> str:
    """What slice_status() says of such bounds; empty if they are right."""
    return f"error: invalid slice [{a}, {b}] of {volumes} volumes" if a < 0 or b >= volumes or a > b else ""


def _extracted(r: dict, store, base: str, folder: str, level: int) -> list[dict]:
    out = {}

    def log(c: dict, volumes: int | None, message: str = "", status: str | None = None) -> None:
        status = status or ("error" if message else "ok")
        where = "" if status == "error" else f"{folder}/{c['chunk_id']}"
        out[c["a"], c["b"], c["chunk_id"]] = {"path": r["path"], "chunk_id": c["chunk_id"], "chunk_start": c["a"], "chunk_end": c["b"], "n_vols": volumes, "output_path": where, "status": status, "message": message[:200], "segment": r["segment"]}

    decoded, writing = 0, {}
    try:
        own_store, own_path = store_of(r["path"])
        with VolumeFile(own_store, own_path) as f:
            n, todo = f.layout.volumes, []
            for c in r["chunks"]:
                if f.layout.axes != 4:
                    log(c, None, f"Not 4D: {f.layout.axes} axes")
                elif c["exists"]:
                    log(c, n, status="skipped_exists")
                elif message := bad_slice(c["a"], c["b"], n):
                    log(c, n, message)
                else:
                    todo.append(c)
            waiting = todo[::-1]  # by their first volumes, the next one last
            if todo:
                for t, values in f.volumes(todo[0]["a"], max(c["b"] for c in todo)):
                    while waiting and waiting[-1]["a"] <= t:
                        c = waiting.pop()
                        part = f"{base}/_{uuid.uuid4().hex}"
                        stream = store.open_output_stream(part)
                        stream.write(member(file_header(f.layout.shape, c["b"] - c["a"] + 1, header=f.header), 0, level))
                        writing[len(waiting)] = (c, part, stream)
                    if writing:
                        packed = member(as_stored(values, f.layout.shape, file_header(f.layout.shape, 1, header=f.header)), 1, level)
                    for k, (c, part, stream) in list(writing.items()):
                        stream.write(packed)
                        if c["b"] == t:
                            stream.close()
                            store.move(part, f"{base}/{c['chunk_id']}")
                            del writing[k]
                            log(c, n)
            decoded = f.inflated
    except Exception as e:  # chunks that were whole before stay
        for c in r["chunks"]:
            if (c["a"], c["b"], c["chunk_id"]) not in out:
                log(c, None, f"Load failed: {e}")
        for _, part, stream in writing.values():
            stream.close()
            store.delete_file(part)
    return [x | {"decoded": decoded} for x in out.values()]

