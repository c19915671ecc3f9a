"""A Spark data source of files of volumes: ``spark.read.format("volumes")`` and ``df.write.format("volumes")``.

Register it with ``register(spark)``. Reading deals a file's volumes to several tasks by ranges, of which each
decodes its own (see volume_files), and small files to a task by many; the options first and last, and with the option pushdown filters on vol and
path, leave out the others before anything is decoded. pushdown needs the session's
``spark.sql.python.filterPushdown.enabled``. Writing makes a file of each path: rows must come by path, and in
the order of volumes (``repartition("path").sortWithinPartitions("path", "vol")``). Tasks write to a folder of
the job and the driver moves the files when all tasks have ended, so that a failed or repeated task leaves none.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from framewise.sources.nifti import VOLUMES
from framewise.sources.volume_files import VolumeFile, as_stored, file_header, member, store_of

#: Bytes of volumes, as floats, of a task; ranges of several files that a task may have; headers that the driver reads at once.
TASK_BYTES, TASK_RANGES, PROBES = 64 << 20, 256, 16
_NAMES = [f.split()[0] for f in VOLUMES.split(", ")]
_KINDS = [pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32()), pa.list_(pa.float64()), pa.binary(), pa.string()]


def row(path: str, vol: int | None, shape, values, affine, header: bytes | None, error: str | None) -> pa.RecordBatch:
    """A row of VOLUMES; values are taken as they are."""
    data = pa.array([None], _KINDS[3]) if values is None else pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.float32()))
    cells = [[path], [vol], [shape], None, [affine], [header], [error]]
    return pa.RecordBatch.from_arrays([data if c is None else pa.array(c, k) for c, k in zip(cells, _KINDS, strict=True)], _NAMES)


@dataclass
class Range(InputPartition):
    path: str
    first: int
    last: int | None

    def __post_init__(self) -> None:
        super().__init__((self.path, self.first, self.last))


@dataclass
class Ranges(InputPartition):
    ranges: list[Range]

    def __post_init__(self) -> None:
        super().__init__(tuple(r.value for r in self.ranges))


def packed(sized: Iterable[tuple[Range, int]], most: int) -> list[InputPartition]:
    """Ranges with their bytes, in their order, to tasks of ``most`` bytes and TASK_RANGES ranges; a larger one is a task's by itself."""
    tasks, held = [], 0
    for r, size in sized:
        if not tasks or held + size > most or len(tasks[-1]) == TASK_RANGES:
            tasks.append([])
            held = 0
        tasks[-1].append(r)
        held += size
    return [t[0] if len(t) == 1 else Ranges(t) for t in tasks]


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.suffixes = tuple(options.get("suffixes", ".nii,.nii.gz").split(","))
        self.first, self.last = int(options.get("first", 0)), int(options["last"]) if "last" in options else None
        self.bytes = int(options.get("taskbytes", options.get("taskBytes", TASK_BYTES)))
        self.paths: set[str] | None = None

    def files(self) -> list[str]:
        """Files under the root, by name; those that begin with _ or . below it are left out."""
        from pyarrow import fs

        store, base = store_of(self.root)
        info = store.get_file_info(base)
        if info.type == fs.FileType.File:
            return [base]
        found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        inside = lambda p: not any(x[0] in "_." for x in posixpath.relpath(p, base).split("/"))
        return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffixes) and inside(f.path))

    def partitions(self) -> list[InputPartition]:
        """Tasks of about as many bytes: ranges of the volumes of large files, many small files.

        A header is read of each file, several at a time; of files of one foreign stream a task takes all.
        """
        store, _ = store_of(self.root)
        paths = [p for p in self.files() if self.paths is None or p in self.paths]
        with ThreadPoolExecutor(PROBES) as pool:
            tasks = packed((r for found in pool.map(lambda p: self._ranges(store, p), paths) for r in found), self.bytes)
        return tasks or [Ranges([])]

    def _ranges(self, store, path: str) -> list[tuple[Range, int]]:
        try:
            with VolumeFile(store, path) as f:
                end, size = f.layout.volumes, 4 * int(np.prod(f.layout.shape))
                each = end if f.packed and not f.own else max(1, self.bytes // (size or 1))
        except Exception:  # the task that reads it says what is wrong
            return [(Range(path, 0, None), self.bytes)]
        end, each = end if self.last is None else min(end, self.last + 1), max(each, 1)
        lasts = ((a, min(a + each, end) - 1) for a in range(max(self.first, 0), end, each))
        return [(Range(path, a, b), (b - a + 1) * size) for a, b in lasts]

    def read(self, part: Range | Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.root)
        for r in part.ranges if isinstance(part, Ranges) else [part]:
            try:
                with VolumeFile(store, r.path) as f:
                    for t, values in f.volumes(r.first, r.last):
                        yield row(r.path, t, f.layout.shape, values, f.layout.affine, f.header, None)
            except Exception as e:  # a file that can't be read, or not to its end, is a row that says so
                yield row(r.path, None, None, None, None, None, str(e)[:200] or type(e).__name__)


class PushingReader(VolumeReader):
    """Takes filters on vol and path. Rows of files that can't be read have no vol, so a filter on it leaves them out, as Spark's own would."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()) or ())
            if name == "vol" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                low = f.value + isinstance(f, GreaterThan) if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) else 0
                high = f.value - isinstance(f, LessThan) if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) else None
                self.first = max(self.first, low)
                self.last = self.last if high is None else high if self.last is None else min(self.last, high)
            elif name == "path" and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = own if self.paths is None else self.paths & own
            yield f  # Spark applies it once more


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)


class VolumeWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], names: list[str], overwrite: bool):
        self.root, self.names, self.overwrite = options["path"], names, overwrite
        self.level = int(options.get("level", 1))
        if missing := {"path", "vol", "shape", "data"} - set(names):
            raise ValueError(f"columns are missing: {sorted(missing)}")
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        """A file for each path. The header counts the volumes, so members are kept until the path ends."""
        store, base = store_of(self.root)
        folder, out = f"{base}/{self.job}", Written()
        store.create_dir(folder, recursive=True)
        now, members, head = None, [], None

        def close() -> None:
            if now is None:
                return
            header, shape, affine = head
            part = f"{folder}/{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                f.write(member(file_header(shape, len(members), affine, header), 0, self.level))
                for m in members:
                    f.write(m)
            out.files.append((part, f"{base}/{now}"))

        for r in rows:
            path = r["path"].rpartition("/")[2]
            path = path if path.endswith(".nii.gz") else path + ".nii.gz"
            if path != now:
                close()
                shape = tuple(int(x) for x in r["shape"])
                header = bytes(r["header"]) if "header" in self.names and r["header"] is not None else None
                affine = np.array(r["affine"]).reshape(4, 4) if "affine" in self.names and r["affine"] is not None else None
                now, members, head, seen = path, [], (header, shape, affine), -1
                stored = file_header(shape, 1, affine, header)
            if r["vol"] <= seen:
                raise ValueError(f"{path}: volumes are not in order, or rows of a path are not together")
            seen = r["vol"]
            members.append(member(as_stored(r["data"], head[1], stored), 1, self.level))
        close()
        return out

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, base = store_of(self.root)
        files = [f for m in messages if m is not None for f in m.files]
        if len({to for _, to in files}) < len(files):
            self.abort(messages)
            raise ValueError("rows of one path came to several tasks")
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if info.type == fs.FileType.File:
                    store.delete_file(info.path)
        for part, to in files:
            store.move(part, to)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, base = store_of(self.root)
        if store.get_file_info(f"{base}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/{self.job}")


class VolumeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volumes"

    def schema(self) -> str:
        return VOLUMES

    def reader(self, schema) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown", "").lower() == "true" else VolumeReader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return VolumeWriter(dict(self.options), schema.fieldNames(), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VolumeSource)
