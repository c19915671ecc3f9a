"""NIfTI-1 volumes: a reader to one row for each volume, and a writer.

Single-file images (.nii, .nii.gz) of at most four axes. Data come as float32, scaled by slope and
intercept, x fastest in the file and C order (x, y, z) in rows.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from framewise.sources.listing import binary_files

# Fixed values of the format: header length, magic, voxel offset and type codes.
HEADER, MAGIC, OFFSET = 348, b"n+1\0", 352
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}

VOLUMES = "path string, vol int, shape array<int>, data array<float>, affine array<double>, header binary, load_error string"


def header_of(raw: bytes) -> bytes:
    """A file's header, with what extends it."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    order = "<" if struct.unpack_from("<i", raw)[0] == HEADER else ">"
    return raw[: max(OFFSET, int(struct.unpack_from(order + "f", raw, 108)[0]))]


def parse(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(array (x, y, z[, t]) of float32, affine 4 x 4) of a file's bytes; ValueError if it is not such a file."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    if len(raw) < OFFSET:
        raise ValueError("shorter than a header")
    order = "<" if struct.unpack_from("<i", raw)[0] == HEADER else ">"
    if struct.unpack_from(order + "i", raw)[0] != HEADER:
        raise ValueError("no NIfTI-1 header")
    dim = struct.unpack_from(order + "8h", raw, 40)
    code = struct.unpack_from(order + "h", raw, 70)[0]
    if code not in TYPES or not 3 <= dim[0] <= 4:
        raise ValueError(f"type {code} with {dim[0]} axes is not read")
    shape, pix = dim[1 : 1 + dim[0]], struct.unpack_from(order + "8f", raw, 76)
    start, slope, inter = (struct.unpack_from(order + "f", raw, k)[0] for k in (108, 112, 116))
    count = int(np.prod(shape))
    data = np.frombuffer(raw, np.dtype(order + TYPES[code]), count, int(start)).reshape(shape, order="F").astype(np.float32)
    if slope not in (0.0, 1.0) or inter:
        data = data * np.float32(slope or 1.0) + np.float32(inter)
    if struct.unpack_from(order + "h", raw, 254)[0] > 0:
        affine = np.array(struct.unpack_from(order + "12f", raw, 280), float).reshape(3, 4)
    else:
        affine = np.hstack([np.diag(pix[1:4]), np.zeros((3, 1))])
    return data, np.vstack([affine, [0, 0, 0, 1]])


def render(data: np.ndarray, affine: np.ndarray, level: int = 1, header: bytes | None = None) -> bytes:
    """A gzip-compressed float32 file of (x, y, z[, t]).

    With the ``header`` of another file, all of it stays (time step, units, orientation, descriptions and
    extensions) but the number of volumes, the type and the scaling; else the affine makes a new one.
    """
    if header is not None:
        head = bytearray(header)
        order = "<" if struct.unpack_from("<i", head)[0] == HEADER else ">"
        struct.pack_into(order + "8h", head, 40, data.ndim, *data.shape, *([1] * (7 - data.ndim)))
        struct.pack_into(order + "2h", head, 70, 16, 32)
        struct.pack_into(order + "3f", head, 108, len(head), 1.0, 0.0)
        return gzip.compress(bytes(head) + data.astype(order + "f4").tobytes(order="F"), level)
    head = bytearray(OFFSET)
    struct.pack_into("<i", head, 0, HEADER)
    struct.pack_into("<8h", head, 40, data.ndim, *data.shape, *([1] * (7 - data.ndim)))
    struct.pack_into("<2h", head, 70, 16, 32)
    size = np.sqrt((np.asarray(affine)[:3, :3] ** 2).sum(axis=0))
    struct.pack_into("<8f", head, 76, 1.0, *size, 1.0, 1.0, 1.0, 1.0)
    struct.pack_into("<3f", head, 108, OFFSET, 1.0, 0.0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *np.asarray(affine, float)[:3].ravel())
    head[344:348] = MAGIC
    return gzip.compress(bytes(head) + data.astype("<f4").tobytes(order="F"), level)


def read_volumes(spark: SparkSession, path: str, glob: str = "*.nii*") -> DataFrame:
    """One row for each volume; a file that can't be read gives one row with ``load_error``.

    Files are unsplittable and taken one by one; Spark hands a task as many as fit into
    ``spark.sql.execution.arrow.maxBytesPerBatch``, one at least.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for where, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    content = bytes(content)
                    data, affine = parse(content)
                    header = header_of(content)
                except (ValueError, OSError, EOFError, struct.error) as e:
                    yield pd.DataFrame([{"path": where, "vol": None, "shape": None, "data": None, "affine": None, "header": None, "load_error": str(e)[:200]}])
                    continue
                data = data[..., None] if data.ndim == 3 else data
                for t in range(data.shape[3]):
                    row = {"path": where, "vol": t, "shape": list(data.shape[:3]), "data": data[..., t].ravel(), "affine": affine.ravel(), "header": header, "load_error": None}
                    yield pd.DataFrame([row])

    return binary_files(spark, path, glob).select("path", "content").mapInPandas(run, VOLUMES)


def read_mask(spark: SparkSession, path: str) -> np.ndarray:
    """One mask file as booleans: values above 0.5."""
    row = spark.read.format("binaryFile").load(path).select("content").first()
    if row is None:
        raise FileNotFoundError(path)
    data, _ = parse(bytes(row["content"]))
    return data > 0.5


def encode_chunks(volumes: DataFrame, affine: np.ndarray | None = None) -> DataFrame:
    """(chunk_id, n_vols, content): each chunk as the bytes of a file, ready for a binary sink or an object store.

    Where ``volumes`` has headers, as read_volumes() gives them, the chunk's file keeps its run's header; else
    the affine is needed. A chunk is a file, so its volumes, some tens, meet in one task.
    """
    more = [c for c in ("header",) if c in volumes.columns]
    if not more and affine is None:
        raise ValueError("give an affine for volumes without headers")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vol")
        shape = [int(s) for s in pdf["shape"].iloc[0]]
        data = np.stack([np.asarray(d, np.float32).reshape(shape) for d in pdf["data"]], axis=-1)
        header = bytes(pdf["header"].iloc[0]) if more and pdf["header"].iloc[0] is not None else None
        content = render(data, np.eye(4) if affine is None else affine, header=header)
        return pd.DataFrame([{"chunk_id": pdf["chunk_id"].iloc[0], "n_vols": len(pdf), "content": content}])

    return volumes.select("chunk_id", "vol", "shape", "data", *more).groupBy("chunk_id").applyInPandas(run, "chunk_id string, n_vols int, content binary")


def write_files(encoded: DataFrame, folder: str) -> DataFrame:
    """Write each content to ``folder``/chunk_id, a path or the URI of a store; (chunk_id, output_path, status, message).

    Status is ok, skipped_exists or error. A file is written under another name and then moved, so a task that
    runs again does no harm.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for pdf in it:
            out = []
            for name, content in zip(pdf["chunk_id"], pdf["content"], strict=True):
                name = name if name.endswith(".nii.gz") else name + ".nii.gz"
                to, shown = f"{base.rstrip('/')}/{name}", f"{folder.rstrip('/')}/{name}"
                try:
                    if store.get_file_info(to).type != fs.FileType.NotFound:
                        out.append((name, shown, "skipped_exists", ""))
                        continue
                    part = f"{to}.{uuid.uuid4().hex}.part"
                    with store.open_output_stream(part) as f:
                        f.write(bytes(content))
                    store.move(part, to)
                    out.append((name, shown, "ok", ""))
                except OSError as e:
                    out.append((name, "", "error", str(e)[:200]))
            yield pd.DataFrame(out, columns=["chunk_id", "output_path", "status", "message"])

    return encoded.select("chunk_id", "content").mapInPandas(run, "chunk_id string, output_path string, status string, message string")
