"""Files of volumes that are read and written volume by volume, in bounded memory.

The files are single-file NIfTI-1 images, as sources.nifti has them. A compressed one that is written here has a
gzip member for the header and one for each volume; a member says in its header how long it is and how many
volumes it holds. Any reader takes such a file as an ordinary gzip file, and this one gets at a volume by going
from member to member without inflating those before it. Uncompressed files are read in place, and files that
others have compressed in one stream are inflated forward, up to the last volume that is wanted. No more than a
volume and a piece of the file is in memory. Any store that pyarrow reaches by path or URI will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from framewise.sources.nifti import HEADER, OFFSET, TYPES

#: Bytes that are read from a compressed file at once.
PIECE = 1 << 20
#: Fixed values of the gzip format: start of a member with an extra field, and its length; the name of ours is free.
START, FIXED, NAME, EXTRA = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff", 10, b"VX", 12


@dataclass(frozen=True)
class Layout:
    """What a header says: (x, y, z), volumes, axes, value type, scaling, affine (16, row by row), start of the data."""

    shape: tuple[int, int, int]
    volumes: int
    axes: int
    dtype: np.dtype
    slope: float
    inter: float
    affine: tuple[float, ...]
    start: int

    @property
    def bytes(self) -> int:
        """Of a volume."""
        return int(np.prod(self.shape)) * self.dtype.itemsize

    def values(self, raw: bytes) -> np.ndarray:
        """A volume's values as float32 in C order, scaled."""
        data = np.frombuffer(raw, self.dtype).reshape(self.shape, order="F").astype(np.float32)
        if self.slope not in (0.0, 1.0) or self.inter:
            data = data * np.float32(self.slope or 1.0) + np.float32(self.inter)
        return np.ascontiguousarray(data).ravel()


def layout(head: bytes) -> Layout:
    """The layout of the file that begins with these bytes; ValueError if it isn't such a file."""
    if len(head) < OFFSET:
        raise ValueError("shorter than a header")
    order = "<" if struct.unpack_from("<i", head)[0] == HEADER else ">"
    if struct.unpack_from(order + "i", head)[0] != HEADER:
        raise ValueError("no NIfTI-1 header")
    dim = struct.unpack_from(order + "8h", head, 40)
    code = struct.unpack_from(order + "h", head, 70)[0]
    if code not in TYPES or not 3 <= dim[0] <= 4:
        raise ValueError(f"type {code} with {dim[0]} axes is not read")
    start, slope, inter = (struct.unpack_from(order + "f", head, k)[0] for k in (108, 112, 116))
    pix = struct.unpack_from(order + "8f", head, 76)
    if struct.unpack_from(order + "h", head, 254)[0] > 0:
        rows = np.array(struct.unpack_from(order + "12f", head, 280), float).reshape(3, 4)
    else:
        rows = np.hstack([np.diag(pix[1:4]), np.zeros((3, 1))])
    affine = tuple(np.vstack([rows, [0, 0, 0, 1]]).ravel().tolist())
    return Layout(tuple(dim[1:4]), dim[4] if dim[0] == 4 else 1, dim[0], np.dtype(order + TYPES[code]), slope, inter, affine, int(start))


def member(raw: bytes, volumes: int, level: int = 1) -> bytes:
    """A gzip member that says its own length and how many volumes it holds."""
    body = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = body.compress(raw) + body.flush()
    size = FIXED + 2 + EXTRA + len(body) + 8
    extra = NAME + struct.pack("<HII", 8, size, volumes)
    return START + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def member_size(head: bytes) -> tuple[int, int] | None:
    """(bytes, volumes) of the member that begins so; None if it isn't one of ours."""
    if len(head) < FIXED + 2 + EXTRA or head[:4] != START[:4] or head[FIXED + 2 : FIXED + 4] != NAME:
        return None
    return struct.unpack_from("<II", head, FIXED + 6)


def file_header(shape: tuple[int, int, int], volumes: int, affine: np.ndarray | None = None, header: bytes | None = None) -> bytes:
    """The header of a float32 file of so many volumes: a new one by the affine, or that of another file with these numbers changed."""
    from framewise.sources.nifti import MAGIC

    head = bytearray(header) if header is not None else bytearray(OFFSET)
    order = ">" if header is not None and struct.unpack_from("<i", head)[0] != HEADER else "<"
    struct.pack_into(order + "8h", head, 40, 4, *shape, volumes, 1, 1, 1)
    struct.pack_into(order + "2h", head, 70, 16, 32)
    struct.pack_into(order + "3f", head, 108, len(head), 1.0, 0.0)
    if header is None:
        affine = np.eye(4) if affine is None else np.asarray(affine, float).reshape(4, 4)
        struct.pack_into("<i", head, 0, HEADER)
        struct.pack_into("<8f", head, 76, 1.0, *np.sqrt((affine[:3, :3] ** 2).sum(axis=0)), 1.0, 1.0, 1.0, 1.0)
        struct.pack_into("<2h", head, 252, 0, 1)
        struct.pack_into("<12f", head, 280, *affine[:3].ravel())
        head[344:348] = MAGIC
    return bytes(head)


def as_stored(values: np.ndarray, shape: tuple[int, int, int], header: bytes) -> bytes:
    """A volume's bytes as a file with this header has them: float32 in its byte order, x fastest."""
    order = "<" if struct.unpack_from("<i", header)[0] == HEADER else ">"
    return np.asarray(values, np.float32).reshape(shape).astype(order + "f4").tobytes(order="F")


class VolumeFile:
    """One file, open for reading. ``inflated`` counts the volumes that were decoded or gone through."""

    def __init__(self, store, path: str):
        self.file, self.inflated = store.open_input_file(path), 0
        first = self.file.read(FIXED + 2 + EXTRA)
        self.packed, self.own = first[:2] == b"\x1f\x8b", member_size(first)
        self.file.seek(0)
        if self.own:
            self.header = zlib.decompress(self.file.read(self.own[0]), 31)
        else:
            self.header = self._head()
        self.layout = layout(self.header)

    def __enter__(self) -> "VolumeFile":
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def _stream(self) -> Iterator[bytes]:
        """The file's contents from the start, inflated in pieces, over all members."""
        self.file.seek(0)
        inflate = zlib.decompressobj(31) if self.packed else None
        raw = self.file.read(PIECE)
        while raw:
            if inflate is None:
                yield raw
                raw = self.file.read(PIECE)
                continue
            yield inflate.decompress(raw, PIECE)
            raw = inflate.unconsumed_tail or inflate.unused_data or b""
            if inflate.eof:
                raw = raw or self.file.read(PIECE)
                inflate = zlib.decompressobj(31)
            elif not raw:
                raw = self.file.read(PIECE)
                if not raw:
                    raise EOFError("the compressed stream ends early")

    def _head(self) -> bytes:
        got = b""
        for piece in self._stream():
            got += piece
            if len(got) >= OFFSET:
                order = "<" if struct.unpack_from("<i", got)[0] == HEADER else ">"
                size = max(OFFSET, int(struct.unpack_from(order + "f", got, 108)[0])) if struct.unpack_from(order + "i", got)[0] == HEADER else OFFSET
                if len(got) >= size:
                    return got[:size]
        raise ValueError("shorter than a header")

    def volumes(self, first: int = 0, last: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(volume, values) from ``first`` to ``last``, inclusive; those outside the file are left out."""
        end = self.layout.volumes if last is None else min(last + 1, self.layout.volumes)
        first, size = max(first, 0), self.layout.bytes
        if first >= end:
            return
        if self.own:
            yield from self._members(first, end)
        elif not self.packed:
            self.file.seek(self.layout.start + first * size)
            for t in range(first, end):
                yield t, self._decoded(self.file.read(size))
        else:
            rest, skip, t = bytearray(), self.layout.start + first * size, first
            self.inflated += first
            for piece in self._stream():
                if skip >= len(piece):
                    skip -= len(piece)
                    continue
                rest += memoryview(piece)[skip:]
                skip = 0
                while len(rest) >= size and t < end:
                    yield t, self._decoded(bytes(rest[:size]))
                    del rest[:size]
                    t += 1
                if t >= end:
                    return
            raise EOFError("the file ends before its last volume")

    def _members(self, first: int, end: int) -> Iterator[tuple[int, np.ndarray]]:
        at, t, size = self.own[0], 0, self.layout.bytes
        while t < end:
            self.file.seek(at)
            found = member_size(self.file.read(FIXED + 2 + EXTRA))
            if found is None:
                raise EOFError("the file ends before its last volume")
            length, n = found
            if t + n > first:
                self.file.seek(at)
                raw = zlib.decompress(self.file.read(length), 31)
                for k in range(max(first - t, 0), min(n, end - t)):
                    yield t + k, self._decoded(raw[k * size : (k + 1) * size])
            at, t = at + length, t + n

    def _decoded(self, raw: bytes) -> np.ndarray:
        if len(raw) < self.layout.bytes:
            raise EOFError("the file ends before its last volume")
        self.inflated += 1
        return self.layout.values(raw)


def store_of(path: str):
    """(store, path in it) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)
