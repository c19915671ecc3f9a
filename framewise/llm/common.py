"""Shared helpers: shared-storage tables, size-checked joins, bounded samples and word hashing."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows up to which a table of a few fixed-width columns is broadcast (about 16 bytes each).
BROADCAST_ROWS = 200_000
#: Texts that go to a Python task at once.
ARROW_ROWS = 2_000
#: Copies of the small side, and parts of each key of the large side, when it is not broadcast.
SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="framewise-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: What the enclosing scratch() blocks have written; each thread, and each context, has its own.
_made: ContextVar[tuple[list[tuple[SparkSession, str, str | None]], ...]] = ContextVar("_made", default=())


def _remove(spark: SparkSession, path: str, name: str | None = None) -> None:
    try:
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: the files stay for the cluster's own clean-up
        pass


def _written(spark: SparkSession, path: str, name: str | None = None) -> None:
    if _made.get():
        _made.get()[-1].append((spark, path, name))
    else:
        atexit.register(_remove, spark, path, name)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what materialize() and shared_table() wrote within, but for what keep() was called with."""
    own: list[tuple[SparkSession, str, str | None]] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._shared_path)  # what materialize() returned, itself
        return df

    before = _made.set((*_made.get(), own))
    try:
        yield keep
    finally:
        _made.reset(before)
        for spark, path, name in own:
            if path in kept:
                _written(spark, path, name)
            else:
                _remove(spark, path, name)


@contextmanager
def _freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Spark drops the shuffle files of what runs within as soon as it has run."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the reading of files, not the computation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    with _freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    _written(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def shared_table(df: DataFrame, tag: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` to the shared folder as a table in buckets of ``key``: joins by it don't move its rows again."""
    spark = df.sparkSession
    name = f"{tag.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    with _freed_shuffles(spark):
        df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", path).saveAsTable(name)
    _written(spark, path, name)
    out = spark.table(name)
    out._shared_path = path
    return out


def fresh(columns: list[str], *names: str) -> list[str]:
    """These names, each with underscores after it until no column has it in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(columns: list[str], *names: str) -> list[str]:
    """The columns that have none of these names, in any case."""
    gone = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in gone]


def named(column: str) -> "F.Column":
    """The column of exactly this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def let(value: "F.Column", body) -> "F.Column":
    """``body(value)``, with ``value`` computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def few(df: DataFrame, bound: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``bound`` rows; reads no more than it needs to tell."""
    return df.limit(bound + 1).count() <= bound


def join_lookup(big: DataFrame, small: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join ``big`` with ``small`` (unique ``key``; nulls match) without dealing a hot key to one task.

    ``small`` is broadcast only if it has at most BROADCAST_ROWS rows. Beyond that it is copied
    SALTS times and every key of ``big`` is split over as many parts.
    """
    k, salt, part = fresh([*big.columns, *small.columns], "_key", "_salt", "_part")
    right = small.withColumnRenamed(key, k)
    if few(small):
        return big.join(F.broadcast(right), named(key).eqNullSafe(F.col(k)), how).drop(k)
    left = big.withColumn(salt, F.pmod(F.xxhash64(*map(named, big.columns)), F.lit(SALTS)))
    right = right.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    on = named(key).eqNullSafe(F.col(k)) & (F.col(salt) == F.col(part))
    return left.join(right, on, how).drop(salt, part, k)


def semi_by_id(docs: DataFrame, ids: DataFrame, key: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose ``key`` is in ``ids`` (nulls match), or is not with ``left_anti``.

    Ids are numbers of 64 bits, so those that are broadcast are 32 MB at most.
    """
    (k,) = fresh(docs.columns, "_key")
    ids = ids.select(F.col(key).cast("long").alias(k))
    right = F.broadcast(ids) if few(ids, 10 * BROADCAST_ROWS) else ids
    return docs.join(right, docs[key].cast("long").eqNullSafe(F.col(k)), how)


def bounded_sample(df: DataFrame, by: str, per_class: int, order: str = "doc_id") -> DataFrame:
    """At most ``per_class`` rows of each value of ``by``, chosen by the hash of ``order``.

    A hash threshold from each value's row count comes before the ranking, so that no window
    partition holds more than about twice the bound.
    """
    n, u, r = fresh(df.columns, "_n", "_u", "_r")
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias(n))
    spread = (F.pmod(F.xxhash64(F.col(order).cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias(u)
    rank = Window.partitionBy(by).orderBy(u, order)
    near = join_lookup(df.select("*", spread), counts, by).filter(F.col(u) * F.col(n) <= 2.0 * per_class + 50)
    return near.withColumn(r, F.row_number().over(rank)).filter(F.col(r) <= per_class).drop(u, n, r)


def train_fold(column: str, parts: int) -> "F.Column":
    """crc32 of the id written as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than the six ASCII white spaces; ``bytes.split`` cuts at exactly those."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (a public-domain bijection of 64-bit values)."""
    with np.errstate(over="ignore"):
        x = x + MIX[0]
        if not isinstance(x, np.ndarray):
            x = (x ^ (x >> np.uint64(30))) * MIX[1]
            x = (x ^ (x >> np.uint64(27))) * MIX[2]
            return x ^ (x >> np.uint64(31))
        x ^= x >> np.uint64(30)
        x *= MIX[1]
        x ^= x >> np.uint64(27)
        x *= MIX[2]
        x ^= x >> np.uint64(31)
    return x


SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes whose words are hashed together, and bytes from which a word is hashed by itself.
HASHED, LONG = 4_000_000, 512


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all texts' words (runs of other bytes than the six white spaces), and where each text's words end."""
    hashes, ends, group, size = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [], 0
    count = 0
    for k, raw in enumerate(raws):
        group.append(raw)
        size += len(raw)
        if size >= HASHED or k == len(raws) - 1:
            h, upto = _hashed(group)
            hashes.append(h), ends.append(upto + count)
            group, size, count = [], 0, count + len(h)
    return np.concatenate(hashes), np.concatenate(ends)


def _hashed(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buffer = b" ".join([b"", *raws, b" " * 8])
    blank = SPACE[np.frombuffer(buffer, np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, size = edges[::2], edges[1::2] - edges[::2]
    # eight bytes from each place on
    eight = np.ndarray(len(buffer) - 7, "<u8", buffer, strides=(1,))
    with np.errstate(over="ignore"):
        h = mix64((eight[start] & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * MIX[1])
        rest, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(rest):
            left = size[rest] - k
            h[rest] = mix64(h[rest] ^ (eight[start[rest] + k] & _FIRST[np.minimum(left, 8)]))
            rest, k = rest[left > 8], k + 8
    if (long := np.flatnonzero(size > LONG)).size:
        import xxhash

        h[long] = [xxhash.xxh3_64_intdigest(buffer[a : a + n]) for a, n in zip(start[long].tolist(), size[long].tolist())]
    return h, np.searchsorted(start, np.cumsum([len(r) + 1 for r in raws]))


def encoded(texts: pa.Array, table: bytes | None = None) -> list[bytes]:
    """The texts' bytes, translated by the table; nulls are empty."""
    raws = ((t or "").encode("utf-8", "surrogatepass") for t in texts.to_pylist())
    return [r.translate(table) for r in raws] if table else list(raws)


#: Lower-cases A-Z.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` items; of the whole sequence if it has fewer; none if it is empty."""
    if not len(h):
        return h
    n = min(n, len(h))
    with np.errstate(over="ignore"):
        out = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            out = mix64(out) + h[k : len(h) - n + 1 + k]
    return mix64(out + np.uint64(n))


def _release() -> None:
    """Give freed memory back to the system, since Python workers live on through a session's tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def adding(df: DataFrame, dropped: list[str], added: str) -> T.StructType:
    """The schema of ``df`` without the dropped columns and with those of the DDL ``added``."""
    kept = [f for f in df.schema if f.name not in dropped]
    return T.StructType([*kept, *T.StructType.fromDDL(added).fields])


def batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with batches of at most ARROW_ROWS rows, since rows hold whole texts.

    The session's setting is lowered to that if it is higher; it is read when the query runs.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(name)) > ARROW_ROWS:
        df.sparkSession.conf.set(name, str(ARROW_ROWS))

    names = df.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(pa.RecordBatch.from_arrays(x.columns, names) for x in it)
        _release()

    # plain names on the way, since mapInArrow can't resolve names with dots
    return df.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(run, schema)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column from one numpy array for each row."""
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.empty(0)
    if ends[-1] < 2**31:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))
    return pa.array([x.tolist() for x in parts], pa.list_(kind))
