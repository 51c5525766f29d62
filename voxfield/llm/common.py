"""What the operators share: text blocks from Arrow batches, tables in the shared folder, keyed exchanges."""

from __future__ import annotations

import atexit
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20  # text handled at once by a Python worker, except for one longer document


def text_blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into slices of at most `most` bytes of text and `rows` rows; a longer document is a slice of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            before = ends[at - 1] if at else 0
            to = min(max(int(np.searchsorted(ends, before + most, "right")), at + 1), at + rows)
            yield batch.slice(at, to - at)
            at = to


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows in this session, unless it asks for fewer. A batch of whole texts is held by the JVM and the Python worker, going
    and coming, for each task at once, so its rows bound what an executor needs beside its heap; the rows' results don't depend on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; a null text is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def lists(values: np.ndarray, lengths: np.ndarray | list[int], kind: pa.DataType) -> pa.ListArray:
    """A list array of flat values cut by lengths."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def _narrow(x: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of each number."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _wide(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return out.view(np.uint64)[:, 0]


def _join(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts) + 1}I", len(parts), *map(len, parts)) + b"".join(parts)


def _cut(blob: bytes) -> list[bytes]:
    n = struct.unpack_from("<I", blob)[0]
    ends = np.cumsum([4 * n + 4, *struct.unpack_from(f"<{n}I", blob, 4)]).tolist()
    return [blob[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _gaps(x: np.ndarray) -> bytes:
    """Sorted distinct numbers by their gaps, in as many bytes (4 at least) as the widest needs."""
    gap = np.diff(x, prepend=np.uint64(0))
    size = max(4, (int(gap[1:].max(initial=0)).bit_length() + 7) // 8)
    return x[:1].tobytes() + bytes([size]) + _narrow(gap[1:], size)


def _sorted(raw: bytes) -> np.ndarray:
    if not raw[:8]:
        return np.zeros(0, np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(raw[:8], np.uint64), _wide(raw[9:], raw[8])]), dtype=np.uint64)


def split_keys(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Where each part begins in sorted keys of so many bits: parts are equal ranges of the hash."""
    bounds = np.array([(k << bits) // parts for k in range(parts)], object)
    return np.append(np.searchsorted(keys, bounds.astype(np.uint64), "left"), len(keys))


def is_held_out(id_col: str, parts: int, part: int):
    """True for documents whose crc32 of the id's decimal text leaves `part` when divided by `parts`; null ids are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


_made: dict[str, SparkSession] = {}
_owner: ContextVar[set[str] | None] = ContextVar("tables of the innermost scratch()", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the checkpoint folder that was set on the context.
    Where neither is set, a local session uses a temporary folder of its own; on a cluster that is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top:
        return top.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="voxfield-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def store(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts its lineage; lost executors cost only a reread. `drop`
    removes it once nothing reads it any more; what is left goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/voxfield-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _made[path] = spark
    if (own := _owner.get()) is not None:
        own.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._voxfield_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Removes tables made by `store`, which nothing may read any more. Other DataFrames are left alone."""
    for df in tables:
        path = getattr(df, "_voxfield_path", None)
        if path and _made.pop(path, None):
            _delete(df.sparkSession, path)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives `store` for results; every other table that this block made is removed at the end. Tables of other threads, of what runs beside it and of an
    outer block before it are left alone; what an inner block keeps belongs to the outer one."""
    own, kept = set(), set()
    outer, token = _owner.get(), _owner.set(own)

    def keep(df: DataFrame) -> DataFrame:
        out = store(df)
        kept.add(out._voxfield_path)
        return out

    try:
        yield keep
    finally:
        _owner.reset(token)
        if outer is not None:
            outer |= own & kept
        for path in own - kept:
            if spark := _made.pop(path, None):
                _delete(spark, path)


@atexit.register
def _remove() -> None:
    for path, spark in _made.items():
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: its folder goes with it
            return


def join_hot(rows: DataFrame, small: DataFrame, key: str, small_key: str, count: str, total: int, parts: int = 1000) -> DataFrame:
    """rows with the columns of small, which has one row for each key and in `count` the number of rows with it; rows without one get
    nulls. Keys with more than total / parts rows, at most `parts` of them, are broadcast, so that no task gets all rows of one."""
    bound = total // parts
    hot = F.broadcast(small.where(F.col(count) > bound))
    there = rows.join(hot, rows[key] == hot[small_key])
    rest = rows.join(hot.select(small_key), rows[key] == hot[small_key], "left_anti")
    cold = small.where(F.col(count) <= bound)
    return there.unionByName(rest.join(cold, rest[key] == cold[small_key], "left"))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Groups rows that come sorted by key: yields each key with its rows, one group in memory at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and held[-1].column(key)[0].as_py() != keys[a]:
                yield held[0].column(key)[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held[0].column(key)[0].as_py(), pa.Table.from_batches(held)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)
