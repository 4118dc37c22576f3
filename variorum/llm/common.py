"""What the training-data operators share: the shared folder, written tables, Arrow access.

Everything here is driver-light: no function collects rows whose number grows with the input.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that a numpy kernel takes at a time; bounds a Python worker's memory whatever the batch.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch that are handed on at a time.
PART_BYTES = 4 << 20
#: Rows times row bytes up to which a side is broadcast on request; beyond it the join shuffles.
BROADCAST_BYTES = 48 << 20
#: What a row of a few numbers takes in a broadcast relation, as measured.
ROW_BYTES = 100
_PATHS: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where none is named a temporary one is set if the session runs in
    this one process, as tests do; on a cluster, whose executors don't share this machine's folders, it raises."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    if not named:
        named = tempfile.mkdtemp(prefix="variorum-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{named}")
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/variorum-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = path
    weakref.finalize(out, _PATHS.pop, id(out), None)
    return out


def drop(df: DataFrame) -> None:
    """Deletes the table that ``written`` returned as ``df``; nothing may read it any more."""
    if path := _PATHS.get(id(df)):
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """The broadcast hint only while the counted size allows it; otherwise Spark shuffles both sides."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def free(names: list[str], taken: list[str]) -> list[str]:
    """Output names that clash with no name taken: such a one gets underscores. Case doesn't distinguish names."""
    low, out = {t.lower() for t in taken}, []
    for n in names:
        while n.lower() in low:
            n += "_"
        out.append(n)
    return out


def besides(df: DataFrame, outputs: list[str]) -> list[str]:
    """The columns that pass through beside the outputs: one that has an output's name is replaced by it."""
    low = {n.lower() for n in outputs}
    return [c for c in df.columns if c.lower() not in low]


def schema_with(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(n, t, True) for n, t in fields]])


def release() -> None:
    """Gives memory that is free in this process back to the machine. Python workers live on between tasks, and what they hold
    unused counts against an executor that may run no Python then. Callers let go of their batches first."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with a function of one batch. Spark's batches are bounded by rows and may hold many megabytes of text,
    of which a function makes several copies; so each is handed on in parts of about ``PART_BYTES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = out = None
        for b in batches:
            step = max(1, b.num_rows * PART_BYTES // max(b.nbytes, PART_BYTES))
            for x in range(0, b.num_rows, step):
                if (out := f(b.slice(x, step))) is not None:
                    yield out
        b = out = None
        release()

    return df.mapInArrow(run, schema)


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes, int64 offsets (length n + 1) and validity of a string column; nulls have no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    valid = np.asarray(col.is_valid()) if n else np.zeros(0, bool)
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, kind)[col.offset : col.offset + n + 1].astype(np.int64) if off is not None and n else np.zeros(n + 1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return bytes_, offsets - offsets[0], valid


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer text stands alone and is whole."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


# Substring hashes: h(s) = sum T[byte] * B**(i - start) mod 2**64. B is odd and so has an inverse, by which
# all substrings' hashes come from one running sum.
_B = 0x9E3779B97F4A7C15 | 1
_BINV = pow(_B, -1, 1 << 64)
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        k = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _POW = np.concatenate([[np.uint64(1)], np.cumprod(np.full(k, _B, np.uint64), dtype=np.uint64)])
            _INV = np.concatenate([[np.uint64(1)], np.cumprod(np.full(k, _BINV, np.uint64), dtype=np.uint64)])
    return _POW[:n], _INV[: n + 1]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running sums from which ``sub_hash`` takes any substring's hash; ``values`` are uint64."""
    pow_, _ = _powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * pow_, out=out[1:])
    return out


def sub_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = _powers(len(prefix) - 1)
    return (prefix[end] - prefix[start]) * inv[start]


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of the byte ranges."""
    return mix64(sub_hash(prefix_hash(_TABLE[data]), start, end) ^ (end - start).astype(np.uint64))


def runs_of(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; a run never crosses a text's border."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    prev = np.concatenate([[False], member[:-1]]) & ~border[:-1]
    following = np.concatenate([member[1:], [False]]) & ~border[1:]
    return np.flatnonzero(member & ~prev), np.flatnonzero(member & ~following) + 1
