"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here: [\x20\x09-\x0D].
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    A local one is set only where the setting is absent in local mode (tests); on a
    cluster, whose executors couldn't read it, that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='marlstone-')}")
    return sc.getCheckpointDir()


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session's SQL settings while something runs; __ stands for a dot."""
    named = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in named}
    try:
        for k, v in named.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, at: str, by: str | None = None) -> DataFrame:
    """df written as a table, in a folder for each of the few values of a column if asked, and read again: its lineage is cut, and its
    shuffle files go as soon as it is written."""
    with settings(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", spark__sql__maxConcurrentOutputFileWriters="4"):
        (df.write.partitionBy(by) if by else df.write).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def removed(spark: SparkSession, at: str) -> None:
    """A table of an operator's own that nothing reads any more goes."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have the driver collect garbage now: Spark deletes shuffle files and checkpoints once their objects are collected,
    which on a large heap may be long after their last use. Nothing that is still referred to goes."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """In a Python worker: give the memory of arrays that are no longer used back to the system, for the stages to come."""
    pa.default_memory_pool().release_unused()
    if (give_back := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        give_back(0)


def if_small(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """Broadcast df if its counted rows are within limit, else leave the join to Spark."""
    return F.broadcast(df) if rows <= limit else df


# Texts of Arrow batches as one byte array -----------------------------------


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string column, nulls as empty texts."""
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, count=len(column) + 1, offset=8 * column.offset)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


#: Rows whose texts are looked at together before they are cut by bytes; bytes whose words are hashed together.
_ROWS, _BLOCK = 512, 1 << 19


def slices(batches: Iterator[pa.RecordBatch], most: int = 2 << 20, rows: int = _ROWS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches with a column text into runs of rows of about `most` bytes (or one longer row)."""
    for whole in batches:
        for at_row in range(0, whole.num_rows, rows):
            batch = whole.slice(at_row, rows)
            data, at = as_bytes(batch.column(batch.schema.get_field_index("text")))
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
                yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
                first = last
        trim()


_RNG = np.random.default_rng(20_240_501)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows (A-Z lower-cased) and each row's first word (n + 1 values)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~_IS_SPACE[data]
    begins = np.zeros(n + 1, bool)
    begins[at] = True  # a row's first byte begins a word
    after = np.zeros(n + 1, bool)
    after[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~after | begins))
    end = np.flatnonzero(after & (~inside | begins))
    # A word's hash is the sum of its bytes' values times powers of a base, from its first byte on; sums run over blocks of whole words.
    size = min(n, _BLOCK)
    power, inverse = _powers(_BASE, size), _powers(_INVERSE, size)
    h, done = np.zeros(len(start), np.uint64), 0
    while done < len(start):
        low = start[done]
        last = max(done + 1, int(np.searchsorted(end, low + size, "right")))
        m = int(end[last - 1] - low)
        if m > size:  # a longer word than a block
            size = m
            power, inverse = _powers(_BASE, size), _powers(_INVERSE, size)
        total = np.zeros(m + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[data[low : low + m]]] * power[:m], out=total[1:])
        s, e = start[done:last] - low, end[done:last] - low
        h[done:last] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)
        done = last
    return mix(h), np.searchsorted(start, at)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, out=out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
