"""Shared plumbing of the training-data operators: durable tables, array packing, interval merging."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a maximal run of bytes other than space and \t..\r. ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local one is set only where the session names none and has one machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(shared_dir, "own", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="tracelake-")
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table in the shared folder and read it back: lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.parquet(path)
    table._written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing will read them again."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are done; it acts when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Let no Arrow batch hold much more than ``most`` bytes (a row stays whole): the session's own 10,000 rows may be all of a worker's memory."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") or -1) <= most:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, body binary): only what is needed, so extra columns of any name do no harm; a null text is empty."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"),
    )


def give_back() -> None:
    """Return freed memory to the system. A worker lives on from task to task, and what its allocators keep counts against its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], most: int = 4 << 20, column: str = "body") -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` bytes of text: what a worker holds at once as objects. A longer text stands alone, whole."""
    for b in batches:
        give_back()
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
            yield b.slice(start, stop - start)
            give_back()
            start = stop


def pack(a: np.ndarray) -> bytes:
    """A whole-number array as zstd over its differences."""
    d = np.diff(a.astype(np.int64), prepend=np.int64(0))
    lo, hi = (int(d.min()), int(d.max())) if len(d) else (0, 0)
    for kind in (np.int8, np.int16, np.int32, np.int64):
        if np.iinfo(kind).min <= lo and hi <= np.iinfo(kind).max:
            break
    return bytes([np.dtype(kind).itemsize]) + zstandard.ZstdCompressor(level=1).compress(d.astype(kind).tobytes())


def unpack(b: bytes) -> np.ndarray:
    kind = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[b[0]]
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), kind), dtype=np.int64)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals, touching ones joined."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    first = np.r_[True, s[1:] > e[:-1]]
    return s[first], e[np.r_[first[1:], True]]


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def scaled_partitions(df: DataFrame, mb: int = 16) -> int:
    """How many partitions hold ``mb`` MB of df's files each; the session's own number where that is larger."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size if size < 1 << 60 else 0  # Catalyst's "unknown" is the largest long
    return max(shuffle_partitions(df.sparkSession), known // (mb << 20) + 1)


def joined_by_id(rows: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """rows with what was found for their doc_id (one row an id at most), dealt over n partitions; rows without an id stay where they are."""
    with_id = rows.where("doc_id is not null").repartition(n, "doc_id").join(found, "doc_id", "left")
    return with_id.unionByName(rows.where("doc_id is null"), allowMissingColumns=True)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def bucket_of(ids: np.ndarray, n: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int64)
