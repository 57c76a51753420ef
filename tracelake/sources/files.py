"""Sources and sinks (S): line JSON, fallback choice, filters, probes, artifact checks and table output."""

from __future__ import annotations

import re
import tempfile
from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelake.functions.normalize import key_name

#: Columns that restore the order of lines over files and splits; the id alone does not.
FILE_ORDER = ("_file", "_block", "_line")


class Status(Enum):
    """S09"""

    MISSING = "missing"
    EMPTY = "empty"
    READY = "ready"
    SKIPPED = "skipped"
    LOADED = "loaded"
    FAILED = "failed"


def read_ndjson(spark: SparkSession, path: str, schema: StructType | str, ordered: bool = False) -> DataFrame:
    """One object a line, blank lines skipped, a bad line raises; keys in snake case. The schema names raw keys."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    df = df.toDF(*(key_name(c) for c in df.columns)) if not ordered else df.select(*(F.col(f"`{c}`").alias(key_name(c)) for c in df.columns), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    return df


def _size(spark: SparkSession, path: str) -> int:
    """Bytes under a path of any store; -1 if there is nothing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else -1


def check_artifact(spark: SparkSession, path: str) -> Status:
    """S09"""
    n = _size(spark, path)
    return Status.MISSING if n < 0 else Status.EMPTY if n == 0 else Status.READY


def first_ready(spark: SparkSession, *paths: str) -> str | None:
    """The first path that holds anything."""
    return next((p for p in paths if check_artifact(spark, p) is Status.READY), None)


def discover_hosts(spark: SparkSession, folder: str, suffix: str = "_pslist.json") -> list[str]:
    """Hosts that a folder has a file of."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*{suffix}")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    return sorted(s.getPath().getName().removesuffix(suffix) for s in found)


def event_filter(terms: list[tuple[str | None, int]], since: str | None = None) -> Column:
    """Any of (source, event id), a source of None being any; optionally from a time on."""
    one = lambda s, e: (F.col("event_id") == e) & (F.lit(True) if s is None else F.col("source") == s)
    kept = reduce(lambda a, b: a | b, (one(s, e) for s, e in terms), F.lit(False))
    return kept & (F.col("timestamp") >= since) if since else kept


def name_filter(column: str, tokens: list[str]) -> Column:
    """A name that contains any of the tokens."""
    return reduce(lambda a, b: a | b, (F.col(column).contains(t) for t in tokens), F.lit(False))


def keys_of(df: DataFrame, column: str) -> DataFrame:
    """Keys of JSON objects."""
    return df.select(F.explode(F.json_object_keys(column)).alias("key")).distinct()


def probe(df: DataFrame, column: str, n: int = 5) -> dict:
    """The first n records as they stand, and the keys that all records use."""
    return {"records": [r[0] for r in df.select(column).limit(n).collect()], "keys": sorted(r.key for r in keys_of(df, column).collect())}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none and has one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(shared_folder, "own", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = shared_folder.own = "file://" + tempfile.mkdtemp(prefix="tracelake-")
    return path.rstrip("/")


def write_table(df: DataFrame, path: str, *partitions: str) -> None:
    """Overwrites the partitions that df has rows of, and no others."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
