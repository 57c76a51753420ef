"""The load ledger (S09, S13, X12, L17, G08): what is loaded, of which input, where, and what went wrong.

Rows of a load go to a folder of that attempt alone. Only when all are written does the load publish the table's next commit, a numbered
record of JSON, by a rename that fails if the number is taken. Readers follow the last commit that loaded, so a crash between writing
and publishing, a failed load or a second loader never shows half of a table, and never two copies of one.

A load whose input has the fingerprint of the last commit is skipped: names, sizes and times of all input files, and the code that makes
the table. A load that fails is recorded with its reason and raised again; what was loaded before stays readable. Errors of
storage that pass are tried again after a wait, in a folder of their own.

Counts are observed while rows are written (``DataFrame.observe``), so that statistics of a load need no second scan.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelake.sources.files import Status

RECORD = "table string, version long, status string, fingerprint string, folder string, rows long, metrics map<string, long>, reason string, schema string"


class Store:
    """A folder of any file system that Hadoop reaches."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def listing(self, pattern: str) -> list[tuple[str, bool, int, int]]:
        """(path, is a folder, bytes, time) of what a pattern names."""
        p, fs = self._at(pattern)
        told = (re.search(r"path=([^;]*); isDirectory=(\w+);(?: length=(\d+);)?.*?modification_time=(\d+)", f.toString()) for f in fs.globStatus(p) or [])
        return sorted((m[1], m[2] == "true", int(m[3] or 0), int(m[4])) for m in told)

    def names(self, folder: str) -> list[str]:
        return [path.rstrip("/").rsplit("/", 1)[1] for path, *_ in self.listing(f"{folder}/*")]

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """Make a file appear whole, if there is none of that name."""
        p, fs = self._at(path)
        draft, _ = self._at(f"{p.getParent()}/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, p, how)
        except Exception as error:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)


def fingerprint(spark: SparkSession, *patterns: str, code: str = "") -> str:
    """Names, sizes and times of all files under the patterns, folders within folders included, with the code that reads them."""
    import hashlib

    store, told, folders = Store(spark), [], list(patterns)
    while folders:
        for path, folder, size, at in store.listing(folders.pop()):
            if folder:
                folders.append(f"{path}/*")
            else:
                told.append(f"{path}\t{size}\t{at}")
    return hashlib.sha256("\n".join([code, *sorted(told)]).encode()).hexdigest()


@dataclass(frozen=True)
class Commit:
    """What became of one load of a table."""

    table: str
    version: int
    status: str
    fingerprint: str
    folder: str = ""
    rows: int = 0
    metrics: dict[str, int] = field(default_factory=dict)
    reason: str = ""
    schema: str = ""


#: What storage says of errors that pass.
PASSING = re.compile(r"timed? ?out|connection (reset|refused|closed)|temporar|too many requests|throttl|service unavailable|socket|broken pipe", re.I)


def passes(error: BaseException) -> bool:
    """Whether an error may be gone at the next attempt; errors of the plan or of its rows are not."""
    if isinstance(error, (ConnectionError, TimeoutError)):
        return True
    return isinstance(error, (OSError, PySparkException)) and bool(PASSING.search(str(error))) or "java.io.IOException" in str(error) and bool(PASSING.search(str(error)))


class Ledger:
    """Commits of tables under one root, in the folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, tries: int = 5, first_wait_s: float = 0.1):
        self.spark, self.root, self.tries, self.first_wait_s = spark, root.rstrip("/"), tries, first_wait_s
        self.store = Store(spark)
        #: (table, status) of this run, skips included.
        self.report: list[tuple[str, str]] = []

    def _commits(self, table: str) -> str:
        return f"{self.root}/{table}/commits"

    def versions(self, table: str) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.store.names(self._commits(table)) if re.fullmatch(r"\d+\.json", n))

    def commit_of(self, table: str, version: int) -> Commit:
        return Commit(**json.loads(self.store.read(f"{self._commits(table)}/{version:08d}.json")))

    def last(self, table: str) -> Commit | None:
        """The last commit of a table, whatever became of it."""
        versions = self.versions(table)
        return self.commit_of(table, versions[-1]) if versions else None

    def current(self, table: str) -> Commit | None:
        """The last commit that loaded: what readers see."""
        for version in reversed(self.versions(table)):
            if (commit := self.commit_of(table, version)).status == Status.LOADED.value:
                return commit
        return None

    def publish(self, commit: Commit) -> bool:
        return self.store.publish(f"{self._commits(commit.table)}/{commit.version:08d}.json", json.dumps(asdict(commit)))

    def load(self, table: str, stamp: str, build: Callable[[], DataFrame], by: tuple[str, ...] = (), metrics: dict[str, str] | None = None, force: bool = False, ordered: bool = False) -> Commit:
        """The current commit if it is of this fingerprint, else a new load. ``by``: columns whose values are folders; ``metrics``: SQL aggregates; ``ordered``: rows are written as they are dealt."""
        held = self.current(table)
        if held and held.fingerprint == stamp and not force:
            self.report.append((table, Status.SKIPPED.value))
            return held
        try:
            folder, rows, counted, schema = self._written(table, build, by, metrics or {}, ordered)
        except Exception as error:
            last = self.last(table)
            self.publish(Commit(table, (last.version if last else 0) + 1, Status.FAILED.value, stamp, reason=f"{type(error).__name__}: {error}"[:2000]))
            self.report.append((table, Status.FAILED.value))
            raise
        while True:
            other = self.current(table)
            if other and other != held and other.fingerprint == stamp:  # somebody else was first
                self.store.delete(folder)
                self.report.append((table, Status.SKIPPED.value))
                return other
            last = self.last(table)
            commit = Commit(table, (last.version if last else 0) + 1, Status.LOADED.value, stamp, folder, rows, counted, schema=schema)
            if self.publish(commit):
                self.report.append((table, Status.LOADED.value))
                return commit

    def update(self, table: str, change: Callable[[DataFrame | None], DataFrame], by: tuple[str, ...] = ()) -> Commit:
        """Publish what ``change`` makes of the table as it is; if somebody publishes first, make it anew of that."""
        while True:
            base = self.current(table)
            folder, rows, counted, schema = self._written(table, lambda: change(self.read(base) if base else None), by, {})
            last = self.last(table)
            commit = Commit(table, (last.version if last else 0) + 1, Status.LOADED.value, uuid.uuid4().hex, folder, rows, counted, schema=schema)
            if self.current(table) == base and self.publish(commit):
                self.report.append((table, Status.LOADED.value))
                return commit
            self.store.delete(folder)

    def _written(self, table: str, build: Callable[[], DataFrame], by: tuple[str, ...], metrics: dict[str, str], ordered: bool = False) -> tuple[str, int, dict[str, int], str]:
        """Rows in a folder of one attempt; an error that passes is met by another attempt, after twice the wait of the one before."""
        from tracelake.serving import retried

        class Passing(Exception):
            pass

        def attempt() -> tuple[str, int, dict[str, int], str]:
            folder = f"{self.root}/{table}/data/{uuid.uuid4().hex}"
            try:
                df = build()
                schema = df.schema.json()
                counts = Observation()
                if by and not ordered:  # a folder's rows meet in one task, or in a few where they are many
                    df = self.spark.sql(f"SELECT /*+ REBALANCE({', '.join(by)}) */ * FROM {{df}}", df=df)
                df = df.observe(counts, F.count(F.lit(1)).alias("rows"), *(F.expr(e).cast("long").alias(k) for k, e in metrics.items()))
                (df.write.partitionBy(*by) if by else df.write).parquet(folder)
                counted = dict(counts.get)
            except Exception as error:
                self.store.delete(folder)
                if passes(error):
                    raise Passing(str(error)) from error
                raise
            return folder, counted.pop("rows"), {k: v or 0 for k, v in counted.items()}, schema

        try:
            return retried(attempt, (Passing,), self.tries, self.first_wait_s)
        except Passing as error:
            raise error.__cause__

    def read(self, commit: Commit) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(commit.schema))).parquet(commit.folder)

    def table(self, name: str) -> DataFrame:
        if not (commit := self.current(name)):
            raise KeyError(name)
        return self.read(commit)

    def tables(self) -> list[str]:
        return self.store.names(self.root)

    def history(self) -> DataFrame:
        """All commits of all tables, as rows."""
        if not self.store.listing(f"{self.root}/*/commits/*.json"):
            return self.spark.createDataFrame([], RECORD)
        return self.spark.read.schema(RECORD).json(f"{self.root}/*/commits/*.json")

    def status(self) -> DataFrame:
        """The last commit of each table: the status of the load."""
        columns = [f.name for f in self.history().schema if f.name != "table"]
        return self.history().groupBy("table").agg(F.max_by(F.struct(*columns), "version").alias("last")).select("table", "last.*")

    def metrics(self) -> DataFrame:
        """(metric, n) of what readers see: counts that were taken while the tables were written."""
        loaded = self.history().where(F.col("status") == Status.LOADED.value).groupBy("table").agg(F.max_by("metrics", "version").alias("metrics"))
        return loaded.select(F.explode("metrics").alias("metric", "n"))

    def vacuum(self) -> list[str]:
        """Delete the folders that no commit's readers see: attempts that were not published, and what later loads replaced."""
        gone = []
        for table in self.tables():
            held = self.current(table)
            for name in self.store.names(f"{self.root}/{table}/data"):
                folder = f"{self.root}/{table}/data/{name}"
                if not held or held.folder.rsplit("/", 1)[1] != name:
                    self.store.delete(folder)
                    gone.append(folder)
        return gone
