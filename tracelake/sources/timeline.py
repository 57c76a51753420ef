"""A timeline store (S02, X03): exported line JSON, recorded once by day, and scanned by time and kind.

Recording numbers the lines, reads each as a variant, and keeps the fields that scans filter by as columns: the day is a folder, rows of a
day are sorted by kind. A scan states its range and its kinds as predicates: days prune folders, times and kinds are pushed to the
files, and a limit takes the first lines in the order of the export. Lines that are no object are skipped and counted.

A record without a readable time is of the day "unknown", and is found by scans without a range only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import normalize as n
from tracelake.sources.ledger import Commit, Ledger, fingerprint
from tracelake.sources.raw import get, numbered, parsed

# What the kinds of records of an artifact contain.
KINDS = {"prefetch": ["prefetch"], "shimcache": ["appcompat", "shimcache"], "evtx": ["winevtx"], "filestat": ["fs:stat"]}
TABLE = "timeline"


class Timeline:
    """A store of exports under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.ledger = spark, Ledger(spark, root)

    def record(self, paths: list[str], hosts: dict[str, str] | None = None) -> Commit:
        """Record exports, unless they are recorded as they are; the commit's metrics say how many lines were skipped."""

        def build() -> DataFrame:
            # a line that is no object is a row without a record: counted while the others are written, and never returned by a scan
            lines = parsed(numbered(self.spark, paths, hosts)).withColumn("timestamp", n.timestamp(get("datetime", "date_time")))
            at = F.col("timestamp")
            day = F.when(F.col("record").isNull(), "skipped").when(at.rlike(r"^\d{4}-\d\d-\d\dT"), F.substring(at, 1, 10)).otherwise("unknown")
            kind = F.lower(F.coalesce(get("data_type", "source"), F.lit("")))
            rows = lines.select("hostname", "file", "line", "seq", "timestamp", kind.alias("kind"), n.event_id(get("event_identifier", "event_id"), get("xml_string")).alias("event_id"), get("filename", "path").alias("path"), "text", day.alias("day"))
            return rows.repartitionByRange("day", "kind", "seq").sortWithinPartitions("day", "kind", "seq")

        stamp = fingerprint(self.spark, *paths, code=TABLE)
        return self.ledger.load(TABLE, stamp, build, ("day",), {"skipped": "count_if(day = 'skipped')", "without_time": "count_if(day = 'unknown')"}, ordered=True)

    def scan(self, kinds: list[str] = (), since: str | None = None, until: str | None = None, event_ids: list[int] = (), limit: int | None = None) -> DataFrame:
        """Records of any of the kinds (a kind contains the word) and event ids, from ``since`` on and before ``until``; the first ``limit`` lines of them."""
        rows = self.ledger.table(TABLE).where(F.col("day") != "skipped")
        if since:
            rows = rows.where((F.col("day") >= since[:10]) & (F.col("timestamp") >= since))
        if until:
            rows = rows.where((F.col("day") <= until[:10]) & (F.col("timestamp") < until))
        if since or until:
            rows = rows.where(F.col("day") != "unknown")
        if kinds:
            one = F.lit(False)
            for kind in kinds:
                one |= F.col("kind").contains(kind.lower())
            rows = rows.where(one)
        if event_ids:
            rows = rows.where(F.col("event_id").isin(list(event_ids)))
        return rows if limit is None else rows.orderBy("seq").limit(limit)

    def artifact(self, name: str, **scan: object) -> DataFrame:
        """The records of an artifact, as lines that its loader reads."""
        return self.scan(KINDS[name], **scan).withColumn("record", F.parse_json("text"))

    def catalog(self, limit: int | None = None) -> DataFrame:
        """(hostname, path, size, seq): the first record of each path; ``limit``: the first so many paths."""
        found = self.artifact("filestat").where("path <> ''").select("hostname", "path", "seq", get("file_size", "size", kind="long").alias("size"))
        first = found.groupBy("hostname", "path").agg(F.min_by("size", "seq").alias("size"), F.min("seq").alias("seq"))
        return first if limit is None else first.orderBy("seq").limit(limit)
