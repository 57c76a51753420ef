"""The graph store: named node and edge tables, built lazily from artifact views, and the queries of the catalog on them."""

from __future__ import annotations

import functools
import hashlib
import inspect
import re
import sys
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import normalize as n
from tracelake.operators import graph as g
from tracelake.plans import projection
from tracelake.plans.catalog import BOUNDED, HUNTS, PARAMETERS
from tracelake.plans.planning import pack_of
from tracelake.plans.projection import dialect, view
from tracelake.sources.files import shared_folder, write_table
from tracelake.sources.ledger import Ledger, fingerprint

#: What the example case looks for in paths.
CASE = {"sensitive": ["*/en/*9*"], "extensions": ["7"], "keywords": ["research", "blog"], "aliases": {"pills": ["cheap-pills"]}, "roots": ["www.*"], "excluded": ["adult"]}


class GraphStore:
    """Tables by name; each is built once, when first asked for."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | Callable[[str], DataFrame]):
        self.spark, self._source, self._built = spark, tables, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._source(name) if callable(self._source) else self._source[name]
        return self._built[name]

    def hunt(self, name: str, **params: object) -> DataFrame:
        """A query of the catalog, with its parameters bound; an unknown name or parameter is a KeyError."""
        sql, values = dialect(BOUNDED.get(name, HUNTS[name]), spark=True), dict(PARAMETERS.get(name, {}))
        if unknown := params.keys() - values.keys():
            raise KeyError(f"{name} has no parameter {', '.join(sorted(unknown))}")
        values |= {k: v for k, v in params.items() if v is not None}
        return self.spark.sql(sql, args=values or None, **{t: self[t] for t in set(re.findall(r"\{(\w+)\}", sql))})

    def save(self, folder: str, names: tuple[str, ...]) -> None:
        """Each table as Parquet, by host where it has one; a host's new rows replace its old ones."""
        for name in names:
            self.save_one(name, f"{folder}/{name}")

    def save_one(self, name: str, folder: str) -> None:
        df = self[name]
        write_table(df, folder, *(c for c in FOLDERS.get(name, ("hostname",)) if c in df.columns and len(df.columns) > 1))

    def only(self, host: str | None = None, packs: frozenset[str] | None = None) -> GraphStore:
        """The same graph of one host, and of the events of some packs: filters on folders, so that files of others are not read."""

        def table(name: str) -> DataFrame:
            df = self[name]
            if host and "hostname" in df.columns:
                df = df.where(F.col("hostname") == host)
            if packs is not None and "pack" in df.columns:
                df = df.where(F.col("pack").isin(sorted(packs)))
            return df if packs is None or PACK_OF_TABLE.get(name) in (None, *packs) else df.where(F.lit(False))

        return GraphStore(self.spark, table)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> GraphStore:
        return cls(spark, lambda name: spark.read.parquet(f"{folder}/{name}"))


#: Tables of the graph.
NAMES = ("event", "host", "process", "module", "connected", "spawned", "sysmon_spawned", "modified", "file_event", "logged_in", "dns", "registry", "service", "script", "wmi", "created", "file", "executed", "describes", "described", "media", "usb", "feature", "same_domain", "finding")


#: Columns whose values are folders: the host where rows have one (edges have that of their first node), and packs of events.
FOLDERS: dict[str, tuple[str, ...]] = {name: ("hostname",) for name in NAMES if name not in ("host", "describes", "described", "same_domain", "finding")} | {"event": ("hostname", "pack")}
#: The pack whose events a table is made of, where it is one pack's.
PACK_OF_TABLE = {"registry": "sysmon_core", "modified": "sysmon_core", "file_event": "sysmon_core", "dns": "sysmon_core", "created": "sysmon_core", "connected": "sysmon_core", "sysmon_spawned": "sysmon_core", "module": "sysmon_core", "logged_in": "security_auth", "service": "system_services", "script": "powershell", "wmi": "wmi"}


def host_of(node: str) -> Column:
    """The host that a node's id starts with."""
    return F.split_part(node, F.lit(":"), F.lit(1))


class Projected:
    """Tables of a graph over the driver's tables, or over records of hosts."""

    def __init__(self, spark: SparkSession, sf_dir: str, written: Callable[[str], DataFrame] | None = None, records: Callable[[str], DataFrame] | None = None):
        """written: tables that are already loaded, for those that are made of them; records: where records come from, if not from the driver's tables."""
        self.view, self.written = records or (lambda name: view(spark, sf_dir, name)), written

    @cached_property
    def events(self) -> DataFrame:
        return self.written("event") if self.written else g.first_seen(self.view("v_event"))

    @cached_property
    def processes(self) -> DataFrame:
        return self.written("process") if self.written else g.processes(self.view("v_pslist"))

    @cached_property
    def runs(self) -> DataFrame:
        rows = g.tagged(g.executed(self.view("v_exec")), keywords=["research"], sensitive=["*/users/*9*"])
        seen = self.table("created").select("file_id").distinct().withColumn("hit", F.lit(True))
        return rows.join(seen, "file_id", "left").withColumn("confidence", F.when(F.col("hit"), "corroborated_sysmon").otherwise(F.col("source"))).drop("hit")

    def table(self, name: str) -> DataFrame:
        e = self.view("v_event")
        match name:
            case "event":
                return g.first_seen(self.view("v_event")).withColumn("pack", pack_of(F.col("event_id")))
            case "host":
                return self.view("v_event").select("hostname").unionByName(self.view("v_catalog").select("hostname")).distinct()
            case "process":
                return g.processes(self.view("v_pslist"))
            case "module":
                return g._of(e, 7).where("process_guid <> ''").select("hostname", "process_guid", "target_filename").distinct()
            case "connected":
                return g.sysmon_connected(self.events).withColumn("hostname", host_of("src_id"))
            case "spawned":
                return g.spawned_by_pid(self.processes).withColumn("hostname", host_of("src_id"))
            case "sysmon_spawned":
                return g.sysmon_spawned(e).withColumn("hostname", host_of("src_id"))
            case "modified":
                return g.sysmon_modified(e).withColumn("hostname", host_of("src_id"))
            case "file_event":
                return g.file_events(e)
            case "logged_in":
                return g.logged_in(self.events)
            case "dns":
                return g.resolved(e)
            case "registry" | "service" | "script" | "wmi":
                return g.event_edges(e, name)
            case "created":
                return g.created(e).withColumn("hostname", host_of("src_id"))
            case "file":
                return g.tagged(g.catalog_files(self.view("v_catalog")).withColumn("name", F.regexp_extract("path", r"[^\\/]*$", 0)), **CASE)
            case "executed":
                return self.runs
            case "describes":
                return g.describes(e, g.executed(self.view("v_exec")))
            case "described":
                return (self.written or self.table)("describes").groupBy("file_id").agg(F.count("*").alias("events"))
            case "media":
                return g.media(self.view("v_media"))
            case "usb":
                return g.usb_devices(self.view("v_usb"))
            case "feature":
                return g.features(self.view("v_feature"))
            case "same_domain":
                return g.same_domain(g.features(self.view("v_feature")), g.resolved(e))
            case "finding":
                return self.view("v_finding")
        raise KeyError(name)


def projected(spark: SparkSession, sf_dir: str) -> GraphStore:
    """The graph of the driver's tables, built anew by every query."""
    return GraphStore(spark, Projected(spark, sf_dir).table)


#: Counts that are taken while a table is written (C17), by table: what a load says of itself.
METRICS: dict[str, dict[str, str]] = {
    "sysmon_spawned": {"spawned_sysmon": "count(1)"},
    "connected": {"connected_sysmon": "count(1)"},
    "executed": {"corroborated_created": "count_if(confidence = 'corroborated_sysmon')", "executed_shimcache": "count_if(source = 'shimcache')", "executed_prefetch": "count_if(source = 'prefetch')"},
    "described": {"describes_events": "count(1)"},
    "same_domain": {"bulk_domain_links": "count(1)"},
    "feature": {"bulk_referenced": "count(1)"},
}


@functools.cache
def graph_code() -> str:
    """A digest of the code that makes tables of the graph: other code, other tables."""
    modules = (g, n, sys.modules[__name__], projection)
    return hashlib.sha256("".join(inspect.getsource(m) for m in modules).encode()).hexdigest()


def ledger_of(spark: SparkSession, sf_dir: str) -> Ledger:
    """The ledger of the graph of one folder of tables."""
    return Ledger(spark, f"{shared_folder(spark)}/graph/{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}")


def loaded(spark: SparkSession, sf_dir: str) -> GraphStore:
    """The graph of the driver's tables, each table loaded on its first use: written to the shared folder, by host where it has
    one, and read from there by all queries that follow, which prune hosts and columns. Loading is a step of its own in the
    life of a graph; queries that are asked of it again and again do not pay for it. The ledger says whether a table is loaded of
    the files as they are now; if they have changed, it is loaded anew."""
    ledger = ledger_of(spark, sf_dir)

    @functools.cache
    def stamp() -> str:
        return fingerprint(spark, f"{sf_dir}/*.parquet", code=graph_code())

    def table(name: str) -> DataFrame:
        projected_tables = Projected(spark, sf_dir, table)
        return ledger.read(ledger.load(name, stamp(), lambda: projected_tables.table(name), FOLDERS.get(name, ()), METRICS.get(name)))

    return GraphStore(spark, table)
