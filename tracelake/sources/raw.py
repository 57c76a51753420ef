"""Raw artifacts (X01, X02, S01, N15, L05): line JSON of hosts, from manifests to the records that a graph is made of.

All hosts' files of an artifact are one scan; the host is a column, looked up by the file. Every line gets a number that does not depend
on how files are split: one pass counts the lines of each split, and their running sums, a row a split, number the lines of the
next. A line is a variant, read with the schema that a reader asks for; lines that are no JSON object are set aside with file
and number (or end the load, if the reader is strict). The XML of an event becomes a variant of its own.

Defined cases: blank lines are skipped but numbered; a host without an artifact has no rows of it; only the process list is
required, and a host that lacks it fails the load; a null or missing field is null; of equal field names of an event the last counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import normalize as n
from tracelake.plans.planning import artifacts_of, event_ids
from tracelake.sources.files import Status
from tracelake.sources.ledger import Ledger, Store, fingerprint

LINES = "hostname string, file string, line long, seq long, text string"
REQUIRED = ("pslist",)


@dataclass(frozen=True)
class Manifest:
    """A host and where its artifacts are. Paths may name {data_dir} and {hostname}; other relative ones are under data_dir."""

    hostname: str
    data_dir: str = "."
    event_profile: str = ""
    artifacts: dict[str, str] = field(default_factory=dict)

    def path(self, artifact: str) -> str:
        template = self.artifacts[artifact]
        path = template.format(hostname=self.hostname, data_dir=self.data_dir)
        return path if "{data_dir}" in template or path.startswith("/") or "://" in path else f"{self.data_dir.rstrip('/')}/{path}"


def manifests(spark: SparkSession, pattern: str) -> list[Manifest]:
    """Manifests of JSON files, by host name."""
    store, known = Store(spark), Manifest.__dataclass_fields__
    found = [json.loads(store.read(path)) for path, folder, *_ in store.listing(pattern) if not folder]
    return sorted((Manifest(**{k: v for k, v in m.items() if k in known}) for m in found), key=lambda m: m.hostname)


def bare(path: str) -> str:
    """A path without its scheme, authority and escapes."""
    return re.sub(r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", "", unquote(path)).rstrip("/")


def numbered(spark: SparkSession, paths: list[str], hosts: dict[str, str] | None = None) -> DataFrame:
    """(hostname, file, line, seq, text) of text files and folders of them: the number of a line in its file, and over all files in
    order of their names. ``hosts``: whose a file or folder is."""
    owners = {bare(path): host for path, host in (hosts or {}).items()}

    def owner(file: str) -> str | None:
        path = bare(file)
        while path and path not in owners:
            path = path.rpartition("/")[0]
        return owners.get(path)

    if not paths:
        return spark.createDataFrame([], LINES)
    scan = spark.read.option("recursiveFileLookup", "true").text(paths)
    split = scan.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))
    counted = split.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n")).collect()
    starts, every, here, last = [], 0, 0, None
    for file, block, first, count in sorted(map(tuple, counted)):
        here = 0 if file != last else here
        starts.append((owner(file), file, block, first, count, here, every))
        here, every, last = here + count, every + count, file
    table = spark.createDataFrame(starts, "hostname string, file string, block long, first long, n long, here long, every long")
    nth = F.col("id") - F.col("first")
    sure = F.when((nth >= 0) & (nth < F.col("n")), nth).otherwise(F.raise_error(F.lit("files were split otherwise when their lines were counted")).cast("long"))
    # a row a split: fewer than the listing of files that the driver holds anyway
    return split.join(F.broadcast(table), ["file", "block"]).withColumn("nth", sure).select("hostname", "file", (F.col("nth") + F.col("here") + 1).alias("line"), (F.col("nth") + F.col("every") + 1).alias("seq"), "text")


def parsed(lines: DataFrame) -> DataFrame:
    """lines with ``record``, a variant; null where the line is no JSON object. Blank lines go.

    The record is generated: a condition on a column that is only computed is pushed below it, and parses the line again wherever it names it.
    """
    record = F.transform(F.array(F.try_parse_json("text")), lambda r: F.when(F.schema_of_variant(r).startswith("OBJECT"), r))
    return lines.where(F.trim("text") != "").select("*", F.explode_outer(record).alias("record"))


def rescued(lines: DataFrame) -> DataFrame:
    """Lines that are no JSON object, with where they stand."""
    return parsed(lines).where("record IS NULL").drop("record")


def records(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Lines that are JSON objects; strict ones end the load at a line that is not."""
    found = parsed(lines)
    if not strict:
        return found.where("record IS NOT NULL")
    bad = F.raise_error(F.concat(F.lit("no JSON object in "), "file", F.lit(" line "), F.col("line").cast("string")))
    return found.withColumn("record", F.when(F.col("record").isNotNull(), F.col("record")).otherwise(bad.cast("variant")))


def get(*names: str, of: str = "record", kind: str = "string") -> Column:
    """The first of the fields that holds something."""
    found = [F.try_variant_get(F.col(of), f"$['{name}']", kind) for name in names]
    return F.coalesce(*(F.nullif(c, F.lit("")) if kind == "string" else c for c in found))


#: Fields of an event's XML, by our column.
EVENT_FIELDS = {
    "image": ["Image", "NewProcessName", "ProcessName"], "command_line": ["CommandLine"], "parent_image": ["ParentImage", "ParentProcessName"], "target_filename": ["TargetFilename"], "process_id": ["ProcessId"],
    "process_guid": ["ProcessGuid"], "parent_process_guid": ["ParentProcessGuid"], "target_user": ["TargetUserName", "SubjectUserName", "AccountName"], "logon_type": ["LogonType"], "workstation": ["WorkstationName", "Workstation"],
    "ip": ["DestinationIp", "IpAddress", "SourceNetworkAddress"], "port": ["DestinationPort"], "protocol": ["Protocol"], "query_name": ["QueryName"], "registry_key": ["TargetObject"], "registry_details": ["Details"],
    "service_name": ["ServiceName"], "service_path": ["ImagePath"], "script_text": ["ScriptBlockText"], "consumer": ["Consumer"], "wmi_filter": ["Filter"],
}


def events(found: DataFrame, packs: frozenset[str] | None = None) -> DataFrame:
    """Events of the packs (None: of all), their XML read into columns; those without a known id go.

    What conditions and columns name again and again is generated, as records are, so that it is read once.
    """
    xml = get("xml_string", "message")
    read = {"event_id": n.event_id(get("event_identifier", "event_id"), xml), "xml": xml, "at": get("datetime", "date_time"), "number": get("uuid", "record_number")}
    hashed = {"stamp": F.coalesce(get("datetime", "timestamp"), F.lit("")), "kind": get("event_identifier", "event_id"), "channel": F.coalesce(get("source", "display_name"), F.lit(""))}
    rows = found.select("hostname", "seq", F.explode_outer(F.array(F.struct(*(c.alias(k) for k, c in (read | hashed).items())))).alias("e")).select("hostname", "seq", "e.*")
    rows = rows.where(F.col("event_id").isin(sorted({e for _, e in event_ids(packs)}))).select("*", F.explode_outer(F.array(n.event_fields(F.col("xml")))).alias("data"))
    ident = n.stable_event_id(F.col("hostname"), F.col("number"), F.col("hostname"), F.col("stamp"), F.col("kind"))
    columns = [F.coalesce(*(F.try_element_at("data", F.lit(name)) for name in names), F.lit("")).alias(c) for c, names in EVENT_FIELDS.items()]  # no value of the map is empty
    return rows.select("hostname", "seq", "event_id", ident.alias("id"), n.timestamp(F.col("at")).alias("timestamp"), "channel", *columns)


def process_list(found: DataFrame) -> DataFrame:
    return found.select("hostname", "seq", n.to_int(get("PID", "pid")).alias("pid"), n.to_int(get("PPID", "ppid")).alias("ppid"), F.coalesce(get("ImageFileName", "name"), F.lit("")).alias("name"), get("CreateTime", "create_time").alias("create_time"))


def executions(found: DataFrame, source: str) -> DataFrame:
    path = n.windows_path(get("path", "executable", "filename"))
    return found.select("hostname", F.lit(source).alias("source"), path.alias("path"), n.timestamp(get("last_run", "last_run_time", "timestamp", "datetime")).alias("timestamp"), n.to_int(get("order", "entry")).alias("shim_order"), n.to_int(get("run_count", "run_count_total", "number_of_executions")).cast("long").alias("run_count"), "seq")


def catalog(found: DataFrame, source: str) -> DataFrame:
    return found.select("hostname", "seq", n.windows_path(get("path", "filename")).alias("path"), get("size", kind="long").alias("size"), F.lit(source).alias("source"))


class RawTables:
    """The records of hosts, by the names that a graph is made of; each is built of the artifacts that the tier loads."""

    def __init__(self, spark: SparkSession, hosts: list[Manifest], artifacts: frozenset[str], packs: frozenset[str] | None = None, strict: bool = False):
        self.spark, self.hosts, self.artifacts, self.packs, self.strict = spark, hosts, artifacts, packs, strict
        self.store, self.paths = Store(spark), cache(self._paths)

    def _paths(self, artifact: str) -> dict[str, str]:
        """Paths of an artifact by host, of hosts that have it."""
        if artifact not in self.artifacts:
            return {}
        named = {h.hostname: h.path(artifact) for h in self.hosts if artifact in h.artifacts}
        return {host: path for host, path in named.items() if self.store.listing(path)}

    def status(self) -> list[tuple[str, str, str]]:
        """(host, artifact, status) before loading."""
        return [(h.hostname, a, (Status.READY if h.hostname in self.paths(a) else Status.MISSING).value) for h in self.hosts for a in sorted(self.artifacts)]

    def lines(self, artifact: str) -> DataFrame:
        """Numbered lines with their host: the host whose path the file is, or is under."""
        paths = self.paths(artifact)
        return numbered(self.spark, list(paths.values()), {self.store.listing(path)[0][0]: host for host, path in paths.items()})

    def records(self, artifact: str) -> DataFrame:
        return records(self.lines(artifact), self.strict)

    def rescued(self) -> DataFrame:
        """(artifact, hostname, file, line, text) of all lines that are no JSON object."""
        parts = [rescued(self.lines(a)).select(F.lit(a).alias("artifact"), "hostname", "file", "line", "text") for a in sorted(self.artifacts)]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    def view(self, name: str) -> DataFrame:
        match name:
            case "v_event":
                return events(self.records("evtx"), self.packs)
            case "v_pslist":
                return process_list(self.records("pslist"))
            case "v_exec":
                return executions(self.records("shimcache"), "shimcache").unionByName(executions(self.records("prefetch"), "prefetch"))
            case "v_catalog":
                return catalog(self.records("mft"), "mft").unionByName(catalog(self.records("path_catalog"), "filestat"))
            case "v_usb":
                found = self.records("usb")
                return found.select("hostname", get("device_id", "serial", "DeviceID").alias("device_id"), get("friendly_name", "FriendlyName").alias("friendly_name"), get("vendor", "Vendor").alias("vendor"), get("first_seen", "first_connected").alias("first_seen"), get("last_seen", "last_connected").alias("last_seen"))
            case "v_media":
                found = self.records("media_exif")
                return found.select("hostname", "seq", get("path", "SourceFile").alias("path"), get("GPSLatitude", "latitude", kind="double").alias("latitude"), get("GPSLongitude", "longitude", kind="double").alias("longitude"), F.coalesce(get("DateTimeOriginal", "taken_at"), F.lit("")).alias("taken_at"))
        raise KeyError(name)


#: Tables of the graph that an artifact's records fill.
FILLS = {
    "pslist": ["process", "spawned"], "evtx": ["event", "sysmon_spawned", "modified", "file_event", "logged_in", "dns", "registry", "service", "script", "wmi", "created", "connected", "module"], "dlllist": [],
    "netscan": [], "shimcache": ["executed"], "prefetch": ["executed", "describes"], "mft": ["file"], "path_catalog": ["file"], "usb": ["usb"], "media_exif": ["media"], "bulk": [],
}


def load_hosts(spark: SparkSession, hosts: list[Manifest], root: str, tier: str = "triage", case_type: str = "intrusion", only: set[str] | None = None, force: bool = False, strict: bool = False) -> tuple[Ledger, list[tuple[str, str, str]]]:
    """From manifests to a graph under ``root``: tables of the tier's artifacts, each by the ledger, so that what is loaded of the
    same files is skipped. Lines that are no JSON object are a table, ``rescued``. Returns the ledger and the artifacts' status.

    A host without a required artifact ends the load before anything is written.
    """
    from tracelake.plans.planning import tier_plan
    from tracelake.plans.store import FOLDERS, METRICS, Projected, graph_code

    plan = tier_plan(tier, case_type, only=only, override=hosts[0].event_profile if len({h.event_profile for h in hosts}) == 1 else "")
    raw = RawTables(spark, hosts, plan.artifacts if only is None else frozenset(only) & artifacts_of("full"), plan.packs, strict)
    status = raw.status()
    lacking = [f"{a} of {h}" for h, a, s in status if a in REQUIRED and s != Status.READY.value]
    if lacking:
        raise FileNotFoundError(f"required and missing: {', '.join(lacking)}")
    ledger = Ledger(spark, root)
    files = sorted(p for a in raw.artifacts for p in raw.paths(a).values())
    stamp = fingerprint(spark, *files, code=f"{graph_code()} {sorted(plan.packs or [])} {sorted(raw.artifacts)}")
    wanted = [t for a in sorted(raw.artifacts) if raw.paths(a) for t in FILLS[a]]

    def once(name: str, build: Callable[[], DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
        return ledger.read(ledger.load(name, stamp, build, by, METRICS.get(name), force and name not in dict(ledger.report)))

    def view(name: str) -> DataFrame:
        """Records are parsed once, and kept as a table."""
        return once(name, lambda: raw.view(name))

    def table(name: str) -> DataFrame:
        graph = Projected(spark, "", table, view)
        return once(name, lambda: graph.table(name), FOLDERS.get(name, ()))

    for name in dict.fromkeys(wanted):
        if name not in dict(ledger.report):
            table(name)
    once("rescued", raw.rescued)
    return ledger, status
