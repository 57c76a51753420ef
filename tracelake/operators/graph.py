"""Node and edge tables of the evidence graph, as DataFrames built from artifact records.

An edge's identity is its key columns; writing it again overwrites its properties: the fold keeps the values of the
contribution with the largest sequence number, by one aggregation that combines before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import normalize as n


# -- folds (G01-G07, D01-D03) -----------------------------------------------------------------------------------------


def overwrite(rows: DataFrame, keys: list[str], props: list[str], seq: str = "seq") -> DataFrame:
    """Of each key the properties of the last writer."""
    last = rows.groupBy(*keys).agg(F.max(F.struct(F.col(seq), *props)).alias("last"))
    return last.select(*keys, *(F.col(f"last.{p}").alias(p) for p in props))


def keep_first(rows: DataFrame, keys: list[str], props: list[str], seq: str = "seq") -> DataFrame:
    """Of each key and property the first value that is not null."""
    return rows.groupBy(*keys).agg(*(F.min_by(F.col(p), F.when(F.col(p).isNotNull(), F.col(seq))).alias(p) for p in props))


def create_only(rows: DataFrame, keys: list[str], props: list[str], seq: str = "seq") -> DataFrame:
    """Of each key the properties of its creator, null or not."""
    first = rows.groupBy(*keys).agg(F.min(F.struct(F.col(seq), *props)).alias("first"))
    return first.select(*keys, *(F.col(f"first.{p}").alias(p) for p in props))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has; a table whose identity is its keys has none."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


DEDUP_RULES = {4624: ["target_user", "ip", "logon_type"], 3: ["image", "ip", "port"]}


def _rule_key(rules: dict[int, list[str]]) -> Column:
    key = F.lit(None).cast("string")
    for event, columns in rules.items():
        key = F.when(F.col("event_id") == event, F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))).otherwise(key)
    return key


def first_seen(events: DataFrame, rules: dict[int, list[str]] = DEDUP_RULES, seq: str = "seq") -> DataFrame:
    """The first event of each (host, class, key) in file order; classes without a rule pass.

    One shuffle: a first rank is a limit of each group, which every task applies to its own rows before they are dealt, so
    a hot key sends one row a task.
    """
    keyed = events.withColumn("_key", _rule_key(rules))
    by = Window.partitionBy("hostname", "event_id", "_key").orderBy(seq)
    kept = keyed.where(F.col("_key").isNotNull()).withColumn("_nth", F.row_number().over(by)).where("_nth = 1").drop("_nth")
    return keyed.where(F.col("_key").isNull()).unionByName(kept).drop("_key")


def event_by_id(events: DataFrame, event_id: str, rules: dict[int, list[str]] = DEDUP_RULES, seq: str = "seq") -> DataFrame:
    """T04 over raw events: the event of an id if ``first_seen`` keeps it. Two filtered scans and no shuffle: ids start with
    their host, and one row, fetched first, says what an earlier event of its key would look like."""
    host = event_id.split(":", 1)[0]
    here = events.where(F.col("hostname") == host).withColumn("_key", _rule_key(rules))
    found = here.where(F.col("id") == event_id)
    row = found.select("event_id", "_key", F.col(seq).alias("seq")).first()
    if row is not None and row["_key"] is not None:
        earlier = here.where((F.col("event_id") == row["event_id"]) & (F.col("_key") == row["_key"]) & (F.col(seq) < row["seq"]))
        if not earlier.limit(1).isEmpty():
            return found.where(F.lit(False)).drop("_key")
    return found.drop("_key")


def dedup_statistics(events: DataFrame, rules: dict[int, list[str]] = DEDUP_RULES) -> DataFrame:
    """Seen, kept and dropped by class."""
    keyed = events.withColumn("_key", _rule_key(rules)).where(F.col("_key").isNotNull())
    per_key = keyed.groupBy("hostname", "event_id", "_key").agg(F.count("*").alias("n"))
    return per_key.groupBy("event_id").agg(F.sum("n").alias("seen"), F.count("*").alias("kept"), (F.sum("n") - F.count("*")).alias("dropped"))


# -- loaders (L01-L14) ------------------------------------------------------------------------------------------------


def processes(pslist: DataFrame) -> DataFrame:
    """L01"""
    rows = pslist.where("pid is not null").withColumn("create_time", F.coalesce(F.nullif("create_time", F.lit("")), F.lit("unknown")))
    rows = rows.withColumn("id", n.process_id(F.col("hostname"), F.col("pid"), F.col("create_time")))
    return overwrite(rows, ["id"], ["hostname", "pid", "ppid", "name", "create_time"])


def spawned_by_pid(process: DataFrame) -> DataFrame:
    """Every process of the host with the parent's pid is a parent; times are not compared."""
    child = process.where("ppid > 0").select("hostname", F.col("ppid").alias("pid"), F.col("id").alias("dst_id"))
    return child.join(process.select("hostname", "pid", F.col("id").alias("src_id")), ["hostname", "pid"]).select("src_id", "dst_id", F.lit("memory").alias("source"), F.lit(None).cast("string").alias("timestamp")).distinct()


def newest_process(rows: DataFrame, process: DataFrame) -> DataFrame:
    """rows(hostname, pid, ..) with the newest process of that pid; an unknown time is newest."""
    newest = process.groupBy("hostname", "pid").agg(F.max(F.struct(F.when(F.col("create_time") == "unknown", "~").otherwise(F.col("create_time")), "id")).getField("id").alias("process_id"))
    return rows.join(newest, ["hostname", "pid"])


def any_process(rows: DataFrame, process: DataFrame) -> DataFrame:
    """Rows with one process of that pid, the one with the smallest id."""
    return rows.join(process.groupBy("hostname", "pid").agg(F.min("id").alias("process_id")), ["hostname", "pid"])


def executed(rows: DataFrame) -> DataFrame:
    """The first row of each file and source, in file order; shimcache has an order, prefetch a run count."""
    rows = rows.where(F.coalesce("path", F.lit("")) != "").withColumn("file_id", n.file_id(F.col("hostname"), F.col("path"))).withColumn("name", n.basename(F.col("path")))
    order, runs = F.when(F.col("source") == "shimcache", F.col("shim_order")), F.when(F.col("source") == "prefetch", F.col("run_count"))
    rows = rows.select("seq", "hostname", "file_id", "source", "path", "name", "timestamp", order.cast("int").alias("shim_order"), runs.cast("long").alias("run_count"))
    return create_only(rows, ["hostname", "file_id", "source"], ["path", "name", "timestamp", "shim_order", "run_count"])


def catalog_files(rows: DataFrame) -> DataFrame:
    """The first record of each path."""
    rows = rows.where(F.length("path") >= 2).withColumn("id", n.file_id(F.col("hostname"), F.col("path")))
    return create_only(rows, ["id"], ["hostname", "path", "size", "source"])


def media(rows: DataFrame) -> DataFrame:
    """Media with the grid cell of their place."""
    cell = F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), F.struct(n.rounded(F.col("latitude"), 3).alias("lat"), n.rounded(F.col("longitude"), 3).alias("lon")))
    return rows.select(F.concat_ws(":", "hostname", F.lit("media"), "path").alias("id"), "hostname", "path", "taken_at", "latitude", "longitude", cell["lat"].alias("cell_lat"), cell["lon"].alias("cell_lon"))


def places(found: DataFrame) -> DataFrame:
    """The places themselves: each grid cell once, with its media counted."""
    return found.where("cell_lat IS NOT NULL AND cell_lon IS NOT NULL").groupBy("cell_lat", "cell_lon").agg(F.count("*").alias("media"))


def usb_devices(rows: DataFrame) -> DataFrame:
    """L13"""
    return rows.where(F.coalesce("device_id", F.lit("")) != "").select(F.concat_ws(":", "hostname", F.lit("usb"), "device_id").alias("id"), "hostname", "device_id", "friendly_name", "vendor", "first_seen", "last_seen")


def features(rows: DataFrame) -> DataFrame:
    """Addresses and URLs (domains count as URLs), folded by host and identity; other values that look like paths are files."""
    value, kind = F.trim("value"), F.col("feature")
    what = F.when(kind == "email", "EmailAddress").when(kind.isin("url", "domain"), "URL").when(value.contains("/") | value.contains("\\"), "File")
    rows = rows.where(value != "").select("hostname", what.alias("type"), value.alias("value"), n.truncated(F.col("context"), 500).alias("context"))
    ident = F.when(F.col("type") == "File", F.col("value")).otherwise(n.truncated(F.lower("value"), 512))
    return rows.where("type is not null").groupBy("hostname", "type", ident.alias("id")).agg(F.min(F.struct("value", "context")).alias("v")).select("hostname", "type", "id", "v.value", "v.context")


# -- projections of events (PJ01-PJ11) and correlation (C01-C18) ------------------------------------------------------


def guid(column: str = "process_guid") -> Column:
    return F.concat_ws(":", "hostname", F.lit("guid"), column)


def _of(events: DataFrame, *ids: int) -> DataFrame:
    return events.where(F.col("event_id").isin(*ids))


def sysmon_spawned(events: DataFrame) -> DataFrame:
    """PJ01"""
    rows = _of(events, 1).where("process_guid <> '' AND parent_process_guid <> ''")
    rows = rows.select("seq", guid("parent_process_guid").alias("src_id"), guid().alias("dst_id"), n.basename(F.col("parent_image")).alias("parent"), n.basename(F.col("image")).alias("child"), n.to_int(F.col("process_id")).alias("pid"), "timestamp")
    return overwrite(rows, ["src_id", "dst_id"], ["parent", "child", "pid", "timestamp"])


def sysmon_connected(events: DataFrame) -> DataFrame:
    """PJ02: one edge for each process and address; the last port wins."""
    rows = _of(events, 3).where("process_guid <> ''").where(~n.skip_address(F.col("ip")))
    rows = rows.select("seq", "hostname", guid().alias("src_id"), F.col("ip").alias("address"), n.basename(F.col("image")).alias("process"), n.to_int(F.col("process_id")).alias("pid"), n.to_int(F.col("port")).alias("foreign_port"), "protocol")
    return overwrite(rows, ["src_id", "address"], ["process", "pid", "foreign_port", "protocol"])


def sysmon_modified(events: DataFrame) -> DataFrame:
    """PJ03"""
    rows = _of(events, 12, 13).where("process_guid <> '' AND registry_key <> ''")
    rows = rows.select("seq", guid().alias("src_id"), F.concat_ws(":", "hostname", "registry_key").alias("dst_id"), n.basename(F.col("image")).alias("process"), F.col("registry_key").alias("path"), F.col("registry_details").alias("details"), "timestamp")
    return overwrite(rows, ["src_id", "dst_id"], ["process", "path", "details", "timestamp"])


def file_events(events: DataFrame) -> DataFrame:
    """PJ04"""
    rows = _of(events, 11, 23).where("target_filename <> ''")
    return rows.select("id", "hostname", F.col("event_id") == 23, n.file_id(F.col("hostname"), F.col("target_filename")), "target_filename", n.basename(F.col("target_filename")), "timestamp", "image").toDF("id", "hostname", "deleted", "file_id", "path", "name", "timestamp", "image")


def logged_in(events: DataFrame) -> DataFrame:
    """PJ05: one edge for each account, host and time; C09 adds the rest of its identity."""
    rows = _of(events, 4624).where("target_user <> ''").select("seq", F.concat_ws(":", "hostname", "target_user").alias("sid"), F.col("target_user").alias("username"), "hostname", "timestamp", "logon_type", "ip")
    return overwrite(rows, ["sid", "hostname", "timestamp"], ["username", "logon_type", "ip"])


def resolved(events: DataFrame) -> DataFrame:
    """PJ06"""
    return _of(events, 22).where("query_name <> ''").select("id", "hostname", F.lower("query_name").alias("domain"), F.col("query_name").alias("query"), "image", "timestamp", "channel")


def event_edges(events: DataFrame, kind: str) -> DataFrame:
    """PJ07-PJ10: (event, node) edges of one kind, with the node's own columns and the event's."""
    key, ids, columns = {
        "registry": ("registry_key", (12, 13, 14), {"path": "registry_key", "details": "registry_details"}),
        "service": ("service_name", (7045,), {"name": "service_name", "image_path": "service_path"}),
        "script": ("script_text", (4104,), {"text": "script_text"}),
        "wmi": ("consumer", (5861,), {"consumer": "consumer", "filter": "wmi_filter"}),
    }[kind]
    values = {k: n.truncated(F.col(v), 2000) if k == "text" else F.col(v) for k, v in columns.items()}
    return _of(events, *ids).where(F.col(key) != "").select("id", "hostname", *(v.alias(k) for k, v in values.items()), "timestamp", "image", "channel")


def spawned_at(events: DataFrame) -> DataFrame:
    """One edge for each pair of processes and time; nodes are named by their whole images, by whoever comes first."""
    rows = _of(events, 1).where("process_guid <> '' AND parent_process_guid <> ''")
    rows = rows.select("seq", guid("parent_process_guid").alias("src_id"), guid().alias("dst_id"), "timestamp", F.col("parent_image").alias("parent"), F.col("image").alias("child"))
    return create_only(rows, ["src_id", "dst_id", "timestamp"], ["parent", "child"])


def scripts_of(events: DataFrame) -> DataFrame:
    """C11: (process, script, time) of script blocks whose process is known, as a child or a parent, by its guid."""
    started = _of(events, 1)
    known = started.where("process_guid <> ''").select(guid().alias("src_id")).unionByName(started.where("parent_process_guid <> ''").select(guid("parent_process_guid").alias("src_id"))).distinct()
    rows = _of(events, 4104).where("script_text <> '' AND process_guid <> ''").select(guid().alias("src_id"), F.concat_ws(":", "id", F.lit("sb")).alias("dst_id"), "timestamp").distinct()
    return rows.join(known, "src_id", "left_semi")


def connected_by_port(events: DataFrame) -> DataFrame:
    """One edge for each process, address, port and time."""
    rows = _of(events, 3).where("process_guid <> '' AND ip <> ''")
    return rows.select(guid().alias("src_id"), F.col("ip").alias("address"), "port", "timestamp").distinct()


def same_as(events: DataFrame, process: DataFrame) -> DataFrame:
    """A guid's process and the memory process of its host and pid with the smallest id."""
    guids = _of(events, 1).where("process_guid <> ''").select("hostname", n.to_int(F.col("process_id")).alias("pid"), guid().alias("src_id")).distinct()
    return guids.join(process.groupBy("hostname", "pid").agg(F.min("id").alias("dst_id")), ["hostname", "pid"]).select("src_id", "dst_id")


def created(events: DataFrame, ids: tuple[int, ...] = (11,)) -> DataFrame:
    """(process, file, time) of file events whose process is known by its guid."""
    known = _of(events, 1).where("process_guid <> ''").select(guid().alias("src_id")).distinct()
    rows = _of(events, *ids).where("target_filename <> ''").select(guid().alias("src_id"), n.file_id(F.col("hostname"), F.col("target_filename")).alias("file_id"), "timestamp").distinct()
    return rows.join(known, "src_id", "left_semi")


def describes(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Process events and executed files of one host with one name, in any case. The smaller side is aggregated first."""
    files = runs.select(F.upper("hostname").alias("host"), F.lower("name").alias("low"), "file_id").distinct()
    rows = _of(events, 1, 4688).select(F.upper("hostname").alias("host"), F.lower(n.basename(F.col("image"))).alias("low"), "id").where("low <> ''")
    return rows.join(files, ["host", "low"]).select("id", "file_id")


def prefetch_in_memory(runs: DataFrame, process: DataFrame) -> DataFrame:
    """C14: prefetched files and the processes of their host that have their name; counted first, so that a common name is one row a host."""
    held = process.groupBy("hostname", "name").agg(F.count("*").alias("processes"))
    return runs.where("source = 'prefetch'").select("hostname", "name", "file_id").join(held, ["hostname", "name"]).select("file_id", "processes")


def same_domain(found: DataFrame, dns: DataFrame) -> DataFrame:
    """URLs whose host part is a domain that was resolved on a host that holds the URL."""
    urls = found.where("type = 'URL'").select("hostname", F.col("id").alias("url_id"), n.url_host(F.col("value")).alias("domain")).distinct()
    return urls.join(dns.select("hostname", "domain").distinct(), ["hostname", "domain"]).select("url_id", "domain").distinct()


def tagged(files: DataFrame, **case) -> DataFrame:
    """Files with their score; sensitive by pattern or extension, interesting from 0.4."""
    score = n.match_score(F.col("path"), **case)
    tags = n.is_sensitive(F.translate("path", "\\", "/"), list(case.get("sensitive", ())), list(case.get("extensions", ())))
    return files.withColumn("score", score).withColumn("sensitive", F.when(tags | (F.col("score") >= 0.4), True)).withColumn("interesting", F.when(F.col("score") >= 0.4, True))


def ranked(rows: DataFrame, by: list[Column], order: list[Column]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
