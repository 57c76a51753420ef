"""Coverage statistics (V), correlation counts (C17) and verdict rules (IW03, IW08): each count is an aggregate of its own."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def events_of_host(events: DataFrame, host: str) -> DataFrame:
    """V01"""
    return events.where(F.col("hostname") == host).groupBy("event_id", "channel").agg(F.count("*").alias("cnt"))


def edge_counts(**edges: DataFrame) -> DataFrame:
    """Rows of each table, by its name; zero if empty."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("edge"), "n") for name, df in edges.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def host_edges(store, host: str) -> DataFrame:
    """The five kinds of edges of one host, each counted from that host's rows alone."""
    at = lambda name: store[name].where(F.col("hostname") == host)
    return edge_counts(spawned_sysmon=at("sysmon_spawned"), connected_sysmon=at("connected"), created_files=at("file_event").where("NOT deleted"), dns_resolved=at("dns"), registry_modified=at("modified"))


def guarded(metrics: dict[str, Callable[[], DataFrame]], timeout_s: float = 30.0) -> dict:
    """Each metric's rows by its name; one that fails or takes too long is null, and named in stats_skipped as name:why."""
    out: dict = {"stats_skipped": []}
    for name, make in metrics.items():
        tag, late = f"stats-{uuid.uuid4().hex}", threading.Event()
        try:
            df = make()
            context = df.sparkSession.sparkContext

            def stop(context=context, tag=tag, late=late) -> None:
                late.set()
                context.cancelJobsWithTag(tag)

            timer = threading.Timer(timeout_s, stop)
            context.addJobTag(tag)
            timer.start()
            try:
                out[name] = [r.asDict() for r in df.collect()]
            finally:
                timer.cancel()
                context.removeJobTag(tag)
        except Exception:
            out[name] = None
            out["stats_skipped"].append(f"{name}:{'timeout' if late.is_set() else 'error'}")
    return out


#: Where rows of an artifact show, as (table, condition).
SHOWN_BY = {
    "evtx": ("event", "true"), "pslist": ("process", "true"), "netscan": ("connected", "true"), "dlllist": ("module", "true"), "shimcache": ("executed", "source = 'shimcache'"), "prefetch": ("executed", "source = 'prefetch'"),
    "path_catalog": ("file", "source = 'filestat'"), "mft": ("file", "source = 'mft'"), "media_exif": ("media", "true"), "usb": ("usb", "true"), "bulk": ("feature", "true"),
}


def artifacts_loaded(store, host: str) -> DataFrame:
    """Artifacts of which the graph holds a row of the host; each probe ends at its first row."""
    probes = [store[table].where(F.col("hostname") == host).where(condition).limit(1).select(F.lit(artifact).alias("artifact")) for artifact, (table, condition) in SHOWN_BY.items()]
    return reduce(DataFrame.unionByName, probes)


def event_of(store, event_id: str) -> DataFrame:
    """One event by its id, which starts with its host."""
    found = store["event"].where((F.col("hostname") == event_id.split(":", 1)[0]) & (F.col("id") == event_id))
    return found.select("id", F.col("hostname").alias("host"), "event_id", "timestamp", "image")


def path_coverage(files: DataFrame, least: float = 0.4) -> DataFrame:
    """What stands beside the discovered paths: all paths, those that score, those of a catalog and their share."""
    cataloged = F.count_if(F.col("source").isin("filestat", "mft"))
    counts = files.agg(F.count("*").alias("total"), F.count_if(F.col("score") >= least).alias("hit_count"), cataloged.alias("cataloged"))
    return counts.withColumn("coverage_pct", percent(F.col("cataloged"), F.col("total")))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * 1000.0 / whole + 0.5) / 10).otherwise(0.0)


def file_statistics(files: DataFrame) -> DataFrame:
    """Files, those of a catalog, sensitive ones, and their share."""
    total, sensitive = F.count("*"), F.coalesce(F.sum(F.when(F.col("sensitive"), 1).otherwise(0)), F.lit(0))
    cataloged = F.coalesce(F.sum(F.when(F.col("source").isin("filestat", "mft"), 1).otherwise(0)), F.lit(0))
    return files.agg(total.alias("total"), cataloged.alias("cataloged"), sensitive.alias("sensitive")).withColumn("sensitive_pct", percent(F.col("sensitive"), F.col("total")))


def media_statistics(media: DataFrame) -> DataFrame:
    """V04"""
    return media.agg(F.count("*").alias("total"), F.count(F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), 1)).alias("with_gps"))


def executed_by_source(runs: DataFrame) -> DataFrame:
    """V06"""
    return runs.groupBy("source").agg(F.count("*").alias("cnt"), F.sum(F.when(F.col("confidence") == "corroborated_sysmon", 1).otherwise(0)).alias("corroborated"))


def host_totals(events: DataFrame, processes: DataFrame, spawned: DataFrame) -> DataFrame:
    """Events and processes of each host; healthy if events report spawns at all."""
    e = events.groupBy("hostname").agg(F.count("*").alias("events"))
    p = processes.groupBy("hostname").agg(F.count("*").alias("processes"))
    s = spawned.select(F.split_part("dst_id", F.lit(":"), F.lit(1)).alias("hostname")).groupBy("hostname").agg(F.count("*").alias("spawned"))
    out = e.join(p, "hostname", "full").join(s, "hostname", "left").na.fill(0, ["events", "processes", "spawned"])
    return out.withColumn("healthy", F.col("spawned") > 0)


def dedup_rollup(stats: DataFrame) -> DataFrame:
    """V09"""
    return stats.groupBy("event_id").agg(F.sum("kept").alias("kept"), F.sum("dropped").alias("dropped"))


def verdict(blocked: Column, rows: Column, strong: Column) -> Column:
    """IW03: verdict and confidence of a step by what its query found."""
    return (
        F.when(blocked, F.lit("not_assessed/low")).when(strong > 0, F.lit("supported/high")).when(rows > 0, F.lit("inconclusive/medium")).otherwise(F.lit("inconclusive/low"))
    )


#: Hosts that the answer to an unknown one names; "truncated" says whether there are more.
KNOWN_HOSTS = 1000


def host_summary(store, host: str) -> dict:
    """Totals, the 25 most frequent event ids and edge counts of one host; an unknown host gets the known ones."""
    if store["host"].where(F.col("hostname") == host).isEmpty():
        known = [r.hostname for r in store["host"].orderBy("hostname").limit(KNOWN_HOSTS + 1).collect()]
        return {"error": "unknown_host", "hostname": host, "available": known[:KNOWN_HOSTS], "truncated": len(known) > KNOWN_HOSTS}
    count = lambda name, column="hostname": store[name].where(F.col(column) == host).count()
    top = store["event"].where(F.col("hostname") == host).groupBy("event_id", "channel").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "event_id", "channel").limit(25)
    return {
        "hostname": host,
        "totals": {"processes": count("process"), "events": count("event")},
        "top_events": [r.asDict() for r in top.collect()],
        "edges": {"spawned": count("sysmon_spawned"), "connected": count("connected"), "created": count("created"), "dns": count("dns"), "registry": count("registry")},
    }
