"""Registered queries of the engine's own operators, and the SQL that an oracle engine runs beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelake.plans import oracle
from tracelake.plans.catalog import HUNTS
from tracelake.plans.store import loaded

Query = Callable[[SparkSession, str], DataFrame]

# H01..H32 by name
NUMBERS = ["summary", "suspicious_processes", "external_connections", "cloud_sync_connections", "process_tree", "sensitive_file_touch", "after_hours_logons", "usb_insertions", "photos_outside_home", "photos_during_vacation", "sync_volume_spike", "sysmon_file_touch", "sysmon_process_spawn", "dns_queries", "lateral_logons", "failed_logons", "registry_persistence", "service_install", "log_cleared", "powershell_script", "event_coverage", "findings_summary", "execution_corroboration", "prefetch_sensitive_paths", "shimcache_staging", "bulk_exfil_signals", "bulk_dns_corroboration", "psexec_lateral", "suspicious_execution_ancestry", "lateral_tool_reuse", "credential_tooling", "path_discover"]


def _hunt(name: str) -> Query:
    return lambda spark, sf_dir: loaded(spark, sf_dir).hunt(name)


def _table(name: str, *columns: str) -> Query:
    return lambda spark, sf_dir: loaded(spark, sf_dir)[name].select(*columns)


#: query: (table of the graph, its columns)
EDGES = {
    "l01_processes": ("process", "id hostname pid ppid name create_time"), "l02_spawned": ("spawned", "src_id dst_id source"), "l05_events": ("event", "id hostname event_id timestamp channel target_user logon_type ip port image"),
    "l06_executed": ("executed", "hostname file_id source path name timestamp shim_order run_count"), "l09_catalog": ("file", "id hostname path size source"), "l11_media": ("media", "id hostname path taken_at latitude longitude"), "l12_places": ("media", "id cell_lat cell_lon"),
    "l13_usb": ("usb", "id hostname device_id friendly_name vendor first_seen last_seen"), "l14_features": ("feature", "hostname type id value"), "pj01_spawned": ("sysmon_spawned", "src_id dst_id parent child pid timestamp"), "pj02_connected": ("connected", "src_id address process pid foreign_port protocol"),
    "pj03_modified": ("modified", "src_id dst_id process path details timestamp"), "pj04_files": ("file_event", "id deleted file_id path name timestamp"), "pj05_logged_in": ("logged_in", "sid hostname timestamp username logon_type ip"), "pj06_dns": ("dns", "id domain query image timestamp"),
    "pj07_registry": ("registry", "id path details"), "pj08_service": ("service", "id name image_path"), "pj09_script": ("script", "id text"), "pj10_wmi": ("wmi", "id consumer filter"), "pj11_reported": ("event", "id hostname"),
    "c04_created": ("created", "src_id file_id timestamp"), "c12_corroborated": ("executed", "file_id source confidence"), "c13_describes": ("describes", "id file_id"), "c15_same_domain": ("same_domain", "url_id domain"), "c18_tagged": ("file", "id sensitive interesting score"),
}


def queries() -> dict[str, Query]:
    from tracelake import more_queries

    found: dict[str, Query] = {f"h{i:02d}_{name}": _hunt(name) for i, name in enumerate(NUMBERS, 1)}
    found |= {key: _table(table, *columns.split()) for key, (table, columns) in EDGES.items()}
    return found | more_queries.queries()


def oracle_sql() -> dict[str, str]:
    from tracelake import more_queries

    found = {f"h{i:02d}_{name}": oracle.hunt(name) for i, name in enumerate(NUMBERS, 1)}
    found |= {key: oracle.with_tables(f"SELECT {', '.join(columns.split())} FROM {table}") for key, (table, columns) in EDGES.items()}
    return found | more_queries.oracle_sql()


assert set(NUMBERS) == set(HUNTS)
