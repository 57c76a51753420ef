"""The same graph in plain SQL, independent of the DataFrame builders: common table expressions for an oracle engine."""

from __future__ import annotations

import re

from tracelake.plans.catalog import HUNTS, PARAMETERS
from tracelake.plans.projection import VIEWS, dialect

_FIRST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM ({rows})) WHERE rn = 1"


def _last(keys: str, rows: str) -> str:
    return _FIRST.format(keys=keys, order="seq DESC", rows=rows)


BASE = r"regexp_extract({0}, '[^\\/]*$', 0)"
GUID = "hostname || ':guid:' || process_guid"


def _score(path: str, sensitive: list[str], extensions: list[str], words: list[str], aliases: list[str], roots: list[str], excluded: list[str]) -> str:
    n, low = f"replace({path}, '\\', '/')", f"lower(replace({path}, '\\', '/'))"
    match = lambda p: f"regexp_matches({n}, '(?is){p}')"
    ex = [*excluded, "windows/winsxs", "program files/windowsapps", "windows/system32", "windows/servicing"]
    sens = " OR ".join([match(p) for p in sensitive] + [f"{low} LIKE '%.{x}'" for x in extensions]) or "false"
    parts = [f"CASE WHEN {sens} THEN 0.85 ELSE 0.0 END"]
    parts += [f"CASE WHEN regexp_matches({low}, '(^|[^a-z0-9]){w}($|[^a-z0-9])') THEN 0.7 WHEN contains({low}, '{w}') THEN 0.55 ELSE 0.0 END" for w in words]
    parts += [f"CASE WHEN contains({low}, '{a}') THEN 0.75 ELSE 0.0 END" for a in aliases]
    parts += [f"CASE WHEN {match(r)} THEN 0.4 ELSE 0.0 END" for r in roots]
    return f"CASE WHEN {' OR '.join(f'contains({low}, {chr(39)}{e}{chr(39)})' for e in ex)} THEN 0.0 ELSE cast(greatest(0.0, {', '.join(parts)}) AS double) END", sens


_FILE_SCORE, _FILE_SENSITIVE = _score("path", [".*/en/.*9.*"], ["7"], ["research", "blog"], ["pills", "cheap-pills"], [r"www\..*"], ["adult"])
_RUN_SCORE, _RUN_SENSITIVE = _score("path", [".*/users/.*9.*"], [], ["research"], [], [], [])

CTES = {
    **VIEWS,
    "event": """
        SELECT * FROM v_event WHERE event_id NOT IN (3, 4624) UNION ALL
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY hostname, target_user, ip, logon_type ORDER BY seq) AS rn FROM v_event WHERE event_id = 4624) WHERE rn = 1 UNION ALL
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY hostname, image, ip, port ORDER BY seq) AS rn FROM v_event WHERE event_id = 3) WHERE rn = 1""",
    "host": "SELECT hostname FROM v_event UNION SELECT hostname FROM v_catalog",
    "process": "SELECT id, hostname, pid, ppid, name, create_time FROM (" + _last("id", "SELECT hostname || ':' || pid || ':' || replace(coalesce(create_time, 'unknown'), ':', '-') AS id, hostname, pid, ppid, name, coalesce(create_time, 'unknown') AS create_time, seq FROM v_pslist") + ")",
    "module": "SELECT DISTINCT hostname, process_guid, target_filename FROM v_event WHERE event_id = 7 AND process_guid <> ''",
    "connected": "SELECT src_id, address, process, pid, foreign_port, protocol, hostname FROM (" + _last("src_id, address", f"SELECT seq, hostname, {GUID} AS src_id, ip AS address, {BASE.format('image')} AS process, cast(process_id AS int) AS pid, cast(port AS int) AS foreign_port, protocol FROM event WHERE event_id = 3 AND process_guid <> '' AND ip NOT LIKE '127.%'") + ")",
    "spawned": "SELECT DISTINCT p.id AS src_id, c.id AS dst_id, 'memory' AS source, cast(NULL AS string) AS timestamp FROM process c JOIN process p ON p.hostname = c.hostname AND p.pid = c.ppid WHERE c.ppid > 0",
    "sysmon_spawned": "SELECT src_id, dst_id, parent, child, pid, timestamp FROM (" + _last("src_id, dst_id", f"SELECT seq, hostname || ':guid:' || parent_process_guid AS src_id, {GUID} AS dst_id, {BASE.format('parent_image')} AS parent, {BASE.format('image')} AS child, cast(process_id AS int) AS pid, timestamp FROM v_event WHERE event_id = 1 AND process_guid <> '' AND parent_process_guid <> ''") + ")",
    "modified": "SELECT src_id, dst_id, process, path, details, timestamp FROM (" + _last("src_id, dst_id", f"SELECT seq, {GUID} AS src_id, hostname || ':' || registry_key AS dst_id, {BASE.format('image')} AS process, registry_key AS path, registry_details AS details, timestamp FROM v_event WHERE event_id IN (12, 13) AND process_guid <> '' AND registry_key <> ''") + ")",
    "file_event": f"SELECT id, hostname, event_id = 23 AS deleted, hostname || ':' || target_filename AS file_id, target_filename AS path, {BASE.format('target_filename')} AS name, timestamp, image FROM v_event WHERE event_id IN (11, 23) AND target_filename <> ''",
    "logged_in": "SELECT sid, hostname, timestamp, username, logon_type, ip FROM (" + _last("sid, hostname, timestamp", "SELECT seq, hostname || ':' || target_user AS sid, target_user AS username, hostname, timestamp, logon_type, ip FROM event WHERE event_id = 4624 AND target_user <> ''") + ")",
    "dns": "SELECT id, hostname, lower(query_name) AS domain, query_name AS query, image, timestamp, channel FROM v_event WHERE event_id = 22 AND query_name <> ''",
    "registry": "SELECT id, hostname, registry_key AS path, registry_details AS details, timestamp, image FROM v_event WHERE event_id IN (12, 13, 14) AND registry_key <> ''",
    "service": "SELECT id, hostname, service_name AS name, service_path AS image_path, timestamp, image FROM v_event WHERE event_id = 7045 AND service_name <> ''",
    "script": "SELECT id, hostname, substring(script_text, 1, 2000) AS text, timestamp, image, channel FROM v_event WHERE event_id = 4104 AND script_text <> ''",
    "wmi": "SELECT id, hostname, consumer, wmi_filter AS filter, timestamp, image FROM v_event WHERE event_id = 5861 AND consumer <> ''",
    "created": f"SELECT DISTINCT {GUID} AS src_id, hostname || ':' || target_filename AS file_id, timestamp FROM v_event WHERE event_id = 11 AND target_filename <> '' AND {GUID} IN (SELECT {GUID} FROM v_event WHERE event_id = 1 AND process_guid <> '')",
    "file": f"SELECT *, CASE WHEN ({_FILE_SENSITIVE}) OR score >= 0.4 THEN true END AS sensitive, CASE WHEN score >= 0.4 THEN true END AS interesting FROM (SELECT id, hostname, path, size, source, {BASE.format('path')} AS name, {_FILE_SCORE} AS score FROM ("
    + _FIRST.format(keys="id", order="seq", rows="SELECT hostname || ':' || path AS id, hostname, path, size, source, seq FROM v_catalog WHERE length(path) >= 2") + "))",
    "executed": f"SELECT r.*, CASE WHEN file_id IN (SELECT file_id FROM created) THEN 'corroborated_sysmon' ELSE source END AS confidence FROM (SELECT *, CASE WHEN ({_RUN_SENSITIVE}) OR score >= 0.4 THEN true END AS sensitive, CASE WHEN score >= 0.4 THEN true END AS interesting FROM (SELECT hostname, hostname || ':' || path AS file_id, source, path, {BASE.format('path')} AS name, timestamp, CASE WHEN source = 'shimcache' THEN cast(shim_order AS int) END AS shim_order, CASE WHEN source = 'prefetch' THEN run_count END AS run_count, {_RUN_SCORE} AS score FROM (" + _FIRST.format(keys="hostname, path, source", order="seq", rows="SELECT * FROM v_exec WHERE path <> ''") + "))) r",
    "describes": f"SELECT e.id, f.file_id FROM (SELECT id, upper(hostname) AS host, lower({BASE.format('image')}) AS low FROM v_event WHERE event_id IN (1, 4688)) e JOIN (SELECT DISTINCT upper(hostname) AS host, lower({BASE.format('path')}) AS low, hostname || ':' || path AS file_id FROM v_exec) f USING (host, low) WHERE low <> ''",
    "described": "SELECT file_id, count(*) AS events FROM describes GROUP BY file_id",
    "media": "SELECT hostname || ':media:' || path AS id, hostname, path, taken_at, latitude, longitude, floor(latitude * 1000 + 0.5) / 1000 AS cell_lat, floor(longitude * 1000 + 0.5) / 1000 AS cell_lon FROM v_media",
    "usb": "SELECT hostname || ':usb:' || device_id AS id, hostname, device_id, friendly_name, vendor, first_seen, last_seen FROM v_usb WHERE device_id <> ''",
    "feature": """
        SELECT hostname, type, id, min_by(value, value) AS value, min(context) AS context FROM (
          SELECT hostname, type, CASE type WHEN 'File' THEN value ELSE substring(lower(value), 1, 512) END AS id, value, substring(context, 1, 500) AS context, min(value) OVER (PARTITION BY hostname, type, CASE type WHEN 'File' THEN value ELSE substring(lower(value), 1, 512) END) AS least
          FROM (SELECT hostname, CASE WHEN feature = 'email' THEN 'EmailAddress' WHEN feature IN ('url', 'domain') THEN 'URL' WHEN contains(value, '/') THEN 'File' END AS type, trim(value) AS value, context FROM v_feature WHERE value <> '') WHERE type IS NOT NULL)
        WHERE value = least GROUP BY hostname, type, id""",
    "same_domain": "SELECT DISTINCT u.url_id, d.domain FROM (SELECT DISTINCT hostname, id AS url_id, lower(split_part(CASE WHEN contains(value, '://') THEN split_part(value, '://', 2) ELSE value END, '/', 1)) AS domain FROM feature WHERE type = 'URL') u JOIN (SELECT DISTINCT hostname, domain FROM dns) d USING (hostname, domain)",
    "finding": "SELECT * FROM v_finding",
}


def with_tables(sql: str) -> str:
    """sql over tables of the graph, with the expressions it needs, in order."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b\w+\b", text)):
            if name in CTES and name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+\(?{name}\b", text):
                add(CTES[name])
                if name not in needed:
                    needed.append(name)

    body = dialect(re.sub(r"\{(\w+)\}", r"\1", sql), spark=False)
    add(body)
    heads = ", ".join(f"{name} AS ({dialect(CTES[name], spark=False)})" for name in needed)
    body = body.strip()
    return f"WITH {heads}, {body[5:]}" if body.upper().startswith("WITH ") and heads else f"WITH {heads} {body}" if heads else body


def hunt(name: str) -> str:
    sql = HUNTS[name]
    for key, value in PARAMETERS.get(name, {}).items():
        sql = re.sub(rf":{key}\b", f"'{value}'" if isinstance(value, str) else str(value), sql)
    return with_tables(sql)
