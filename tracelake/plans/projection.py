"""Virtual artifacts: the driver's tables read as records of hosts. One text for both SQL engines, up to ``dialect``.

These stand in for artifact dumps, which are not at hand: every row of the tables takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels", "conversations")


def dialect(sql: str, spark: bool) -> str:
    """<<json props k>>, <<item embedding 0>> and <<list x>> in the engine's own words."""
    import re

    def put(m: re.Match) -> str:
        kind, rest = m[1], m[2]
        if kind == "json":
            column, key = rest.split()
            return f"get_json_object({column}, '$.{key}')" if spark else f"json_extract_string({column}, '$.{key}')"
        if kind == "item":
            column, at = rest.split()
            return f"{column}[{at}]" if spark else f"{column}[{int(at) + 1}]"
        return f"array_join(array_sort(collect_set({rest})), ',')" if spark else f"coalesce(string_agg(DISTINCT {rest}, ',' ORDER BY {rest}), '')"

    return re.sub(r"<<(\w+) (.*?)>>", put, sql)


VIEWS = {
    "v_event": """
        SELECT 'H' || cast(user_id % 7 AS string) AS hostname, event_id AS seq, cast(<<json props k>> AS int) AS k, user_id,
          CASE event_type
            WHEN 'click' THEN CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 11 WHEN 2 THEN 12 WHEN 3 THEN 13 WHEN 4 THEN 23 ELSE 7 END
            WHEN 'view' THEN 3 WHEN 'error' THEN 4625 WHEN 'signup' THEN 4624
            ELSE CASE event_id % 5 WHEN 0 THEN 7045 WHEN 1 THEN 4104 WHEN 2 THEN 104 WHEN 3 THEN 5861 ELSE 22 END END AS event_id,
          'H' || cast(user_id % 7 AS string) || ':' || cast(event_id AS string) AS id,
          cast(ts AS string) AS timestamp,
          CASE WHEN event_type IN ('click', 'view') THEN 'Sysmon' WHEN event_type IN ('error', 'signup') THEN 'Security' ELSE 'System' END AS channel,
          CASE WHEN event_id % 50 = 0 THEN '' ELSE 'u' || cast(user_id AS string) END AS target_user,
          CASE event_id % 3 WHEN 0 THEN '3' WHEN 1 THEN '10' ELSE '2' END AS logon_type,
          CASE user_id % 5 WHEN 0 THEN '10.0.0.' WHEN 1 THEN '172.16.0.' WHEN 2 THEN '172.20.0.' WHEN 3 THEN '93.184.0.' ELSE '127.0.0.' END || coalesce(<<json props k>>, '0') AS ip,
          cast(event_id % 1000 AS string) AS port, 'tcp' AS protocol,
          'C:/bin/' || CASE event_id % 9 WHEN 0 THEN 'cmd.exe' WHEN 1 THEN 'explorer.exe' WHEN 2 THEN 'a.exe' WHEN 3 THEN 'services.exe' WHEN 4 THEN 'tool.exe'
            WHEN 5 THEN 'svchost.exe' WHEN 6 THEN 'powershell.exe' WHEN 7 THEN 'OneDrive.exe' ELSE 'System' END AS image,
          'C:/bin/' || CASE user_id % 4 WHEN 0 THEN 'services.exe' WHEN 1 THEN 'x.exe' WHEN 2 THEN 'cmd.exe' ELSE 'long.exe' END AS parent_image,
          CASE WHEN event_id % 11 = 0 THEN '' ELSE 'g' || cast(event_id % 997 AS string) END AS process_guid,
          'g' || cast((event_id + 31) % 997 AS string) AS parent_process_guid,
          cast(event_id % 100 AS string) AS process_id,
          CASE WHEN event_id % 13 = 0 THEN '' ELSE 'C:/Users/u' || cast(user_id AS string) || '/f' || cast(event_id % 40 AS string) || '.docx' END AS target_filename,
          CASE user_id % 3 WHEN 0 THEN 'HKLM/Run/x' WHEN 1 THEN 'HKLM/System/Services/y' ELSE 'HKCU/Other/z' END || coalesce(<<json props k>>, '0') AS registry_key,
          'v' || coalesce(<<json props k>>, '0') AS registry_details,
          'Www.Ex' || cast(user_id % 20 AS string) || '.Com' AS query_name,
          CASE user_id % 6 WHEN 0 THEN 'PSEXEC' ELSE 'svc' || cast(user_id % 20 AS string) END AS service_name,
          CASE user_id % 7 WHEN 3 THEN 'C:/Windows/PSEXESVC.exe' ELSE 'C:/svc/' || cast(user_id % 5 AS string) || '.exe' END AS service_path,
          'Invoke-' || cast(user_id AS string) || ' ' || coalesce(<<json props k>>, '0') AS script_text,
          CASE event_id % 8 WHEN 0 THEN NULL ELSE 'WS' || cast(event_id % 3 AS string) END AS workstation,
          CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'C:' || chr(92) || 'tools' || chr(92) || 'r' || cast(user_id AS string) || '.exe "' || cast(event_id AS string) || '"' WHEN 2 THEN 'ping ' || cast(user_id AS string) ELSE 'u' || cast(user_id AS string) || chr(92) || 'run' END AS command_line,
          'consumer' || cast(user_id % 3 AS string) AS consumer, 'filter' || cast(user_id % 2 AS string) AS wmi_filter
        FROM events""",
    "v_pslist": """
        SELECT 'H' || cast(user_id % 7 AS string) AS hostname, event_id AS seq,
          cast(user_id AS int) * 1000 + cast(event_id % 100 AS int) AS pid, cast(user_id AS int) * 1000 + coalesce(cast(<<json props k>> AS int), 0) AS ppid,
          CASE event_id % 9 WHEN 0 THEN 'cmd.exe' WHEN 1 THEN 'explorer.exe' WHEN 2 THEN 'a.exe' WHEN 3 THEN 'services.exe' WHEN 4 THEN 'tool.exe'
            WHEN 5 THEN 'svchost.exe' WHEN 6 THEN 'powershell.exe' WHEN 7 THEN 'OneDrive.exe' ELSE 'System' END AS name,
          CASE WHEN event_id % 17 = 0 THEN NULL ELSE cast(ts AS string) END AS create_time
        FROM events""",
    "v_exec": """
        SELECT CASE WHEN p_partkey % 40 IN (6, 8) THEN 'H' || cast(s_suppkey % 7 AS string) ELSE n_name END AS hostname, CASE WHEN l_returnflag = 'A' THEN 'shimcache' ELSE 'prefetch' END AS source,
          CASE p_partkey % 3 WHEN 0 THEN 'C:/Users/x/' WHEN 1 THEN 'C:/Windows/' ELSE 'D:/Research/' END ||
          CASE p_partkey % 40 WHEN 0 THEN 'psexec.exe' WHEN 1 THEN 'Mimikatz.exe' WHEN 2 THEN 'hydrakatz.exe' WHEN 3 THEN 'net.exe' WHEN 4 THEN 'svchost.exe' WHEN 5 THEN 'mcfoo.exe'
            WHEN 6 THEN 'tool.exe' WHEN 8 THEN 'powershell.exe' WHEN 7 THEN 'notes.dll' ELSE replace(p_name, ' ', '_') || '.exe' END AS path,
          cast(min(l_shipdate) AS string) AS timestamp, 100 - l_linenumber AS shim_order, count(*) AS run_count, l_linenumber AS seq
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        GROUP BY 1, 2, 3, l_linenumber""",
    "v_catalog": """
        SELECT 'H' || cast(page_id % 5 AS string) AS hostname, page_id AS seq, substring(url, strpos(url, '://') + 3) AS path, cast(length(html) AS bigint) AS size,
          CASE WHEN page_id % 4 = 0 THEN 'mft' ELSE 'filestat' END AS source
        FROM pages""",
    "v_media": """
        SELECT 'H' || cast(vec_id % 3 AS string) AS hostname, vec_id AS seq,
          CASE vec_id % 4 WHEN 0 THEN 'C:/iCloud/' WHEN 1 THEN 'C:/OneDrive/' WHEN 2 THEN 'C:/google/' ELSE 'C:/pics/' END || cast(vec_id AS string) || '.jpg' AS path,
          cast(<<item embedding 0>> AS double) * 90 AS latitude, cast(<<item embedding 1>> AS double) * 180 AS longitude,
          coalesce(cast(o_orderdate AS string), '') AS taken_at
        FROM embeddings LEFT JOIN orders ON o_orderkey = vec_id""",
    "v_usb": "SELECT n_name AS hostname, s_name AS device_id, 'Stick ' || cast(s_suppkey % 9 AS string) AS friendly_name, 'V' || cast(s_suppkey % 4 AS string) AS vendor, '2018-01-' || cast(10 + s_suppkey % 20 AS string) AS first_seen, '2018-02-' || cast(10 + s_suppkey % 20 AS string) AS last_seen FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "v_feature": """
        SELECT n_name AS hostname, 'email' AS feature, 'User' || cast(c_custkey AS string) || '@Ex' || cast(c_custkey % 30 AS string) || '.com' AS value, c_name AS context FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT 'H' || cast(page_id % 5 AS string), 'url', url, substring(html, 1, 700) FROM pages
        UNION ALL SELECT 'H' || cast(user_id % 7 AS string), 'domain', 'www.ex' || cast(user_id % 20 AS string) || '.com/p' || cast(user_id AS string), event_type FROM events
        UNION ALL SELECT n_name, 'domain', 'www.ex' || cast(c_custkey % 20 AS string) || '.com/c' || cast(c_custkey AS string), c_name FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT n_name, 'other', 'C:/dump/' || s_name, '' FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "v_finding": """
        SELECT 'case:S' || cast(doc_id % 18 AS string) || ':' || cast(doc_id AS string) AS id, 'Hyp' || cast(quality AS string) AS hypothesis, CASE toxic WHEN 1 THEN 'supported' ELSE 'inconclusive' END AS verdict,
          CASE WHEN toxic = 1 AND quality = 1 THEN 'high' WHEN toxic = 1 THEN 'medium' ELSE 'low' END AS confidence, 'S' || cast(doc_id % 18 AS string) AS step_id, 'doc ' || cast(doc_id AS string) AS summary
        FROM labels""",
}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    import re

    sql = dialect(VIEWS[name], spark=True)
    used = {t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)}
    sql = re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], sql).replace("strpos(", "instr(")
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
