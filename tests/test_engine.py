"""Normalizers, folds, the catalog on a hand-built graph, planning, playbooks, serving and streaming."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracelake.functions import normalize as n
from tracelake.operators import graph as g
from tracelake.operators import scoring
from tracelake.plans import catalog, oracle, planning, workflow
from tracelake.plans.store import GraphStore
from tracelake.serving import Server, clamp_limit, reject_write
from tracelake.sources import files


def value(spark, column, **given):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in given.items())) if given else spark.range(1)
    return df.select(column.alias("v")).first().v


def test_keys():
    assert [n.key_name(k) for k in ("PID", "ImageFileName", "Offset(V)", "File output", "GPSLatitude", "_id", "SomeKey")] == ["pid", "image_file_name", "offset_v", "file_output", "g_p_s_latitude", "_id", "some_key"]


@pytest.mark.parametrize(
    "raw, want",
    [(r"\Device\HarddiskVolume1\Windows\x.exe", r"C:\Windows\x.exe"), (r"\Device\HarddiskVolume7\x", r"C:\x"), ("C:/Users/foo/bar.exe", r"C:\Users\foo\bar.exe"), ('"D:\\\\a\\b"', r"D:\a\b"), ("/tmp", r"C:\tmp"), ("", ""), (None, "")],
)
def test_windows_paths(spark, raw, want):
    assert value(spark, n.windows_path(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(
    "raw, want",
    [("2018-08-31T00:00:00Z", "2018-08-31T00:00:00Z"), ("2018-08-31 01:02:03.5", "2018-08-31T01:02:03Z"), ("2018-08-31T01:02:03+05:00", "2018-08-31T01:02:03Z"), ("131808278432280264", "2018-09-07T21:04:03Z"), ("1535673600", "2018-08-31T00:00:00Z"), ("1535673600123", "2018-08-31T00:00:00Z"), ("12", ""), ("", ""), (None, ""), ("soon", "soon")],
)
def test_timestamps(spark, raw, want):
    assert value(spark, n.timestamp(F.lit(raw).cast("string"))) == want


def test_legacy_timestamps(spark):
    assert value(spark, n.timestamp(F.lit("131808278432280264"), legacy=True)) == ""


def test_event_xml(spark):
    xml = "<Event><System/><EventData><Data Name='A'>1</Data><Data Name='A'> 2 </Data><Data Name='B'></Data></EventData></Event>"
    assert value(spark, n.event_fields(F.lit(xml))) == {"A": "2"} and value(spark, n.event_fields(F.lit("<Event"))) == {}


def test_scores(spark):
    case = {"sensitive": ["*\\Documents\\*"], "extensions": ["dwg"], "keywords": ["alloy", "srl"], "aliases": {"high-entropy": ["hea"]}, "roots": ["C:/Work*"]}
    score = lambda p: value(spark, n.match_score(F.lit(p), **case))
    assert [score(p) for p in ("C:\\Users\\a\\Documents\\x", "C:/x.DWG", "C:\\new alloy.txt", "C:\\alloys", "C:/high-entropy/x", "C:\\Work1\\x", "C:\\Windows\\System32\\alloy", "", "C:/srl")] == [0.85, 0.85, 0.7, 0.55, 0.75, 0.4, 0, 0, 0]


def test_addresses_and_ids(spark):
    assert [value(spark, n.skip_address(F.lit(a))) for a in ("0.0.0.0", "*", "-", "127.0.0.9", "::1", "", "8.8.8.8")] == [True] * 6 + [False]
    assert value(spark, n.process_id(F.lit("h"), F.lit(4), F.lit("2018-01-01T00:00:00"))) == "h:4:2018-01-01T00-00-00" and value(spark, n.process_id(F.lit("h"), F.lit(4), F.lit(None).cast("string"))) == "h:4:unknown"
    assert value(spark, n.basename(F.lit("a\\b/c.exe"))) == "c.exe" and value(spark, n.coordinate(F.lit("0.0"), F.lit("3"))) == 3.0 and value(spark, n.rounded(F.lit(-2.5), 0)) == -2.0


def test_folds_do_not_depend_on_partitions(spark):
    rows = [(f"k{i % 7}", i, None if i % 3 else f"v{i}") for i in range(60)]
    results = []
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "k string, seq int, v string").repartition(seed + 1)
        results.append([sorted(map(tuple, f(df, ["k"], ["v"]).collect())) for f in (g.overwrite, g.keep_first, g.create_only)])
    assert results[0] == results[1] == results[2]
    last, first, created = map(dict, results[0])
    assert last["k4"] is None and first["k1"] == "v15" and created == {f"k{i}": (None if i % 3 else f"v{i}") for i in range(7)}


def test_first_seen(spark):
    rows = [("h", 4624, i, "u", "1", "3" if i < 3 else "10", "", "") for i in range(5)] + [("h", 4688, 9, "", "", "", "", ""), ("h", 4688, 10, "", "", "", "", ""), ("h2", 4624, 11, "u", "1", "3", "", "")]
    df = spark.createDataFrame(rows, "hostname string, event_id int, seq int, target_user string, ip string, logon_type string, image string, port string")
    assert sorted(r.seq for r in g.first_seen(df).collect()) == [0, 3, 9, 10, 11]
    assert g.dedup_statistics(df).first().asDict() == {"event_id": 4624, "seen": 6, "kept": 3, "dropped": 3}
    assert g.first_seen(df, {}).count() == 8


def test_pid_reuse_gives_every_parent(spark):
    df = spark.createDataFrame([("h", 1, 4, 0, "p", "t1"), ("h", 2, 4, 0, "p", "t2"), ("h", 3, 9, 4, "c", None), ("h", 4, None, 4, "x", "t")], "hostname string, seq int, pid int, ppid int, name string, create_time string")
    p = g.processes(df)
    assert {r.id for r in p.collect()} == {"h:4:t1", "h:4:t2", "h:9:unknown"}
    assert {(r.src_id, r.dst_id) for r in g.spawned_by_pid(p).collect()} == {("h:4:t1", "h:9:unknown"), ("h:4:t2", "h:9:unknown")}
    rows = spark.createDataFrame([("h", 4, "dll")], "hostname string, pid int, path string")
    assert g.newest_process(rows, p).first().process_id == "h:4:t2" and g.any_process(rows, p).first().process_id == "h:4:t1"


def ancestry(spark, *edges):
    """edges: (grandparent, parent, child) names."""
    ids = {name for e in edges for name in e}
    process = spark.createDataFrame([(i, "H", k, i.split("#")[0], "t") for k, i in enumerate(sorted(ids))], "id string, hostname string, pid int, name string, create_time string")
    spawned = spark.createDataFrame(sorted({p for e in edges for p in zip(e, e[1:])}), "src_id string, dst_id string")
    rows = GraphStore(spark, {"process": process, "spawned": spawned}).hunt("suspicious_execution_ancestry").collect()
    return {(r.parent.split(" ")[0], r.child.split(" ")[0]): (r.why, r.confidence) for r in rows}


def test_suspicious_ancestry(spark):
    assert ancestry(spark, ("explorer.exe", "a.exe", "cmd.exe"))[("a.exe", "cmd.exe")] == ("anomalous_short_parent_name,shell_spawned_by_nonsystem_parent", "high")
    found = ancestry(spark, ("services.exe", "x123.exe", "y.exe", "y.exe#2"))
    assert found[("x123.exe", "y.exe")] == ("service_stub_spawned_nonsystem_child", "high") and "self_replicating_process" in found[("y.exe", "y.exe")][0]
    assert ancestry(spark, ("services.exe", "svchost.exe", "svchost.exe#2")) == {} and ancestry(spark, ("services.exe", "worker.exe", "worker.exe#2")) == {}
    assert ancestry(spark, ("explorer.exe", "word1.exe", "cmd.exe"))[("word1.exe", "cmd.exe")] == ("shell_spawned_by_nonsystem_parent", "medium")


def test_tools(spark):
    rows = [("H1", "Tool.exe", "shimcache"), ("H2", "tool.exe", "prefetch"), ("H1", "alone.exe", "prefetch"), ("H1", "svchost.exe", "prefetch"), ("H2", "svchost.exe", "prefetch"), ("H1", "mcfoo.exe", "prefetch"), ("H2", "mcfoo.exe", "prefetch"), ("H1", "net.exe", "prefetch"), ("H2", "net.exe", "prefetch"), ("H1", "hydrakatz.exe", "shimcache"), ("H3", "psexesvc.exe", "prefetch"), ("H3", "psexec.dll", "prefetch")]
    executed = spark.createDataFrame(rows, "hostname string, name string, source string")
    service = spark.createDataFrame([("H1", "PSEXEC", None), (None, "x", "C:/PSEXESVC.exe"), ("H2", "other", "y")], "hostname string, name string, image_path string")
    store = GraphStore(spark, {"executed": executed, "service": service})
    assert [(r.indicator, r.host_count, r.hosts, r.evidence, r.category, r.confidence) for r in store.hunt("lateral_tool_reuse").collect()] == [("tool.exe", 2, "H1,H2", "prefetch", "unknown", "high"), ("net.exe", 2, "H1,H2", "prefetch", "dual_use", "medium")]
    assert [(r.indicator, r.matched_pattern, r.confidence) for r in store.hunt("credential_tooling").collect()] == [("hydrakatz.exe", "katz", "medium")]
    assert {(r.indicator, r.host, r.observations) for r in store.hunt("psexec_lateral").collect()} == {("psexesvc.exe", "H3", 1), ("PsExec service", "H1", 1), ("PsExec service", None, 1)}


def test_external_addresses(spark):
    connected = spark.createDataFrame([(a, a, "p.exe", 1, 443, "tcp") for a in ("172.20.0.1", "172.16.0.1", "10.1.1.1", "127.0.0.1", "", "93.1.1.1")], "src_id string, address string, process string, pid int, foreign_port int, protocol string")
    assert [r.ip for r in GraphStore(spark, {"connected": connected}).hunt("external_connections").collect()] == ["172.20.0.1", "93.1.1.1"]


def test_corroboration_and_null_order(spark):
    kind = "path string, file_id string, source string, confidence string, sensitive boolean, score double, interesting boolean, run_count long, timestamp string"
    executed = spark.createDataFrame([("a", "1", "prefetch", "corroborated_sysmon", True, None, None, 1, "t"), ("b", "2", "prefetch", "prefetch", None, 0.4, None, 1, "t"), ("c", "3", "prefetch", "prefetch", None, 0.39, True, 1, "t"), ("d", "4", "prefetch", "prefetch", None, 0.39, None, 1, "t")], kind)
    made, told = spark.createDataFrame([("2",), ("2",)], "file_id string"), spark.createDataFrame([("3",)], "file_id string")
    store = GraphStore(spark, {"executed": executed, "created": made, "describes": told})
    assert [r.path for r in store.hunt("execution_corroboration").collect()] == ["a", "b", "c"]
    assert [r.path for r in store.hunt("prefetch_sensitive_paths").collect()] == ["a", "b", "c"]
    with pytest.raises(KeyError):
        store.hunt("nothing")


def test_catalog_is_described_and_has_oracles():
    assert len(catalog.ABOUT) == 31 and len({c for c, _ in catalog.ABOUT.values()}) == 12 and set(catalog.ABOUT) | {"path_discover"} == set(catalog.HUNTS)
    assert all(oracle.hunt(name).startswith("WITH ") for name in catalog.HUNTS)


def test_sources(spark, tmp_path):
    p = tmp_path / "H1_pslist.json"
    p.write_text('{"PID": 4, "ImageFileName": "System"}\n\n{"PID": 8, "ImageFileName": null}\n')
    df = files.read_ndjson(spark, str(p), "PID int, ImageFileName string")
    assert [tuple(r) for r in df.collect()] == [(4, "System"), (8, None)] and df.columns == ["pid", "image_file_name"]
    assert [r.pid for r in files.read_ndjson(spark, str(p), "PID int", ordered=True).orderBy(*files.FILE_ORDER).collect()] == [4, 8]
    (tmp_path / "bad.json").write_text("{not json}\n")
    with pytest.raises(Exception):
        files.read_ndjson(spark, str(tmp_path / "bad.json"), "PID int").collect()
    (tmp_path / "empty.json").write_text("")
    states = [files.check_artifact(spark, str(tmp_path / f)).value for f in ("none.json", "empty.json", "H1_pslist.json")]
    assert states == ["missing", "empty", "ready"] and files.discover_hosts(spark, str(tmp_path)) == ["H1"]
    assert files.first_ready(spark, str(tmp_path / "empty.json"), str(p)) == str(p)
    files.write_table(df.withColumn("hostname", F.lit("H1")), str(tmp_path / "t"), "hostname")
    files.write_table(df.withColumn("hostname", F.lit("H2")), str(tmp_path / "t"), "hostname")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4


def test_planning():
    assert planning.artifacts_of("triage") < planning.artifacts_of("execution") < planning.artifacts_of("full") and len(planning.artifacts_of("full")) == 11
    assert planning.tier_for({"bulk"}) == "exfil" and planning.next_tier("full") is None and planning.tier_plan(None, "x").packs == frozenset(planning.TRIAGE_PACKS["intrusion"])
    with pytest.raises(ValueError):
        planning.tier_plan("none", "x")
    need = planning.dependency("bulk_dns_corroboration", {"evtx"})
    assert not need.satisfied and need.missing == ("bulk",) and need.tier == "exfil" and planning.dependency("psexec_lateral", {"evtx"}).satisfied
    assert planning.host_plan(["summary", "usb_insertions"], {"pslist"}, "H") == {"host": "H", "runnable": ["summary"], "blocked": ["usb_insertions"], "tier": "exfil"}
    assert planning.select_queries(["a", "b", "a", "findings_summary"], {"a", "b", "findings_summary"}) == ["a", "b"]
    assert planning.dedup_rules(None) == g.DEDUP_RULES and planning.dedup_rules({"enabled": False}) == {} and planning.dedup_rules({"rules": [{"event_id": 1, "keys": ["x"]}, 5, {"keys": ["y"]}]}) == {1: ["x"]}
    assert len(planning.event_ids(frozenset({"security_auth"}))) == 3 and set(planning.NEEDS) == set(catalog.HUNTS)
    assert planning.bulk_allowed("auto", "exfil") and not planning.bulk_allowed("auto", "triage") and planning.Case("c", hypotheses={"H": "open"}, enrichment={"bulk_extractor": "auto", "bulk_hypotheses": ["H"]}).bulk_enabled()
    assert len(planning.coverage_notes("intrusion", set(), "full")) == 6


def test_playbooks(tmp_path):
    assert [len(workflow.playbook(p)) for p in ("intrusion", "insider_ip_theft", "bulk_exfil")] == [18, 18, 2]
    assert all(s.query in catalog.HUNTS for p in workflow.PLAYBOOKS for s in workflow.playbook(p))
    rows = {"psexec_lateral": [{"confidence": "high"}], "lateral_tool_reuse": [{"confidence": "medium"}]}
    payloads, findings = workflow.run_playbook("intrusion", lambda q: rows.get(q, []), {"pslist", "evtx"})
    assert [p["status"] for p in payloads].count("blocked") == 2 and payloads[0]["investigation_step"] == "002_baseline_summary"
    assert {f["step_id"]: f["verdict"] for f in findings} == {"016_psexec_lateral": "supported", "017_suspicious_execution_ancestry": "inconclusive"}
    assert workflow.hypothesis_coverage(["LATERAL-MOVEMENT", "X"], findings) == {"LATERAL-MOVEMENT": "supported", "X": "not_assessed"}
    assert workflow.verdict({"hunt": {"rows": [1], "hit_count": 2}}) == ("supported", "high") and workflow.verdict({"hunt": {"rows": [{"a": 1}]}}) == ("inconclusive", "medium")
    assert (workflow.write_investigation(str(tmp_path), payloads, findings) / "index.md").read_text().count("\n") == 20 and workflow.scaffold(str(tmp_path), "c") and not workflow.scaffold(str(tmp_path), "c")
    assert [workflow.classify(*x) for x in ((0, True, 1), (1, False, 1), (0, False, 0), (0, False, 3))] == ["timeout", "fail", "empty", "pass"]


def test_scoring(spark):
    rows = spark.createDataFrame([("MALICE", "MALICE"), ("benign", "MALICE"), ("SUSPICION", "BENIGN"), ("ABSTAIN", "SUSPICION")], "verdict string, expected string")
    m = scoring.confusion(rows).first().asDict()
    assert (m["cases"], m["verdict_accuracy"], m["false_positive_rate"], m["fnr_mal"], m["over_calls"]) == (4, 0.25, 0.5, 0.5, 1)
    assert scoring.checks({"verdict_accuracy": 0.9, "fnr_mal": 0.5}) == {"verdict_accuracy": True, "false_positive_rate": None, "fnr_mal": False, "ttp_coverage": None}


REJECTED = ["INSERT INTO event VALUES (1)", "update event set a=1", "DELETE FROM event", "MERGE INTO event USING x ON 1=1", "DROP TABLE event", "CREATE TABLE x AS SELECT 1", "alter table event add x", "TRUNCATE TABLE event", "CACHE TABLE event", "SET spark.x=1", "ADD JAR 'x'", "sElEcT 1; dRoP TABLE event", "/* x */ DROP /* y */ TABLE event", "-- SELECT\nDROP VIEW event", "WITH a AS (SELECT 1) INSERT INTO event SELECT * FROM a", "SELECT * FROM parquet.`/etc`", "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT * FROM (SELECT * FROM secret)", "SELECT 1 WHERE EXISTS (SELECT 1 FROM csv.`/x`)", "WITH a AS (SELECT java_method('a','b')) SELECT * FROM a", "SELECT (SELECT max(x) FROM text.`/etc/passwd`)", "SHOW TABLES", "DESCRIBE event", "SELECT 1 UNION SELECT input_file_name()", "EXPLAIN SELECT 1"]
ALLOWED = ["SELECT id AS settings, 'DROP TABLE x; --' AS offset_ FROM event", "WITH a AS (SELECT id FROM event) SELECT count(*) AS created_n FROM a", "SELECT e.id FROM event e JOIN process p ON e.id = p.id WHERE e.id IN (SELECT id FROM event) ORDER BY 1", "select max(length(id)) as n from event having n > 0", "SELECT id FROM event WHERE id = :x"]


@pytest.fixture(scope="module")
def server(spark, tmp_path_factory):
    event = spark.createDataFrame([(f"e{i}", "H", 1, "c", None) for i in range(5)], "id string, hostname string, event_id int, channel string, note string")
    process = spark.createDataFrame([("e1", "x.exe", 1)], "id string, name string, pid int")
    return Server(GraphStore(spark, {"event": event, "process": process}), ["event", "process"], audit=str(tmp_path_factory.mktemp("audit") / "a.jsonl"))


@pytest.mark.parametrize("text", REJECTED)
def test_writes_and_paths_are_refused(server, text):
    assert server.query(text).get("error") in ("write_rejected", "query_error"), text
    assert reject_write(text) or server.query(text)["error"] == "write_rejected"


@pytest.mark.parametrize("text", ALLOWED)
def test_reads_run(server, text):
    assert "rows" in server.query(text, {"x": "e1"} if ":x" in text else None), server.query(text)


def test_serving(server):
    assert [clamp_limit(x) for x in (50, 0, 10_000, "nope", None)] == [50, 1, 1000, 100, 100] and len(server.list_hunts()) == 31
    out = server.run_hunt("event_coverage", 1)
    assert out["row_count"] == 1 and not out["truncated"] and server.query("SELECT id FROM event", limit=2)["truncated"]
    assert server.run_hunt("x")["error"] == "unknown_hunt" and server.get_event("e1")["event"] == {"id": "e1", "hostname": "H", "event_id": 1, "channel": "c"} and server.get_event("z")["error"] == "not_found"
    assert server.query("")["error"] == "bad_request" and server.query("SELECT nope FROM event")["error"] == "query_error"
    lines = [json.loads(x) for x in open(server.audit_path)]
    assert {"ts", "tool", "args", "duration_ms", "status", "row_count"} == set(lines[-1])


def test_stream_keeps_the_first(spark, tmp_path):
    from tracelake.streaming.dedup import first_seen

    kind = "hostname string, event_id int, seq int, target_user string, ip string, logon_type string, image string, port string"
    spark.createDataFrame([("h", 4624, i, "u", "1", "3", "", "") for i in range(4)] + [("h", 4688, 9, "", "", "", "", ""), ("h", 4688, 10, "", "", "", "", "")], kind).write.parquet(str(tmp_path / "in"))
    q = first_seen(spark.readStream.schema(kind).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert sorted(r.event_id for r in spark.table("seen").collect()) == [4624, 4688, 4688]
    finally:
        q.stop()


def test_executed_keeps_the_first_row_of_a_file_and_source(spark):
    rows = [("H", "prefetch", "C:/a.exe", "t2", 5, 7, 2), ("H", "prefetch", "C:/a.exe", "t1", 4, 9, 1), ("H", "shimcache", "C:/a.exe", None, 3, 1, 4), ("H", "shimcache", "C:/a.exe", "t9", 2, 1, 5), ("H", "prefetch", "", "t", 1, 1, 1), ("H", "prefetch", None, "t", 1, 1, 1)]
    df = spark.createDataFrame(rows, "hostname string, source string, path string, timestamp string, shim_order int, run_count long, seq long")
    got = sorted((r.source, r.timestamp, r.shim_order, r.run_count) for r in g.executed(df).collect())
    assert got == [("prefetch", "t1", None, 9), ("shimcache", None, 3, None)]
    assert g.duplicates(g.executed(df), ["file_id", "source"]).count() == 0 and g.duplicates(df, ["hostname", "source"]).count() == 2


def test_one_event_by_its_id_without_a_shuffle(spark):
    kind = "hostname string, seq long, id string, event_id int, target_user string, ip string, logon_type string, image string, port string"
    rows = [("H", i, f"H:{i}", e, "u", "1", "3", "a", "9") for i, e in enumerate([4624, 4624, 1, 3, 3, 1])] + [("G", 9, "G:9", 4624, "u", "1", "3", "a", "9")]
    df = spark.createDataFrame(rows, kind)
    kept = {r.id for r in g.first_seen(df).collect()}
    for r in rows:
        found = g.event_by_id(df, r[2])
        assert [x.id for x in found.collect()] == ([r[2]] if r[2] in kept else []) and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert g.event_by_id(df, "none").count() == 0


def test_spawns_and_scripts_by_time(spark):
    kind = "hostname string, seq long, id string, event_id int, process_guid string, parent_process_guid string, image string, parent_image string, timestamp string, script_text string"
    rows = [("H", 1, "H:1", 1, "c", "p", "C:/c.exe", "C:/p.exe", "t1", ""), ("H", 2, "H:2", 1, "c", "p", "C:/d.exe", "C:/p.exe", "t1", ""), ("H", 3, "H:3", 1, "c", "p", "C:/d.exe", None, "t2", ""), ("H", 4, "H:4", 4104, "p", "", "", "", "t3", "x"), ("H", 5, "H:5", 4104, "unknown", "", "", "", "t3", "x")]
    df = spark.createDataFrame(rows, kind)
    assert sorted((r.timestamp, r.parent, r.child) for r in g.spawned_at(df).collect()) == [("t1", "C:/p.exe", "C:/c.exe"), ("t2", None, "C:/d.exe")]
    assert [(r.src_id, r.dst_id) for r in g.scripts_of(df).collect()] == [("H:guid:p", "H:4:sb")]


def test_guarded_statistics_and_probes(spark):
    from tracelake.operators import statistics as v
    from tracelake.plans.store import GraphStore

    one = spark.createDataFrame([("H1", "H1:1")], "hostname string, id string")
    got = v.guarded({"fine": lambda: one, "wrong": lambda: one.select("nothing"), "slow": lambda: spark.range(10**13).selectExpr("sum(xxhash64(id) % 7) AS s")}, timeout_s=2)
    assert got["fine"] == [{"hostname": "H1", "id": "H1:1"}] and got["wrong"] is None and got["slow"] is None and got["stats_skipped"] == ["wrong:error", "slow:timeout"]
    none = spark.createDataFrame([], "hostname string, source string")
    tables = dict.fromkeys(("event", "process", "connected", "module", "media", "usb", "feature", "executed", "file"), none) | {"event": one, "executed": spark.createDataFrame([("H1", "prefetch"), ("H2", "shimcache")], "hostname string, source string")}
    assert {r.artifact for r in v.artifacts_loaded(GraphStore(spark, tables), "H1").collect()} == {"evtx", "prefetch"} and v.artifacts_loaded(GraphStore(spark, tables), "H3").isEmpty()


def test_parameters_of_hunts(spark):
    from tracelake.plans.store import GraphStore

    files = spark.createDataFrame([("a", "p", 0.3, "mft", None), ("b", "q", 0.5, "mft", True)], "id string, path string, score double, source string, sensitive boolean")
    store = GraphStore(spark, {"file": files})
    assert [r.id for r in store.hunt("path_discover").collect()] == ["b"] and [r.id for r in store.hunt("path_discover", least=0.2).collect()] == ["b", "a"]
    with pytest.raises(KeyError):
        store.hunt("path_discover", most=1)
    with pytest.raises(KeyError):
        store.hunt("none")


def test_step_ids(spark):
    names = {"step_4_dns": "004_dns", "007_x": "007_x", "Alpha": "001_alpha", "step 12": "012_step", "Step12__a b_": "012_a_b", "find 3 things": "003_find_3_things", "": "001_step", "__": "001_step", " Step 3  x ": "003_x", "step²": "001_step²", "step1234_y": "1234_y"}
    rows = spark.createDataFrame([(k,) for k in names], "name string").select("name", n.step_id(F.col("name")).alias("id")).collect()
    assert {r["name"]: r["id"] for r in rows} == names


def test_packs_follow_the_case():
    assert planning.packs_of("full", "intrusion") is None and planning.packs_of("exfil", "account_compromise") == {"security_auth"}
    assert planning.packs_of("triage", "intrusion", "legacy_intrusion") == planning.packs_of("filesystem", "legacy_intrusion") == {"security_auth", "system_services"}
    assert planning.packs_of("execution", "none", "unknown") == frozenset(planning.TRIAGE_PACKS["intrusion"])


def test_correlation_stays_on_its_host(spark):
    runs = spark.createDataFrame([("A", "A:x", "prefetch", "x.exe"), ("B", "B:x", "prefetch", "x.exe"), ("A", "A:x", "shimcache", "x.exe")], "hostname string, file_id string, source string, name string")
    process = spark.createDataFrame([("A", "x.exe"), ("A", "x.exe"), ("C", "x.exe")], "hostname string, name string")
    assert [tuple(r) for r in g.prefetch_in_memory(runs, process).collect()] == [("A:x", 2)]
    urls = spark.createDataFrame([("A", "URL", "u", "http://d.com/a"), ("B", "URL", "v", "d.com/b"), ("A", "File", "w", "d.com")], "hostname string, type string, id string, value string")
    dns = spark.createDataFrame([("A", "d.com"), ("A", "d.com"), ("C", "d.com")], "hostname string, domain string")
    assert [tuple(r) for r in g.same_domain(urls, dns).collect()] == [("u", "d.com")]


def test_exports_and_retries():
    from tracelake.plans import export
    from tracelake.serving import retried

    rows = [{"a": f"x|{i}", "b": None if i == 1 else i} for i in range(20)]
    table = export.markdown_table(rows)
    assert table.count("\n") == 19 and "x\\|0" in table and "5 more rows" in table and export.markdown_table([]) == "_no rows_\n"
    assert export.diagram(rows, "a", "b").count("-->") == 12 and "```mermaid" in export.document("t", rows, "a", "b")
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "done"

    assert retried(flaky, first_wait_s=0) == "done" and len(calls) == 3
    with pytest.raises(ConnectionError):
        retried(lambda: (_ for _ in ()).throw(ConnectionError()), tries=2, first_wait_s=0)


def test_loaded_graph_is_written_once(spark, tmp_path):
    from tracelake.plans import store

    (events := spark.read.parquet("/root/testdata/sf0.001/events.parquet")).write.parquet(f"{tmp_path}/events.parquet")
    a, b = (store.loaded(spark, str(tmp_path))["event"] for _ in range(2))
    assert a.inputFiles() == b.inputFiles() and a.count() <= events.count() and "hostname" in a.columns
    assert sorted(map(tuple, a.select("id", "event_id").collect())) == sorted(map(tuple, store.projected(spark, str(tmp_path))["event"].select("id", "event_id").collect()))
