"""Raw artifacts: line numbers for any split size, lines set aside, and hosts from manifest to graph."""

import json

import pytest

from tracelake.sources import raw
from tracelake.sources.raw import Manifest, RawTables


def xml(**data):
    return "<Event><System><EventID Qualifiers='1'>1</EventID></System><EventData>" + "".join(f"<Data Name='{k}'>{v}</Data>" for k, v in data.items()) + "</EventData></Event>"


@pytest.fixture()
def hosts(tmp_path):
    made = []
    for host in ("A", "B"):
        folder = tmp_path / host
        (folder / "evtx").mkdir(parents=True)
        (folder / f"{host}_pslist.json").write_text("\n".join(json.dumps(r) for r in ({"PID": 4, "PPID": 0, "ImageFileName": "System"}, {"PID": 8, "PPID": 4, "ImageFileName": "a.exe", "CreateTime": "2020-01-01"}, {"PID": None})) + "\n")
        lines = [
            {"event_identifier": 1, "record_number": 7, "datetime": "2020-01-01T00:00:00Z", "source": "Sysmon", "xml_string": xml(Image="C:/x/a.exe", ProcessGuid="g1", ParentProcessGuid="g0", ParentImage="C:/x/p.exe", ProcessId="8", CommandLine="C:\\t\\a.exe")},
            {"xml_string": xml(Image="C:/x/b.exe", ProcessGuid="g2", ParentProcessGuid="g1", ParentImage="C:/x/a.exe", ProcessId="9"), "record_number": 8},
            {"event_identifier": 999, "xml_string": "<Event"},
            {"event_identifier": 5861, "record_number": 9, "xml_string": xml(Consumer="c")},
        ]
        (folder / "evtx" / "1.json").write_text(json.dumps(lines[0]) + "\n\n{broken\n")
        (folder / "evtx" / "2.json").write_text("\n".join([*(json.dumps(r) for r in lines[1:]), "[1, 2]", "3"]))
        (folder / "m.json").write_text(json.dumps({"hostname": host, "data_dir": f"file://{folder}", "artifacts": {"pslist": "{hostname}_pslist.json", "evtx": "{data_dir}/evtx", "usb": "none.json"}, "comment": 1}))
        made.append(str(folder / "m.json"))
    return str(tmp_path / "*" / "m.json")


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    for name, count in (("b.json", 900), ("a.json", 700), ("c.json", 1)):
        (tmp_path / name).write_text("\n".join(f'{{"n": {i}, "pad": "{"x" * (i % 50)}"}}' if i % 10 else "" for i in range(count)))
    want = [(f, i + 1, t + i + 1) for f, count, t in (("a.json", 700, 0), ("b.json", 900, 700), ("c.json", 1, 1600)) for i in range(count)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "5000b", "700b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            lines = raw.numbered(spark, [f"file://{tmp_path}"])
            got = sorted((r["file"].rsplit("/", 1)[1], r["line"], r["seq"]) for r in lines.collect())
            assert [g for g in got if g[0] != "c.json"] == [w for w in want if w[0] != "c.json"]
            by_line = {(r["file"].rsplit("/", 1)[1], r["line"]): r["text"] for r in lines.collect()}
            assert all(by_line["b.json", i + 1] == (f'{{"n": {i}, "pad": "{"x" * (i % 50)}"}}' if i % 10 else "") for i in range(900))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert raw.numbered(spark, []).collect() == []


def test_hosts_from_manifest_to_graph(spark, tmp_path, hosts):
    found = raw.manifests(spark, hosts)
    assert [m.hostname for m in found] == ["A", "B"] and found[0].path("pslist").endswith("/A/A_pslist.json")
    ledger, status = raw.load_hosts(spark, found, f"file://{tmp_path}/graph", "triage")
    assert ("A", "netscan", "missing") in status and ("B", "evtx", "ready") in status
    spawned = sorted((r["src_id"], r["dst_id"], r["child"], r["pid"]) for r in ledger.table("sysmon_spawned").collect())
    assert spawned == [(f"{h}:guid:g{i}", f"{h}:guid:g{i + 1}", "ab"[i] + ".exe", 8 + i) for h in "AB" for i in range(2)]
    events = ledger.table("event").collect()
    assert sorted((r["id"], r["event_id"]) for r in events) == [("A:7", 1), ("A:8", 1), ("B:7", 1), ("B:8", 1)]  # 5861 is of a pack that triage leaves out
    assert sorted((r["hostname"], r["pid"], r["name"]) for r in ledger.table("process").collect()) == [(h, p, c) for h in "AB" for p, c in ((4, "System"), (8, "a.exe"))]
    lost = sorted((r["artifact"], r["hostname"], r["file"].rsplit("/", 1)[1], r["line"], r["text"]) for r in ledger.table("rescued").collect())
    assert lost == [("evtx", h, f, i, t) for h in "AB" for f, i, t in (("1.json", 3, "{broken"), ("2.json", 4, "[1, 2]"), ("2.json", 5, "3"))]
    assert dict(map(tuple, ledger.metrics().collect()))["spawned_sysmon"] == 4
    again, _ = raw.load_hosts(spark, found, f"file://{tmp_path}/graph", "triage")
    assert {s for _, s in again.report} == {"skipped"}
    full, _ = raw.load_hosts(spark, found, f"file://{tmp_path}/graph", "full")
    assert ("event", "loaded") in full.report and 5861 in {r["event_id"] for r in full.table("event").collect()}


def test_strict_reading_and_missing_artifacts(spark, tmp_path, hosts):
    found = raw.manifests(spark, hosts)
    with pytest.raises(Exception, match="no JSON object in .* line [345]"):
        RawTables(spark, found[:1], frozenset({"evtx"}), strict=True).view("v_event").collect()
    (tmp_path / "B" / "B_pslist.json").unlink()
    with pytest.raises(FileNotFoundError, match="pslist of B"):
        raw.load_hosts(spark, found, f"file://{tmp_path}/other")
    for name in ("v_exec", "v_catalog", "v_usb", "v_media"):
        assert RawTables(spark, found, frozenset()).view(name).collect() == []
    assert Manifest("H", "/d", artifacts={"x": "/abs/x", "y": "y", "z": "s3a://b/z"}).path("y") == "/d/y"
