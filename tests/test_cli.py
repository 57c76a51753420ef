from tracelake import cli
from tracelake.plans.store import GraphStore
from tracelake.sources.findings import Findings


def command(store, *argv):
    return cli.run(cli._parser().parse_args(argv), store)


def test_commands_without_a_graph(spark, tmp_path):
    assert len(command(None, "list-playbook", "bulk_exfil")) == 2 and command(None, "init-case", str(tmp_path), "c1")
    plan = command(None, "plan", "--loaded", "pslist", "evtx")
    assert "summary" in plan["host"]["runnable"] and "usb_insertions" in plan["host"]["blocked"] and plan["notes"]
    for verdict in ("inconclusive", "supported"):
        command(None, "finding-record", "--case", "c", "--hypothesis", "H", "--verdict", verdict, "--step", "s", "--out", f"file://{tmp_path}/f")
    assert [(r["id"], r["case_id"], r["verdict"]) for r in Findings(spark, f"file://{tmp_path}/f").read().collect()] == [("c:s:H", "c", "supported")]


def test_commands_over_a_graph(spark, tmp_path):
    event = spark.createDataFrame([("e1", "H1", 1, "Sysmon", "t1"), ("e2", "H2", 104, "System", "t2")], "id string, hostname string, event_id int, channel string, timestamp string")
    file = spark.createDataFrame([("H1:a", "H1", "a", 0.7, "mft", True)], "id string, hostname string, path string, score double, source string, sensitive boolean")
    store = GraphStore(spark, {"event": event, "file": file})
    assert command(store, "hunt", "log_cleared")["row_count"] == 1 and command(store, "probe", "event")["columns"][0] == "id"
    assert command(store, "path-discover")["hit_count"] == 1 and command(store, "graph-export", "file")["row_count"] == 1
    store.save(str(tmp_path / "s"), ("event", "file"))
    again = GraphStore.load(spark, str(tmp_path / "s"))
    assert command(again, "hunt", "event_coverage")["row_count"] == 2
    out = command(store, "run-playbook", "intrusion", "--only", "event_coverage", "service_install", "--loaded", "evtx", "--out", str(tmp_path / "i"))
    assert [p["status"] for p in out["steps"]] == ["done", "done"] and (tmp_path / "i/index.md").exists()
    assert "summary" in command(store, "rebuild-case", "--out", "x", "--dry-run")["plan"] and set(cli.tables_of(frozenset({"usb"}))) == {"host", "usb", "finding"}
