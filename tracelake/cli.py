"""Commands over a graph: of the driver's tables (--tables) or of a saved store (--store). Results are JSON on stdout."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from tracelake.operators import statistics
from tracelake.plans import planning, workflow
from tracelake.plans.catalog import HUNTS
from tracelake.plans.store import NAMES, GraphStore, projected
from tracelake.serving import Server
from tracelake.sources import raw
from tracelake.sources.findings import Findings


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracelake")
    p.add_argument("--tables")
    p.add_argument("--store")
    c = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple[str, dict]) -> None:
        sub = c.add_parser(name)
        for flag, kwargs in options:
            sub.add_argument(flag, **kwargs)

    tier, case_type = ("--tier", {"default": "triage"}), ("--case-type", {"default": "intrusion"})
    command("run", ("--out", {"required": True}), tier, ("--full", {"action": "store_true"}))
    command("discover", ("folder", {}))
    command("path-discover", ("--least", {"type": float, "default": 0.4}))
    command("probe", ("table", {}), ("--limit", {"type": int, "default": 5}))
    command("hunt", ("name", {}), ("--limit", {"type": int, "default": 100}))
    command("finding-record", ("--out", {"required": True}), ("--case", {"required": True}), ("--hypothesis", {"required": True}), ("--verdict", {"required": True}), ("--confidence", {"default": "medium"}), ("--step", {"required": True}), ("--summary", {"default": ""}))
    command("run-playbook", ("name", {}), case_type, ("--only", {"nargs": "*"}), ("--triage", {"action": "store_true"}), ("--tier", {"default": None}), ("--loaded", {"nargs": "*"}), ("--out", {}))
    command("list-playbook", ("name", {}))
    command("graph-export", ("table", {}), ("--limit", {"type": int, "default": 1000}))
    command("init-case", ("folder", {}), ("case_id", {}))
    command("plan", case_type, tier, ("--host", {"default": "HOST"}), ("--loaded", {"nargs": "*", "default": []}))
    command("load-tier", ("tier", {}), ("--host", {"default": None}), ("--out", {"required": True}), case_type, ("--profile", {"default": ""}), ("--manifests", {"default": None}), ("--force", {"action": "store_true"}))
    command("rebuild-case", ("--out", {"required": True}), ("--hunts", {"nargs": "*"}), ("--dry-run", {"action": "store_true"}), ("--playbook", {"default": "intrusion"}))
    return p


#: Tables that an artifact fills.
FILLS = {"pslist": ["process", "spawned"], "netscan": ["connected"], "evtx": ["event", "sysmon_spawned", "modified", "file_event", "logged_in", "dns", "registry", "service", "script", "wmi", "created", "module"], "dlllist": ["module"], "shimcache": ["executed"], "prefetch": ["executed", "describes"], "mft": ["file"], "path_catalog": ["file"], "usb": ["usb"], "media_exif": ["media"], "bulk": ["feature", "same_domain"]}


def _spark(store: GraphStore | None) -> SparkSession:
    from tracelake.session import session

    return store.spark if store else session("tracelake-cli")


def tables_of(artifacts: frozenset[str]) -> tuple[str, ...]:
    wanted = {"host", "finding"} | {t for a in artifacts for t in FILLS[a]}
    return tuple(n for n in NAMES if n in wanted)


def run(args: argparse.Namespace, store: GraphStore | None) -> dict | list:
    name = args.command
    if name == "list-playbook":
        return [vars(s) for s in workflow.playbook(args.name)]
    if name == "init-case":
        return [str(p) for p in workflow.scaffold(args.folder, args.case_id)]
    if name == "plan":
        plan = planning.tier_plan(args.tier, args.case_type)
        return {"tier": plan.tier, "artifacts": sorted(plan.artifacts), "packs": sorted(plan.packs or []), "steps": planning.steps_for(args.case_type, args.tier), "host": planning.host_plan(sorted(HUNTS), set(args.loaded), args.host), "notes": planning.coverage_notes(args.case_type, set(args.loaded), args.tier)}
    if name == "finding-record":
        row = {"id": f"{args.case}:{args.step}:{args.hypothesis}", "hypothesis": args.hypothesis, "verdict": args.verdict, "confidence": args.confidence, "step_id": args.step, "summary": args.summary}
        spark = _spark(store)
        Findings(spark, args.out).merge(spark.createDataFrame([row | {"case_id": args.case}]))
        return row
    if name == "load-tier" and args.manifests:
        spark = _spark(store)
        hosts = [m for m in raw.manifests(spark, args.manifests) if args.host in (None, m.hostname)]
        ledger, status = raw.load_hosts(spark, hosts, args.out, args.tier, args.case_type, force=args.force)
        return {"tier": args.tier, "artifacts": status, "tables": dict(ledger.report), "correlation": {r["metric"]: r["n"] for r in ledger.metrics().collect()}, "notes": {h.hostname: planning.coverage_notes(args.case_type, {a for host, a, s in status if host == h.hostname and s == "ready"}, args.tier) for h in hosts}}
    assert store is not None, "--tables or --store is needed"
    server = Server(store, list(NAMES))
    if name == "discover":
        from tracelake.sources.files import discover_hosts

        return discover_hosts(store.spark, args.folder)
    if name == "path-discover":
        rows = server._rows(lambda: store.hunt("path_discover", least=args.least), 200)
        counts = statistics.path_coverage(store["file"], args.least).first()
        return rows | {"hit_count": counts["hit_count"], "total": counts["total"], "coverage_pct": counts["coverage_pct"]}
    if name == "probe":
        df = store[args.table]
        return {"columns": df.columns, "rows": [r.asDict() for r in df.limit(args.limit).collect()]}
    if name == "hunt":
        return server.run_hunt(args.name, args.limit)
    if name == "graph-export":
        return server._rows(lambda: store[args.table], args.limit)
    if name == "run-playbook":
        loaded = set(args.loaded) if args.loaded is not None else set(planning.artifacts_of("full"))
        payloads, findings = workflow.run_playbook(args.name, lambda q: server.run_hunt(q).get("rows", []), loaded, args.case_type, only=set(args.only or ()), triage=args.triage, tier=args.tier)
        if args.out:
            workflow.write_investigation(args.out, payloads, findings)
        return {"steps": payloads, "findings": findings}
    if name in ("run", "load-tier"):
        plan = planning.tier_plan(args.tier, getattr(args, "case_type", "intrusion"), full=getattr(args, "full", False), override=getattr(args, "profile", ""))
        host = getattr(args, "host", None)
        store.only(host, plan.packs).save(args.out, tables_of(plan.artifacts))
        return {"tier": plan.tier, "host": host, "packs": sorted(plan.packs) if plan.packs is not None else None, "tables": tables_of(plan.artifacts)}
    hunts = planning.select_queries([s.query for s in workflow.playbook(args.playbook)], set(HUNTS), override=args.hunts)
    if args.dry_run:
        return {"plan": planning.rebuild_text(["all"], planning.tier_plan("full", "intrusion", full=True), hunts)}
    store.save(args.out, NAMES)
    saved = Server(GraphStore.load(store.spark, args.out), list(NAMES))
    results = {}
    for h in hunts:
        out = saved.run_hunt(h)
        results[h] = workflow.classify(0 if "rows" in out else 1, out.get("error") == "timeout", out.get("row_count"))
    return {"hunts": results, "tally": {k: list(results.values()).count(k) for k in ("pass", "empty", "fail", "timeout")}}


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    store = None
    if args.tables or args.store:
        from tracelake.session import session

        spark = session("tracelake-cli")
        store = projected(spark, args.tables) if args.tables else GraphStore.load(spark, args.store)
    print(json.dumps(run(args, store), default=str, indent=1))


if __name__ == "__main__":
    main()
