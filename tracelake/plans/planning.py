"""What to load and what can run (PL, V10, V11, D02, D04, L15): plain rules over fixed dictionaries, on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Artifacts that each tier adds, in order; "full" is all of them.
TIER_ADDS = {"triage": ["pslist", "netscan", "evtx"], "execution": ["dlllist", "shimcache", "prefetch"], "filesystem": ["mft", "path_catalog"], "exfil": ["usb", "media_exif", "bulk"], "full": []}
TIERS = tuple(TIER_ADDS)
# Event packs by kind of case.
TRIAGE_PACKS = {
    "intrusion": ["sysmon_core", "security_auth", "system_services", "powershell"], "hybrid": ["sysmon_core", "security_auth", "system_services", "powershell"],
    "account_compromise": ["security_auth"], "insider_ip_theft": ["sysmon_core", "security_auth", "system_services"], "legacy_intrusion": ["security_auth", "system_services"],
}
# Fixed values: (pack, source, event id) of the base profile.
EVENTS = [
    *(("sysmon_core", "Microsoft-Windows-Sysmon", e) for e in (1, 3, 5, 7, 8, 10, 11, 22, 23, 12, 13, 14)),
    *(("security_auth", "Microsoft-Windows-Security-Auditing", e) for e in (4624, 4625, 4688)),
    *(("security_account", "Microsoft-Windows-Security-Auditing", e) for e in (4720, 4732)),
    ("system_services", "Service Control Manager", 7045), ("system_services", "Microsoft-Windows-Eventlog", 104), ("powershell", "Microsoft-Windows-PowerShell", 4104), ("wmi", "Microsoft-Windows-WMI-Activity", 5861),
]
# Steps that the first two tiers of a case unlock.
TRIAGE_STEPS = {"intrusion": ["baseline_summary", "event_coverage", "sysmon_spawn", "external_connections", "dns_c2", "lateral_logons", "failed_logons"]}
EXECUTION_STEPS = {
    "intrusion": ["psexec_lateral", "suspicious_execution_ancestry", "lateral_tool_reuse", "credential_tooling"],
    "insider_ip_theft": ["baseline_summary", "event_coverage", "cloud_sync_connections", "external_connections", "after_hours_logons", "DNS-EGRESS"],
    "account_compromise": ["baseline_summary", "event_coverage", "failed_logons", "lateral_logons", "after_hours_logons"],
}
# Fixed values: (all of, any of) the artifacts that a query needs.
NEEDS: dict[str, tuple[list[str], list[str]]] = {
    "summary": (["pslist"], []), "event_coverage": (["evtx"], []), "suspicious_processes": (["pslist"], []), "external_connections": ([], ["netscan", "evtx"]), "cloud_sync_connections": ([], ["netscan", "evtx"]),
    "process_tree": (["pslist"], ["evtx"]), "sensitive_file_touch": (["path_catalog"], ["mft"]), "after_hours_logons": (["evtx"], []), "usb_insertions": (["usb"], []), "photos_outside_home": (["media_exif"], []),
    "photos_during_vacation": (["media_exif"], []), "sync_volume_spike": (["media_exif"], []), "sysmon_file_touch": (["evtx"], []), "sysmon_process_spawn": (["evtx"], []), "dns_queries": (["evtx"], []), "lateral_logons": (["evtx"], []),
    "failed_logons": (["evtx"], []), "registry_persistence": (["evtx"], []), "service_install": (["evtx"], []), "log_cleared": (["evtx"], []), "powershell_script": (["evtx"], []), "findings_summary": ([], []),
    "execution_corroboration": ([], ["shimcache", "prefetch"]), "psexec_lateral": ([], ["shimcache", "prefetch", "evtx"]), "suspicious_execution_ancestry": (["pslist"], []), "lateral_tool_reuse": ([], ["shimcache", "prefetch"]),
    "credential_tooling": ([], ["shimcache", "prefetch"]), "prefetch_sensitive_paths": (["prefetch"], []), "shimcache_staging": (["shimcache"], []), "bulk_exfil_signals": (["bulk"], []), "bulk_dns_corroboration": (["bulk", "evtx"], []), "path_discover": ([], ["path_catalog", "mft"]),
}
# Fixed values: (required, recommended) artifacts by kind of case.
PROFILES = {
    "intrusion": (["pslist"], ["netscan", "evtx", "dlllist", "shimcache", "prefetch"]), "insider_ip_theft": (["pslist", "evtx"], ["path_catalog", "mft", "netscan", "dlllist", "media_exif", "usb", "shimcache", "prefetch"]),
    "account_compromise": (["pslist", "evtx"], ["netscan", "mft"]), "hybrid": (["pslist", "evtx"], ["netscan", "mft", "dlllist"]),
}
EXCLUDED_QUERIES = frozenset({"findings_summary"})


def artifacts_of(tier: str) -> frozenset[str]:
    """PL01: what a tier loads, with all tiers before it."""
    if tier not in TIERS:
        raise ValueError(f"unknown tier {tier}; one of {', '.join(TIERS)}")
    upto = TIERS if tier == "full" else TIERS[: TIERS.index(tier) + 1]
    return frozenset(a for t in upto for a in TIER_ADDS[t])


def packs_of(tier: str, case_type: str, override: str = "") -> frozenset[str] | None:
    """PL02: packs to read: those of the override, or of the kind of case, or of an intrusion; the full tier reads all (None)."""
    if tier == "full":
        return None
    profile = next(name for name in (override, case_type, "intrusion") if name in TRIAGE_PACKS)
    return frozenset(TRIAGE_PACKS[profile])


@dataclass(frozen=True)
class TierPlan:
    tier: str
    artifacts: frozenset[str]
    packs: frozenset[str] | None
    full: bool


def tier_plan(tier: str | None, case_type: str, only: set[str] | None = None, full: bool = False, override: str = "") -> TierPlan:
    """PL03: what is asked for, as the first rule that applies says: a hand-picked set, everything, a tier, or the first one."""
    rules = [(only is not None, "custom"), (full, "full"), (bool(tier), tier), (True, "triage")]
    name = next(name for applies, name in rules if applies)
    artifacts = frozenset(only or ()) if name == "custom" else artifacts_of(name)
    # a hand-picked set takes the first tier's events, if it takes events at all
    events = {"custom": "triage" if "evtx" in artifacts else None}.get(name, name)
    return TierPlan(name, artifacts, packs_of(events, case_type, override) if events else None, name == "full")


def tier_for(artifacts: set[str] | frozenset[str]) -> str:
    """PL03: the first tier that loads them all."""
    return next((t for t in TIERS if set(artifacts) <= artifacts_of(t)), "full")


def next_tier(tier: str) -> str | None:
    return TIERS[TIERS.index(tier) + 1] if tier in TIERS[:-1] else None


def steps_for(case_type: str, tier: str) -> list[str]:
    """PL04: steps that a tier unlocks; kinds without first steps of their own take those of an intrusion."""
    first = TRIAGE_STEPS.get(case_type, TRIAGE_STEPS["intrusion"])
    return list(first) if tier == "triage" else [*first, *(s for s in EXECUTION_STEPS.get(case_type, []) if s not in first)]


@dataclass(frozen=True)
class Dependency:
    query: str
    satisfied: bool
    missing: tuple[str, ...]
    missing_any: tuple[str, ...]
    tier: str
    command: str


def dependency(query: str, loaded: set[str], host: str = "HOST") -> Dependency:
    """PL05, PL06: what a query still needs, and the tier that brings it; queries without an entry need nothing."""
    required, any_of = NEEDS.get(query, ([], []))
    missing = tuple(a for a in required if a not in loaded)
    missing_any = tuple(any_of) if any_of and not set(any_of) & loaded else ()
    ok = not missing and not missing_any
    tier = tier_for({*missing, *missing_any[:1]})
    return Dependency(query, ok, missing, missing_any, tier, "" if ok else f"tracelake load-tier {tier} --host {host}")


def host_plan(queries: list[str], loaded: set[str], host: str) -> dict:
    """PL07: which queries can run on a host and which tier would serve the others."""
    checks = [dependency(q, loaded, host) for q in queries]
    blocked = [c for c in checks if not c.satisfied]
    wanted = max((c.tier for c in blocked), key=TIERS.index, default=None)
    return {"host": host, "runnable": [c.query for c in checks if c.satisfied], "blocked": [c.query for c in blocked], "tier": wanted}


def event_ids(packs: frozenset[str] | None = None, extra: list[tuple[str, str, int]] = ()) -> list[tuple[str, int]]:
    """PL08, D04: (source, event id) of a profile and what it inherits; the first of equal ones wins."""
    return list(dict.fromkeys((source, event) for pack, source, event in (*EVENTS, *extra) if packs is None or pack in packs))


def pack_of(event: Column) -> Column:
    """PL02: the pack of an event id; events of no pack are "other"."""
    packs: dict[str, list[int]] = {}
    for pack, _, number in EVENTS:
        packs.setdefault(pack, []).append(number)
    return F.coalesce(*(F.when(event.isin(numbers), pack) for pack, numbers in packs.items()), F.lit("other"))


def select_queries(wanted: list[str], available: set[str], exclude: frozenset[str] = EXCLUDED_QUERIES, override: list[str] | None = None) -> list[str]:
    """PL09: in order, without repeats."""
    return [q for q in dict.fromkeys(wanted if override is None else override) if q in available and q not in exclude]


def rebuild_text(hosts: list[str], plan: TierPlan, queries: list[str]) -> str:
    """PL10: a dry run. All hosts load in one job: the host is a column."""
    return "\n".join([f"tier {plan.tier}: {', '.join(sorted(plan.artifacts))}", f"hosts: {', '.join(sorted(hosts))}", f"queries: {', '.join(queries)}"])


@dataclass(frozen=True)
class Gap:
    """An artifact that a kind of case wants and a host lacks."""

    level: str
    artifact: str


def wanted_artifacts(case_type: str) -> list[Gap]:
    """What a kind of case wants; unknown kinds want what an intrusion does."""
    required, recommended = PROFILES.get(case_type, PROFILES["intrusion"])
    return [Gap("required", a) for a in required] + [Gap("recommended", a) for a in recommended]


def coverage_notes(case_type: str, loaded: set[str], tier: str = "triage") -> list[str]:
    """A line for each artifact that is wanted and not loaded, and one for a tier that leaves something to load."""
    lines = [f"{gap.artifact}: {gap.level}, not loaded" for gap in wanted_artifacts(case_type) if gap.artifact not in loaded]
    if tier != "full":
        lines.append(f"tier {tier} is loaded, later ones are not")
    return lines


def dedup_rules(config: object) -> dict[int, list[str]]:
    """Defaults, none, or exactly the well-formed rules of a config."""
    from tracelake.operators.graph import DEDUP_RULES

    if not config or not isinstance(config, dict):
        return dict(DEDUP_RULES)
    if config.get("enabled", True) is False:
        return {}
    if not config.get("rules"):
        return dict(DEDUP_RULES)
    return {int(r["event_id"]): [str(k) for k in r["keys"]] for r in config["rules"] if isinstance(r, dict) and r.get("event_id") is not None and r.get("keys")}


def bulk_allowed(mode: object, tier: str, explicit: bool = False) -> bool:
    """Carved features load if the case allows them, and by themselves only from their tier on."""
    return str(mode).lower() not in ("false", "none") and (explicit or tier in ("exfil", "full", "custom"))


@dataclass
class Case:
    """A case's settings; what is left out has these defaults."""

    case_id: str
    case_type: str = "intrusion"
    playbook: str = "intrusion"
    hypotheses: dict[str, str] = field(default_factory=dict)
    sensitive_paths: list[str] = field(default_factory=list)
    sensitive_extensions: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    enrichment: dict = field(default_factory=dict)

    def bulk_enabled(self) -> bool:
        mode = str(self.enrichment.get("bulk_extractor", "false")).lower()
        return mode == "true" or mode == "auto" and any(self.hypotheses.get(h) == "open" for h in self.enrichment.get("bulk_hypotheses") or [])
