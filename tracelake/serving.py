"""The read-only serving surface (T): named queries, point lookups and guarded free SQL, with limits, timeouts and an audit.

Free SQL runs over registered tables only. The text is refused if a word of writing is left after comments and literals
are taken out; then the parsed plan is walked through children, inner children, expressions and subqueries, and every
node, relation and function must be on an allow-list: a path as a relation, a command or a reflective function is refused
whatever its spelling.
"""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections.abc import Callable
from pathlib import Path

from py4j.java_gateway import is_instance_of
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tracelake.plans.catalog import ABOUT, HUNTS
from tracelake.plans.store import GraphStore

DEFAULT_LIMIT, MAX_LIMIT, TIMEOUT_S, AUDIT_CHARS = 100, 1000, 30.0, 200
# Words that never stand in a query that only reads.
WRITE_WORDS = "insert update delete merge drop create alter truncate cache uncache refresh set reset add load msck repair grant revoke use analyze export import call execute declare optimize vacuum comment".split()
NODES = set("Project Filter Aggregate Join Sort GlobalLimit LocalLimit Limit Offset Distinct Union SubqueryAlias UnresolvedRelation UnresolvedWith UnresolvedHaving UnresolvedSubqueryColumnAliases OneRowRelation UnresolvedInlineTable Intersect Except WithWindowDefinition Generate LateralJoin Pivot UnresolvedOrdinal AsOfJoin CTERelationDef".split())
FUNCTIONS = set(
    "abs array array_contains array_distinct array_join array_max array_min array_size array_sort avg bit_count bool_and bool_or cardinality ceil ceiling char_length coalesce collect_list collect_set concat concat_ws contains count count_if cume_dist date_format date_trunc datediff day dense_rank element_at endswith every exists explode explode_outer extract filter first first_value floor from_json get get_json_object greatest hour if ifnull in initcap instr isnotnull isnull json_object_keys lag last last_value lead least left length like ln locate log log10 log2 lower lpad ltrim max max_by md5 mean median min min_by minute mod month named_struct now ntile nullif nvl percent_rank percentile percentile_approx pow power quarter rank regexp_count regexp_extract regexp_like regexp_replace replace reverse right rlike round row_number rpad rtrim second sha2 sign size sort_array split split_part sqrt startswith stddev struct substr substring sum to_date to_json to_timestamp transform translate trim try_cast upper variance when window year year approx_count_distinct any some string_agg listagg try_divide try_element_at unbase64 xxhash64 hash posexplode".split()
)


def retried(run: Callable[[], object], transient: tuple[type[BaseException], ...] = (ConnectionError, TimeoutError), tries: int = 5, first_wait_s: float = 0.1):
    """Run again after an error that passes, waiting twice as long each time; the last error is raised. Tasks are
    retried by the cluster itself; this is for what the driver asks of other services."""
    for n in range(tries):
        try:
            return run()
        except transient:
            if n == tries - 1:
                raise
            time.sleep(first_wait_s * 2**n)


def clamp_limit(n: object) -> int:
    """T08"""
    try:
        return max(1, min(int(n), MAX_LIMIT))
    except (TypeError, ValueError):
        return DEFAULT_LIMIT


def strip_comments(text: str) -> str:
    """Without comments; literals are emptied, so that nothing in them counts or hides anything."""
    part = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|/\*.*?\*/|--[^\n]*", re.S)
    return part.sub(lambda m: m[0] if m[0][0] == "`" else "''" if m[0][0] in "'\"" else " ", text)


def reject_write(text: str) -> str | None:
    """Why the text is refused, or None. Words inside longer identifiers do not count."""
    bare = re.sub(r"`[^`]*`", "``", strip_comments(text))
    if ";" in bare.rstrip().rstrip(";"):
        return "one statement only"
    m = re.search(rf"(?<![\w.])({'|'.join(WRITE_WORDS)})(?![\w])", bare, re.I)
    if m:
        return f"'{m[1].upper()}' is not permitted"
    return None if re.match(r"\s*(select|with|from|values|\()", bare, re.I) else "only queries are permitted"


def _seq(s) -> list:
    it, out = s.iterator(), []
    while it.hasNext():
        out.append(it.next())
    return out


def reject_plan(spark: SparkSession, text: str, tables: set[str]) -> str | None:
    """Why the parsed plan is refused, or None."""
    plan = "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"
    node = "org.apache.spark.sql.catalyst.trees.TreeNode"
    is_a = lambda x, kind: hasattr(x, "getClass") and is_instance_of(spark.sparkContext._gateway, x, kind)
    todo, names, relations = [spark._jsparkSession.sessionState().sqlParser().parsePlan(text)], set(), set()
    while todo:
        x = todo.pop()
        kind = x.getClass().getSimpleName().rstrip("$")
        if is_a(x, plan):
            if kind not in NODES:
                return f"{kind} is not permitted"
            todo += _seq(x.expressions())
            if kind == "UnresolvedRelation":
                relations.add(".".join(_seq(x.multipartIdentifier())))
            elif kind == "SubqueryAlias":
                names.add(x.alias())
            elif kind == "UnresolvedWith":
                for named in _seq(x.cteRelations()):
                    names.add(named.productElement(0))
                    todo.append(named.productElement(1))
        elif kind == "UnresolvedFunction":
            name = ".".join(_seq(x.nameParts())).lower()
            if name not in FUNCTIONS:
                return f"function {name} is not permitted"
        if is_a(x, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):
            todo.append(x.plan())
        todo += [c for c in (*_seq(x.children()), *_seq(x.innerChildren())) if is_a(c, node)]
    unknown = {r for r in relations if r not in tables and r not in names}
    return f"unknown table {sorted(unknown)[0]}" if unknown else None


class Server:
    """T01-T10 over a graph store. Results are dicts; errors are dicts with "error", never exceptions."""

    def __init__(self, store: GraphStore, tables: list[str], audit: str | None = None, timeout_s: float = TIMEOUT_S, parameters: dict | None = None):
        self.store, self.spark, self.tables, self.audit_path, self.timeout_s = store, store.spark, set(tables), audit, timeout_s
        self.needs_case = set(parameters or ())

    def list_hunts(self) -> list[dict[str, str]]:
        """T01"""
        return [{"name": n, "category": ABOUT[n][0], "description": ABOUT[n][1]} for n in sorted(ABOUT)]

    def _rows(self, make: Callable[[], DataFrame], cap: int) -> dict:
        """Cap + 1 rows at most; jobs are cancelled by tag when time is up."""
        tag, late = f"serve-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            self.spark.sparkContext.cancelJobsWithTag(tag)

        timer = threading.Timer(self.timeout_s, stop)
        self.spark.sparkContext.addJobTag(tag)
        timer.start()
        try:
            rows = [r.asDict(recursive=True) for r in make().limit(cap + 1).collect()]
        except Exception as e:  # noqa: BLE001  every failure becomes a typed answer
            return {"error": "timeout"} if late.is_set() else {"error": "query_error", "message": str(e).splitlines()[0][:300]}
        finally:
            timer.cancel()
            self.spark.sparkContext.removeJobTag(tag)
        return {"rows": rows[:cap], "row_count": min(len(rows), cap), "truncated": len(rows) > cap}

    def run_hunt(self, name: str, limit: object = DEFAULT_LIMIT, params: dict | None = None) -> dict:
        """T02; params: values for the query's parameters."""
        if name not in HUNTS:
            return {"error": "unknown_hunt", "available": sorted(HUNTS)}
        if name in self.needs_case and not params:
            return {"error": "needs_case", "hunt": name}
        return self._audited("run_hunt", {"name": name, "limit": limit}, lambda: {"hunt": name} | self._rows(lambda: self.store.hunt(name, **(params or {})), clamp_limit(limit)))

    def get_event(self, event_id: str) -> dict:
        """All properties that are not null."""

        def find() -> dict:
            found = self._rows(lambda: self.store["event"].where(self.store["event"]["id"] == event_id), 1)
            if "error" in found:
                return found
            return {"event": {k: v for k, v in found["rows"][0].items() if v is not None}} if found["rows"] else {"error": "not_found", "id": event_id}

        return self._audited("get_event", {"event_id": event_id}, find)

    def get_host_summary(self, host: str) -> dict:
        """T03"""
        from tracelake.operators.statistics import host_summary

        return self._audited("get_host_summary", {"host": host}, lambda: host_summary(self.store, host))

    def query(self, text: str, params: dict | None = None, limit: object = DEFAULT_LIMIT) -> dict:
        """T05"""

        def run() -> dict:
            if not isinstance(text, str) or not text.strip():
                return {"error": "bad_request"}
            why = reject_write(text)
            try:
                why = why or reject_plan(self.spark, text.strip().rstrip(";"), self.tables)
            except PySparkException as e:
                return {"error": "query_error", "message": str(e).splitlines()[0][:300]}
            if why:
                return {"error": "write_rejected", "message": why}
            for t in self.tables:
                if re.search(rf"\b{t}\b", text):
                    self.store[t].createOrReplaceTempView(t)
            return self._rows(lambda: self.spark.sql(text.strip().rstrip(";"), args=params or {}), clamp_limit(limit))

        return self._audited("query", {"text": str(text)[:AUDIT_CHARS]}, run)

    def _audited(self, tool: str, args: dict, run: Callable[[], dict]) -> dict:
        """One line for each call; neither the audit nor the call raises."""
        began = time.time()
        try:
            out = run()
        except Exception as e:  # noqa: BLE001
            out = {"error": "internal_error", "message": str(e).splitlines()[0][:300]}
        if self.audit_path:
            line = {"ts": began, "tool": tool, "args": args, "duration_ms": round((time.time() - began) * 1000, 1), "status": out.get("error", "ok"), "row_count": out.get("row_count", 0)}
            try:
                with Path(self.audit_path).open("a") as f:
                    f.write(json.dumps(line, default=str) + "\n")
            except OSError:
                pass
        return out
