"""Scalar normalizers as Column builders: nothing here leaves the JVM.

Timestamps stay ISO-8601 strings ('' when unknown), so that comparisons sort as text; EVTX fields use '' for missing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Record keys with names of their own.
KEY_NAMES = {
    "PID": "pid", "PPID": "ppid", "File output": "file_output", "Offset(V)": "offset_v", "ImageFileName": "image_file_name",
    "CreateTime": "create_time", "ExitTime": "exit_time", "ForeignAddr": "foreign_addr", "ForeignPort": "foreign_port",
    "LocalAddr": "local_addr", "LocalPort": "local_port", "event_identifier": "event_id", "display_name": "display_name",
    "timestamp_desc": "timestamp_desc", "datetime": "datetime", "date_time": "datetime", "xml_string": "xml_string",
    "filename": "filename", "inode": "inode",
}
# Drive of each device volume; any other is C.
VOLUMES = {"1": "C:\\", "2": "D:\\", "3": "E:\\"}
# Columns that may hold a path, by rank.
PATH_KEYS = ("display_name", "filename", "name", "pathspec")
SKIPPED_ADDRESSES = ("", "0.0.0.0", "*", "-", "::", "::1")
EXCLUDED = ("windows/winsxs", "program files/windowsapps", "windows/system32", "windows/servicing")


def key_name(key: str) -> str:
    """Snake case, unless the key has a name of its own or starts with an underscore."""
    if key in KEY_NAMES or key.startswith("_"):
        return KEY_NAMES.get(key, key)
    return re.sub(r"(?=[A-Z])", "_", key.replace(" ", "_")).lower().strip("_")


def process_id(host: Column, pid: Column, created: Column) -> Column:
    """N02"""
    when = F.when(F.coalesce(created, F.lit("")) == "", "unknown").otherwise(created)
    return F.concat_ws(":", host, pid.cast("string"), F.translate(when, ":", "-"))


def windows_path(path: Column, volumes: dict[str, str] = VOLUMES) -> Column:
    """Drive letters for device volumes, backslashes only, none doubled."""
    p = F.regexp_replace(F.trim(F.coalesce(path, F.lit(""))), r'^"+|"+$', "")
    p = F.translate(p, "/", "\\")
    volume = F.regexp_extract(p, r"(?i)^\\Device\\HarddiskVolume(\d+)\\", 1)
    drive = F.coalesce(F.create_map(*(F.lit(x) for pair in volumes.items() for x in pair))[volume], F.lit("C:\\"))
    p = F.when(volume != "", F.concat(drive, F.regexp_replace(p, r"(?i)^\\Device\\HarddiskVolume\d+\\", ""))).otherwise(p)
    p = F.when(p.startswith("\\") & ~F.lower(p).startswith("\\device\\"), F.concat(F.lit("C:"), p)).otherwise(p)
    return F.regexp_replace(p, r"\\{2,}", r"\\")


def file_id(host: Column, path: Column) -> Column:
    """N04"""
    return F.concat_ws(":", host, path)


def first_path(*columns: Column, longer_than: int = 1) -> Column:
    """N05 (two characters or more) and N06 (longer_than=2): the first usable path."""
    return F.coalesce(*(F.when(F.length(F.trim(c)) > longer_than, F.trim(c)) for c in columns), F.lit(""))


def timestamp(value: Column, legacy: bool = False) -> Column:
    """ISO-8601 in seconds from an epoch in seconds, milliseconds or 100 ns since 1601, or from text.

    legacy keeps the old thresholds, by which current 100-ns values are taken for milliseconds and give ''.
    """
    s = F.trim(value.cast("string"))
    n = F.when(s.rlike(r"^\d+$"), s.cast("decimal(20,0)"))
    filetime = n > (10**18 if legacy else 10**16)
    seconds = F.when(filetime, F.floor(n / 10_000_000) - 11_644_473_600).when(n > 10**12, F.floor(n / 1000)).when(n > 10**9, n).cast("long")
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    known = F.when((seconds > 0) & (seconds < 253_402_300_800), F.date_format(F.timestamp_seconds(seconds), iso))
    text = F.regexp_replace(F.regexp_extract(s, r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})", 1), " ", "T")
    return F.when(value.isNull() | (s == ""), "").when(n.isNotNull(), F.coalesce(known, F.lit(""))).when(text != "", F.concat(text, F.lit("Z"))).otherwise(s)


def basename(path: Column) -> Column:
    """What follows the last slash of either kind."""
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"[^\\/]*$", 0)


def to_int(value: Column) -> Column:
    """N09"""
    return F.trim(value.cast("string")).try_cast("int")


def skip_address(address: Column) -> Column:
    """Wildcard, loopback or missing."""
    a = F.trim(F.coalesce(address, F.lit("")))
    return a.isin(*SKIPPED_ADDRESSES) | a.startswith("127.")


def truncated(text: Column, n: int) -> Column:
    """N11"""
    return F.substring(text, 1, n)


def first_of(*columns: Column) -> Column:
    """The first that is not missing, else ''."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def event_id(field: Column, xml: Column) -> Column:
    """The field, else what the XML says."""
    return F.coalesce(to_int(field), F.regexp_extract(F.coalesce(xml, F.lit("")), r"<EventID[^>]*>(\d+)</EventID>", 1).try_cast("int"))


def stable_event_id(host: Column, record: Column, *parts: Column) -> Column:
    """Host and record number, else host and a hash of the content."""
    digest = F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 16)
    return F.concat_ws(":", host, F.coalesce(F.nullif(record.cast("string"), F.lit("")), digest))


def step_id(name: Column) -> Column:
    """A place of three digits and a label: "step 4 dns" is 004_dns, "Alpha" is 001_alpha, and "007_x" stays."""
    joined = F.replace(F.lower(F.regexp_replace(name, r"^\s+|\s+$", "")), F.lit(" "), F.lit("_"))
    place = F.coalesce(F.regexp_extract(joined, "[0-9]+", 0).try_cast("bigint"), F.lit(1))
    label = F.btrim(F.regexp_replace(joined, "^step_?[0-9]+", ""), F.lit("_"))
    return F.when(joined.rlike("^[0-9]{3}_"), joined).otherwise(F.format_string("%03d_%s", place, F.when(label == "", "step").otherwise(label)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often use names it, within its lambdas too: there Spark evaluates a repeated expression anew, for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def event_fields(xml: Column) -> Column:
    """name/value map of EventData; the last of equal names wins, empty values drop, malformed XML is an empty map.

    Earlier ones of equal names go before the map is made, whatever the session's policy for them.
    """
    parsed = F.from_xml(xml, "EventData struct<Data array<struct<_Name string, _VALUE string>>>", {"mode": "PERMISSIVE"})
    pairs = F.filter(F.coalesce(parsed["EventData"]["Data"], F.array().cast("array<struct<_Name:string,_VALUE:string>>")), lambda d: d["_Name"].isNotNull() & (F.trim(d["_VALUE"]) != ""))
    last = lambda pairs: F.filter(pairs, lambda d, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["_Name"] == d["_Name"]))
    return F.map_from_entries(F.transform(once(pairs, last), lambda d: F.struct(d["_Name"], F.trim(d["_VALUE"]))))


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9 ])", r"\\\1", text)


def glob_match(path: Column, pattern: str) -> Column:
    """A glob of slashes of either kind, anywhere in the path, in any case."""
    rx = ".*".join(_quoted(part) for part in pattern.replace("\\", "/").split("*"))
    return F.translate(path, "\\", "/").rlike(f"(?is){rx}")


def is_sensitive(path: Column, patterns: list[str], extensions: list[str] = ()) -> Column:
    low = F.lower(F.translate(path, "\\", "/"))
    tests = [glob_match(path, p) for p in patterns] + [low.endswith((e if e.startswith(".") else f".{e}").lower()) for e in extensions]
    return F.coalesce((path != "") & reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


def has_word(text: Column, word: str) -> Column:
    """The token with no letter or digit next to it."""
    return text.rlike(f"(?i)(?<![a-z0-9]){_quoted(word)}(?![a-z0-9])") if len(word) >= 2 else F.lit(False)


def is_excluded(path: Column, patterns: list[str] = ()) -> Column:
    """N18"""
    low = F.lower(F.translate(path, "\\", "/"))
    return reduce(lambda a, b: a | b, (low.contains(p.replace("\\", "/").lower()) for p in (*patterns, *EXCLUDED)))


def url_host(url: Column) -> Column:
    """Lower-cased, with its port."""
    rest = F.when(F.instr(url, "://") > 0, F.split_part(url, F.lit("://"), F.lit(2))).otherwise(url)
    return F.lower(F.split_part(rest, F.lit("/"), F.lit(1)))


def coordinate(value: Column, fallback: Column) -> Column:
    """Zero counts as missing, as it always did."""
    as_double = lambda c: c.cast("string").try_cast("double")
    return F.coalesce(F.nullif(as_double(value), F.lit(0.0)), as_double(fallback))


def identifier(name: str) -> str:
    """A catalog name from any text."""
    return re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-") or "default"


def rounded(value: Column, places: int) -> Column:
    """Ties toward plus infinity."""
    scale = 10**places
    return F.floor(value * scale + 0.5) / scale


def match_score(path: Column, sensitive: list[str] = (), extensions: list[str] = (), keywords: list[str] = (), aliases: dict[str, list[str]] | None = None, roots: list[str] = (), excluded: list[str] = (), least: int = 4) -> Column:
    """How much a path concerns a case, from 0 to 1."""
    norm = F.translate(F.coalesce(path, F.lit("")), "\\", "/")
    low = F.lower(norm)
    scores = [F.when(is_sensitive(norm, list(sensitive), list(extensions)), 0.85)]
    for word in (k.lower() for k in keywords):
        if len(word) >= least:
            scores.append(F.when(has_word(low, word), 0.7).when(low.contains(word), 0.55))
    for key, others in (aliases or {}).items():
        scores += [F.when(low.contains(term), 0.75) for term in (t.lower() for t in (key, *others)) if len(term) >= least]
    scores += [F.when(glob_match(norm, r), 0.4) for r in roots]
    best = F.greatest(F.lit(0.0), *(F.coalesce(s, F.lit(0.0)) for s in scores))
    return F.when((norm == "") | is_excluded(norm, list(excluded)), 0.0).otherwise(F.least(best, F.lit(1.0)))
