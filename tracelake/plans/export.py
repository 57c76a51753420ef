"""Bounded rows of a query as a Markdown table or a diagram. Rows are dictionaries that a limited query gave; nothing is collected here."""

from __future__ import annotations

import re

#: Rows of a table, and edges of a diagram.
TABLE_ROWS, DIAGRAM_ROWS = 15, 12


def _cell(value: object) -> str:
    return "" if value is None else re.sub(r"\s+", " ", str(value)).replace("|", "\\|")


def markdown_table(rows: list[dict], most: int = TABLE_ROWS) -> str:
    """The first rows, with all columns that any of them has; a note says how many are left out."""
    shown = rows[:most]
    columns = list(dict.fromkeys(c for r in shown for c in r))
    if not columns:
        return "_no rows_\n"
    lines = [columns, ["-"] * len(columns), *([_cell(r.get(c)) for c in columns] for r in shown)]
    more = f"\n_{len(rows) - most} more rows_\n" if len(rows) > most else ""
    return "".join(f"| {' | '.join(x)} |\n" for x in lines) + more


def diagram(rows: list[dict], source: str, target: str, label: str | None = None, most: int = DIAGRAM_ROWS) -> str:
    """The first rows as edges of a Mermaid flow chart; rows without either end are left out."""
    edges = [r for r in rows if r.get(source) not in (None, "") and r.get(target) not in (None, "")][:most]
    names: dict[str, str] = {}
    name = lambda x: names.setdefault(str(x), f"n{len(names)}")
    quoted = lambda x: _cell(x).replace('"', "'")
    arrows = [f"  {name(r[source])} -->{'|' + quoted(r[label]) + '|' if label and r.get(label) else ''} {name(r[target])}" for r in edges]
    return "\n".join(["flowchart LR", *(f'  {n}["{quoted(x)}"]' for x, n in names.items()), *arrows]) + "\n"


def document(title: str, rows: list[dict], source: str | None = None, target: str | None = None) -> str:
    """A page of one query: its title, a diagram where its rows have two ends, and its table."""
    chart = f"```mermaid\n{diagram(rows, source, target)}```\n\n" if source and target and rows else ""
    return f"# {title}\n\n{chart}{markdown_table(rows)}"
