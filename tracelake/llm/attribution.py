"""Operator 1: token counts attributed to sections by offsets.

A document is encoded once, whole: cutting it up first would change tokens at the seams. Token spans are then joined to
section spans by interval (two binary searches for each token), and a token over a boundary is allocated by a rule:

- "start": to the section that holds its first byte;
- "most": to the section that holds most of its bytes, the earlier one on ties (the default);
- "split": to all sections it touches, by their share of its bytes.

Sections are lines (each with its line end, so that they tile the text) unless a column gives them as spans of code
points, sorted and without overlap; what lies in no section is counted apart.

Defined cases: null text is an empty text, with no tokens and no section; null spans are no sections, spans beyond the
text end with it; a null id stays null; repeated rows give repeated rows; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.bpe import batches_of, worker_codec

RULES = ("start", "most", "split")


def line_spans(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.flatnonzero(np.frombuffer(body, np.uint8) == 10) + 1
    ends = cuts if len(cuts) and cuts[-1] == len(body) else np.r_[cuts, len(body)]
    ends = ends[ends > 0]
    return np.r_[0, ends[:-1]][: len(ends)], ends


def byte_spans(body: bytes, starts: list[int], ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of spans of code points."""
    x = np.frombuffer(body, np.uint8)
    at = np.r_[np.flatnonzero((x & 0xC0) != 0x80), len(body)]
    clip = lambda v: at[np.clip(np.array(v, np.int64), 0, len(at) - 1)]
    return clip(starts), clip(ends)


def allocate(token_ends: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str = "most") -> tuple[np.ndarray, int, float]:
    """(tokens of each section, tokens over a boundary, tokens outside)."""
    counts = np.zeros(len(starts))
    a, z = np.r_[0, token_ends[:-1]][: len(token_ends)], token_ends
    if not len(starts):
        return counts, 0, float(len(a))
    first, last = np.searchsorted(ends, a, "right"), np.searchsorted(starts, z, "left")
    whole = (last - first == 1) & (starts[np.minimum(first, len(starts) - 1)] <= a) & (z <= ends[np.minimum(first, len(ends) - 1)])
    counts += np.bincount(first[whole], minlength=len(starts))
    # the others, each beside the sections that it touches
    t = np.flatnonzero(~whole)
    n = np.maximum(last[t] - first[t], 0)
    of = np.repeat(np.arange(len(t)), n)
    at = np.repeat(first[t] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    held = np.minimum(ends[at], z[t][of]) - np.maximum(starts[at], a[t][of])  # bytes
    of, at, held = of[held > 0], at[held > 0], held[held > 0]
    outside = z[t] - a[t] - np.bincount(of, held, minlength=len(t)).astype(np.int64)
    crossing, size = len(np.unique(of)), np.maximum(1, z[t] - a[t])
    if rule == "split":
        np.add.at(counts, at, held / size[of])
        return counts, crossing, float((outside / size).sum())
    by = np.lexsort((np.arange(len(of)), -held if rule == "most" else np.zeros(len(of)), of))
    one = by[np.r_[True, of[by][1:] != of[by][:-1]][: len(by)]]  # of each token the section that may have it
    own = held[one] >= outside[of[one]] if rule == "most" else starts[at[one]] <= a[t][of[one]]
    np.add.at(counts, at[one[own]], 1)
    return counts, crossing, float(len(t) - own.sum())


def attributed(docs: DataFrame, path: str, rule: str = "most", id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_sections, n_crossing, outside, section_tokens array<double>), one row for each row.

    spans_col: array<struct<start, end>> of code points; None: lines.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body")]
    if spans_col:
        for part in ("start", "end"):
            columns.append(F.coalesce(F.transform(F.filter(F.col(spans_col), lambda s: s["start"].isNotNull() & s["end"].isNotNull()), lambda s: s[part].cast("long")), F.array().cast("array<long>")).alias(part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(path)
        for b in batches:
            for i, j in batches_of(b):
                part = b.slice(i, j - i)
                bodies = part.column("body").to_pylist()
                spans = zip(part.column("start").to_pylist(), part.column("end").to_pylist()) if spans_col else [None] * len(bodies)
                rows = []
                for body, encoded, given in zip(bodies, codec.encode_batch(bodies), spans):
                    ids, ends = codec.token_spans(encoded)
                    starts, stops = byte_spans(body, *given) if given else line_spans(body)
                    counts, crossing, outside = allocate(ends, starts, stops, rule)
                    rows.append((len(ids), len(counts), crossing, outside, counts))
                n, k, c, o, s = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(c, pa.int64()), pa.array(o, pa.float64()), pa.array(list(s), pa.list_(pa.float64()))],
                    names=["doc_id", "n_tokens", "n_sections", "n_crossing", "outside", "section_tokens"],
                )

    return docs.select(columns).mapInArrow(run, "doc_id long, n_tokens long, n_sections long, n_crossing long, outside double, section_tokens array<double>")
