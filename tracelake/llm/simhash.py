"""Operator 3: SimHash near-duplicates, searched by the generalised pigeonhole principle.

A fingerprint bit is set if it is set in over half of the XXH64 (seed 42) values of the text's word shingles.
Distinct fingerprints link at ``tau`` or fewer differing bits. The search:

1. one pass counts how often each pair of bits agrees, over all distinct fingerprints (a fixed 64 x 64 table);
2. bits that vary together are grouped into partitions (for 2, 3 and 4 partitions);
3. a second pass sketches, over all fingerprints, how often a partition's bits collide (a fixed-size sketch of the
   second frequency moment), and a dynamic program spreads the thresholds tau_i over the partitions, sum(tau_i + 1)
   = tau + 1, at the least estimated cost of signatures and candidate pairs: few coarse keys while the corpus is small,
   long keys with one-bit variants when it is large, so that work follows the input;
4. probe: fingerprints meet where a partition's bits (or a variant of theirs) agree; a bucket is searched breadth
   first, so it gives at most one link less than it has members, never all pairs; buckets beyond ``HOT`` members are
   dealt out again by the bits outside of the partition, up to three times. Fingerprints are distinct, and those that still
   meet agree in 44 bits (of three quarters of what is left, each time): no bucket of exact keys outgrows 2**20 of them;
5. verify: a link counts only if all 64 bits differ in ``tau`` places or fewer.

Copies share a fingerprint and are folded before the search. Components come from ``components``.

Defined cases: null text is an empty text; an empty text has fingerprint zero, which links like any other; a text of
fewer words than a shingle is one shingle; a row with a null id keeps its row, takes part with its text and never
names a component (which is null only if nothing else is in it); repeated rows share their component; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import materialize, release_shuffles, texts
from tracelake.llm.components import components

SEED = 42
#: Members of a bucket beyond which it is dealt out anew by other bits.
HOT = 50_000
#: Counters of the collision sketch of one partition.
SKETCH = 2048
#: Relative costs of one signature row and of one candidate pair.
ROW_COST, PAIR_COST = 500.0, 2.0


def fingerprint(body: bytes, shingle: int = 3) -> int:
    words = body.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    hash_of = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hash_of(line, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = (starts + sizes)[shingle - 1 :].tolist()
    h = np.array([hash_of(line[a:b], SEED) for a, b in zip(starts.tolist(), ends)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row for each row of docs; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _bit_table(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how often bits i and j are both set: 64 x 64 whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, table = 0, np.zeros((64, 64), np.int64)
        for b in batches:
            x = _bits(b.column(0).to_numpy(zero_copy_only=False)).astype(np.float64)
            n += len(x)
            table += (x.T @ x).astype(np.int64)
        at = np.arange(4096)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, 4096]), pa.array(np.r_[table.ravel(), n])], names=["cell", "n"])

    out = np.zeros(4097, np.int64)
    for cell, n in fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = n
    return int(out[4096]), out[:4096].reshape(64, 64)


def grouped_bits(n: int, table: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` partitions of like size, each grown from one bit by the one that varies most with it."""
    p = np.diag(table) / max(n, 1)
    cov = table / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    left, out = list(range(64)), []
    for k in range(parts):
        size = (64 - sum(map(len, out))) // (parts - k)
        group = [left.pop(0)]
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            left.remove(best)
            group.append(best)
        out.append(sorted(group))
    return out


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _collisions(fps: DataFrame, masks: list[int]) -> list[float]:
    """Estimated pairs that agree on all bits of a mask, from a sketch over all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(masks), SKETCH), np.int64)
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, m in enumerate(masks):
                h = _mix(fp & np.uint64(m))
                np.add.at(table[k], (h % np.uint64(SKETCH)).astype(np.int64), 1 - 2 * (h >> np.uint64(63)).astype(np.int64))
        k, at = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(table[k, at])], names=["k", "at", "n"])

    cells = fps.select("fp").mapInArrow(run, "k int, at int, n long").groupBy("k", "at").agg(F.sum("n").alias("n"))
    moment = dict(cells.groupBy("k").agg(F.sum(F.col("n").cast("double") * F.col("n"))).collect())
    return [moment.get(k, 0.0) for k in range(len(masks))]


def _variants(width: int, threshold: int) -> int:
    """Two keys at distance <= threshold share a variant of radius ceil(threshold / 2)."""
    return sum(math.comb(width, r) for r in range((threshold + 1) // 2 + 1))


def allocate(costs: list[list[float]], tau: int) -> tuple[float, list[int]]:
    """costs[i][e + 1] of threshold e (-1: the partition is left out). The cheapest thresholds with sum(e + 1) = tau + 1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, picked) in best.items():
            for e1, c in enumerate(row):
                if used + e1 <= tau + 1 and (used + e1 not in step or cost + c < step[used + e1][0]):
                    step[used + e1] = (cost + c, [*picked, e1 - 1])
        best = step
    return best.get(tau + 1, (math.inf, []))


def plan(n: int, table: np.ndarray, moments: dict[int, float], tau: int) -> list[tuple[int, int]]:
    """[(mask, threshold)] of the cheapest scheme of 2, 3 or 4 partitions."""
    p = np.diag(table) / max(n, 1)
    differ = np.clip(2 * p * (1 - p), 1e-9, 1 - 1e-9)
    found = []
    for parts in range(2, tau + 2):
        groups, costs = grouped_bits(n, table, parts), []
        for bits in groups:
            same = max(0.0, (moments.get(_mask(bits), 0.0) - n) / 2)
            odds = differ[bits] / (1 - differ[bits])
            one, two = odds.sum(), (odds.sum() ** 2 - (odds**2).sum()) / 2
            meet = [same, same * (1 + len(bits) + 2 * one + 2 * two), same * (1 + len(bits) + 2 * one + 2 * two)]
            costs.append([0.0, *(ROW_COST * n * _variants(len(bits), e) + PAIR_COST * meet[e] for e in range(3))])
        found.append((*allocate(costs, tau), groups))
    _, thresholds, groups = min(found, key=lambda x: x[0])
    return [(_mask(bits), e) for bits, e in zip(groups, thresholds) if e >= 0]


def _flips(mask: int, threshold: int) -> np.ndarray:
    bits = [b for b in range(64) if mask >> b & 1]
    out = [0]
    if threshold >= 1:
        out += [1 << b for b in bits]
    return np.array(out, np.uint64)


def _signatures(fps: DataFrame, scheme: list[tuple[int, int]]) -> DataFrame:
    flips = [_flips(m, e) for m, e in scheme]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (m, _) in enumerate(scheme):
                for f in flips[k]:
                    key = (fp & np.uint64(m)) ^ f
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k, np.int32)), pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], names=["part", "key", "fp"])

    return fps.select("fp").mapInArrow(run, "part int, key long, fp long")


def _again(hot: DataFrame, scheme: list[tuple[int, int]], tau: int, depth: int) -> DataFrame:
    """Members of hot buckets, dealt out by tau + 1 slices of the other bits: two within tau agree on one of them.

    Only for parts without variants is a bucket's agreement sure; elsewhere the slices cover all bits.
    """
    slices = []
    for m, e in scheme:
        rest = [b for b in range(64) if e > 0 or not m >> b & 1]
        rest = rest[depth:] + rest[:depth]  # other cuts each time
        slices.append([_mask(rest[j :: tau + 1]) for j in range(tau + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, key, fp = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for j in range(tau + 1):
                m = np.array([s[j] for s in slices], np.uint64)[part]
                new = _mix(_mix(key.view(np.uint64)) ^ _mix((fp.view(np.uint64) & m) + np.uint64(j)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new.view(np.int64)), b.column(2)], names=["part", "key", "fp"])

    return hot.mapInArrow(run, "part int, key long, fp long")


def bucket_links(fp: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one bucket's links, breadth first."""
    left, a, b = np.unique(fp), [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            x, front = front[0], front[1:]
            near = np.bitwise_count(left ^ x) <= tau
            if near.any():
                got = left[near]
                a.append(np.full(len(got), x))
                b.append(got)
                front, left = np.r_[front, got], left[~near]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _links(signatures: DataFrame, tau: int) -> DataFrame:
    def found(part: np.ndarray, key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        size = np.diff(np.r_[start, len(key)])
        a, b = [], []
        for s, n in zip(start[size > 32], size[size > 32]):
            x, y = bucket_links(fp[s : s + n], tau)
            a.append(x)
            b.append(y)
        run = np.repeat(np.where(size > 32, -1, np.arange(len(size))), size)
        at = np.flatnonzero(run >= 0)
        for o in range(1, 32):
            at = at[at + o < len(run)]
            at = at[run[at] == run[at + o]]
            if not len(at):
                break
            x, y = fp[at], fp[at + o]
            near = (np.bitwise_count(x ^ y) <= tau) & (x != y)
            a.append(x[near])
            b.append(y[near])
        none = np.zeros(0, np.uint64)
        return (np.concatenate(a), np.concatenate(b)) if a else (none, none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            now = [b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            if not len(now[0]):
                continue
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            held = [x[cut:] for x in now]
            if cut:
                x, y = found(*(v[:cut] for v in now))
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])
        if held is not None and len(held[0]):
            x, y = found(*held)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    return signatures.repartition("part", "key").sortWithinPartitions("part", "key").mapInArrow(run, "a long, b long")


def links(fps: DataFrame, tau: int = 3) -> DataFrame:
    """fps(fp, distinct) -> (a, b): links of Hamming distance <= tau that connect whatever all such links connect."""
    n, table = _bit_table(fps)
    masks = sorted({_mask(bits) for parts in range(2, tau + 2) for bits in grouped_bits(n, table, parts)})
    scheme = plan(n, table, dict(zip(masks, _collisions(fps, masks))), tau)
    signatures = _signatures(fps, scheme)
    out = []
    for depth in range(4):
        hot = materialize(signatures.groupBy("part", "key").count().where(F.col("count") > HOT).select("part", "key"), "hot")
        if hot.isEmpty() or depth == 3:
            out.append(_links(signatures, tau))
            break
        out.append(_links(signatures.join(hot, ["part", "key"], "left_anti").select("part", "key", "fp"), tau))
        signatures = materialize(_again(signatures.join(hot, ["part", "key"], "left_semi").select("part", "key", "fp"), scheme, tau, depth), "dealt-again")
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def near_duplicates(docs: DataFrame, shingle: int = 3, tau: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id of all rows reachable over links."""
    fps = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = materialize(components(links(classes, tau)), "roots")
    release_shuffles(docs.sparkSession)
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = named.join(least, "root").select("fp", "component_id")
    return fps.join(of_class, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
