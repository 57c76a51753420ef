"""Operator 10: substring de-duplication by suffix automata of reference shards.

A word is removed if it is in a window of ``window`` words whose sequence also starts in a document with a smaller
id; windows are judged on the input. Comparing each document with the automata of the whole corpus would grow with
the square of it, so the reference is first cut down and cut up, in work that follows the input:

1. reference: window hashes, packed in blocks by hash range, meet once. For each window that several documents hold,
   the smallest of them is its owner; what a task already knows (a later document of its own batch) never travels,
   so a passage of a third of the corpus sends one entry a batch. The owners' windows, in maximal runs, are the
   reference: each repeated passage once;
2. shards: reference runs go to shards by owner, of a bounded number of words each; a document goes to the shards that
   own its windows, only with the runs in question. An owner hears of a window once from the range of its hash, and once
   from its own block, however many documents ask. A shard asked by many documents is sent to several tasks (the
   broadcast), each with its part of the documents;
3. each task builds the suffix automaton of its shard's runs and streams the documents' words for their matching
   statistics; maximal spans at or above the threshold are removed. The automaton compares words, so a hash collision
   removes nothing.

Defined cases: null text is an empty text; a text under ``window`` words keeps all; a row with a null id keeps all and
is no reference; repeated rows (same id) do not remove each other's words; an empty table gives an empty result; other
columns are ignored. White space between kept words becomes one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import bucket_of, give_back, joined_by_id, materialize, merged, mix, pack, release_shuffles, runs, scaled_partitions, slices, texts, unpack

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words of reference in a shard, and bytes of documents that one task streams past it.
SHARD_WORDS, TASK_BYTES = 50_000, 8 << 20
#: Text of one block of window hashes.
BLOCK_BYTES = 5 << 20
#: MB of documents' files for each range of window hashes: about 20 MB of packed windows meet in a task.
RANGE_MB = 2
#: Shards whose sizes (two numbers each) are still broadcast.
BROADCAST_SHARDS = 500_000
ENTRY = ("doc", "pos", "owner", "at")
SHOWN = ("shown", "place")
PACKED = "bucket long, kind int, " + ", ".join(f"{x} binary" for x in ENTRY + SHOWN)
PACKED_SCHEMA = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), *((x, pa.binary()) for x in ENTRY + SHOWN)])


class WordHashes(dict):
    """Hash by word, kept for words seen; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    n = max(0, len(words) - window + 1)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(window):
            h = h * BASE + words[j : j + n]
    return mix(h)


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(ids, bodies) of about ``most`` bytes, by id; rows without an id are left out."""
    ids: list[int] = []
    bodies: list[bytes] = []
    size = 0

    def out() -> tuple[np.ndarray, list[bytes]]:
        order = sorted(range(len(ids)), key=ids.__getitem__)
        return np.array([ids[i] for i in order], np.int64), [bodies[i] for i in order]

    for b in slices(batches, most):
        for i, body in zip(b.column("doc_id").to_pylist(), b.column("body").to_pylist()):
            if i is not None:
                ids.append(i)
                bodies.append(body)
                size += len(body)
                if size >= most:
                    yield out()
                    ids, bodies, size = [], [], 0
    if ids:
        yield out()


def by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> dict[int, tuple[bytes, ...]]:
    """Columns packed for each bucket; their order within a bucket stays."""
    order = np.argsort(bucket, kind="stable")
    cut = np.r_[runs(bucket[order]), len(order)]
    parts = {}
    for a, z in zip(cut, cut[1:]):
        at = order[a:z]
        parts[int(bucket[at[0]])] = tuple(c[at].tobytes() if c.dtype == np.uint64 else pack(c[at]) for c in columns)
    return parts


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(PACKED_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, PACKED_SCHEMA)], schema=PACKED_SCHEMA)


def _windows(batches: Iterator[pa.RecordBatch], window: int, n: int) -> Iterator[pa.RecordBatch]:
    """Kind 0: windows to look up (doc, pos, hash in ``owner``); kind 1: windows whose smaller document is in the block, and that document's."""
    known = WordHashes()
    for ids, bodies in blocks(batches):
        yield from _of_block(ids, bodies, known, window, n)
        del ids, bodies
        give_back()


def _of_block(ids: np.ndarray, bodies: list[bytes], known: WordHashes, window: int, n: int) -> list[pa.RecordBatch]:
    words, sizes = [], []
    for b in bodies:
        split = b.split()
        sizes.append(len(split))
        words.append(np.fromiter((known[w] for w in split), np.uint64, len(split)))
    sizes, words = np.array(sizes, np.int64), np.concatenate(words)
    h = window_hashes(words, window)
    of = np.repeat(np.arange(len(ids)), sizes)
    inside = np.flatnonzero(of[: len(h)] == of[window - 1 :])
    h, of = h[inside], of[inside]
    pos = inside - (np.cumsum(sizes) - sizes)[of]
    doc = ids[of]
    del words, of, inside
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(h[order]) != 0]) if len(h) else np.zeros(0, np.int64)
    owner_at = np.empty(len(h), np.int64)
    owner_at[order] = np.repeat(order[first], np.diff(np.r_[first, len(h)]))
    del order, first
    here = doc > doc[owner_at]
    ask, tell = np.flatnonzero(~here), np.flatnonzero(here)
    out = []
    if len(ask):
        # ``owner`` carries the hash, whole; the bucket is its range
        out.append(_packed([(k, 0, *v, b"", b"", b"") for k, v in by_bucket((h[ask] % np.uint64(n)).astype(np.int64), doc[ask], pos[ask], h[ask]).items()]))
    if len(tell):
        out.append(_packed(_told(doc, pos, tell, owner_at[tell], n)))
    return out


def _told(doc: np.ndarray, pos: np.ndarray, at: np.ndarray, lead: np.ndarray, n: int) -> list[tuple]:
    """Kind 1, one row a bucket: the windows ``at`` with those that own them, by document; the owning windows, once each, by owner."""
    own, none = np.unique(lead), pack(np.zeros(0, np.int64))
    asked = by_bucket(bucket_of(doc[at], n), doc[at], pos[at], doc[lead], pos[lead])
    shown = by_bucket(bucket_of(doc[own], n), doc[own], pos[own])
    return [(k, 1, *asked.get(k, (none,) * 4), *shown.get(k, (none,) * 2)) for k in sorted(asked.keys() | shown.keys())]


def _owners(table: pa.Table, n: int) -> pa.Table:
    """Of one range of hashes: kind 1 of all windows that a smaller document holds too."""
    give_back()
    out = [tuple(row.values()) for row in table.filter(pc.not_equal(table["kind"], 0)).to_pylist()]
    asked = table.filter(pc.equal(table["kind"], 0)).select(["doc", "pos", "owner"])
    del table
    if asked.num_rows:
        # hashes first: ids and places are spelled out after the windows that one document alone holds have gone
        h = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in asked["owner"]])
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[first, len(h)])
        del h, first
        group = np.repeat(np.arange(len(size)), size)
        many = (size > 1)[group]
        order, group = order[many], group[many]
        del size, many
        if len(order):
            d, p = (np.concatenate([unpack(x.as_buffer()) for x in asked[c]])[order] for c in ("doc", "pos"))
            del asked, order
            by = np.lexsort((p, d, group))
            d, p, group = d[by], p[by], group[by]
            del by
            lead = np.flatnonzero(np.r_[True, np.diff(group) != 0])
            lead = np.repeat(lead, np.diff(np.r_[lead, len(group)]))
            at = np.flatnonzero(d > d[lead])
            at = at[np.lexsort((p[at], d[at]))]
            out += _told(d, p, at, lead[at], n)
    return pa.Table.from_batches([_packed(out)])


NEED = "doc_id long, words long, shown binary, lengths binary, starts binary, sizes binary, owner binary"
NEED_SCHEMA = pa.schema([("doc_id", pa.int64()), ("words", pa.int64()), *((x, pa.binary()) for x in ("shown", "lengths", "starts", "sizes", "owner"))])


def _needs(table: pa.Table, window: int) -> pa.Table:
    """One row a document: runs of its windows that it must show as owner (shown, lengths; words in all), and runs that
    others own (starts, sizes, owner)."""
    give_back()
    read = lambda c: np.concatenate([np.zeros(0, np.int64), *(unpack(x) for x in table[c].to_pylist())])
    doc, pos, owner, at = (read(c) for c in ENTRY)
    order = np.lexsort((pos, doc))
    doc, pos, owner, at = doc[order], pos[order], owner[order], at[order]
    first = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(pos) != 1) | (np.diff(owner) != 0) | (np.diff(at) != 1)][: len(doc)])
    asked = doc[first], pos[first], np.diff(np.r_[first, len(doc)]), owner[first]
    doc, pos = (read(c) for c in SHOWN)
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    new = np.r_[True, (np.diff(doc) != 0) | (np.diff(pos) != 0)][: len(doc)]
    doc, pos = doc[new], pos[new]
    first = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(pos) != 1)][: len(doc)])
    shown = doc[first], pos[first], np.diff(np.r_[first, len(doc)])
    rows = []
    for d in np.union1d(asked[0], shown[0]).tolist():
        a, z = np.searchsorted(asked[0], [d, d + 1])
        x, y = np.searchsorted(shown[0], [d, d + 1])
        rows.append((d, int((shown[2][x:y] + window - 1).sum()), *(pack(v[x:y]) for v in shown[1:]), *(pack(v[a:z]) for v in asked[1:])))
    columns = list(zip(*rows)) if rows else [[]] * len(NEED_SCHEMA)
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, NEED_SCHEMA)], schema=NEED_SCHEMA)


SEGMENT = "shard long, role int, doc_id long, n_bytes long, starts binary, body binary"
SEGMENT_SCHEMA = pa.schema([("shard", pa.int64()), ("role", pa.int32()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.binary()), ("body", pa.binary())])


def _segments(batches: Iterator[pa.RecordBatch], window: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Words of the runs in question: lines of words, for the shard of their owner. Role 0 is reference, role 1 asks."""
    for b in slices(batches):
        rows = []
        for row in b.to_pylist():
            doc, words = row["doc_id"], row["body"].split()
            shown, asked = unpack(row["shown"]), unpack(row["starts"])
            for role, start, size, shard in (
                (0, shown, unpack(row["lengths"]), bucket_of(np.full(len(shown), doc), shards)),
                (1, asked, unpack(row["sizes"]), bucket_of(unpack(row["owner"]), shards)),
            ):
                for k in np.unique(shard):
                    s, e = merged(start[shard == k], (start + size)[shard == k])
                    text = b"\n".join([b" ".join(words[i : j + window - 1]) for i, j in zip(s.tolist(), e.tolist())])
                    rows.append((int(k), role, doc, len(text), pack(s), text))
        columns = list(zip(*rows)) if rows else [[]] * len(SEGMENT_SCHEMA)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, SEGMENT_SCHEMA)], schema=SEGMENT_SCHEMA)


class SuffixAutomaton:
    """A generalised suffix automaton over words."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[bytes]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _new(self, to: dict[bytes, int], length: int, link: int) -> int:
        self.next.append(to)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        """The state of w's shortest extension from p, parted from q where q stands for longer strings as well."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.next[q].copy(), self.length[p] + 1, self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        if (q := self.next[last].get(w)) is not None:
            return self._split(last, q, w)
        now, p = self._new({}, self.length[last] + 1, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = now
            p = self.link[p]
        if p >= 0:
            self.link[now] = self._split(p, self.next[p][w], w)
        return now

    def spans(self, words: list[bytes], least: int) -> tuple[list[int], list[int]]:
        """Maximal spans of words that are covered by matches of ``least`` words or more."""
        nexts, link, length = self.next, self.link, self.length
        state = size = 0
        starts: list[int] = []
        ends: list[int] = []
        for i, w in enumerate(words):
            to = nexts[state].get(w)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nexts[state].get(w)
            if to is None:
                size = 0
                continue
            state, size = to, size + 1
            if size >= least:
                if ends and i - least + 1 <= ends[-1]:
                    ends[-1] = i + 1
                else:
                    starts.append(i - least + 1)
                    ends.append(i + 1)
        return starts, ends


COVER = "doc_id long, starts binary, ends binary"
COVER_SCHEMA = pa.schema([("doc_id", pa.int64()), ("starts", pa.binary()), ("ends", pa.binary())])


def _covered(table: pa.Table, window: int) -> pa.Table:
    """Of one shard and its part of the documents: spans found by matching statistics."""
    give_back()
    automaton, rows = SuffixAutomaton(), []
    for body in table.filter(pc.equal(table["role"], 0))["body"].to_pylist():
        for line in body.split(b"\n"):
            automaton.add(line.split(b" "))
    asked = table.filter(pc.equal(table["role"], 1))
    for doc, starts, body in zip(asked["doc_id"].to_pylist(), asked["starts"].to_pylist(), asked["body"].to_pylist()):
        s: list[int] = []
        e: list[int] = []
        for at, line in zip(unpack(starts).tolist(), body.split(b"\n")):
            a, z = automaton.spans(line.split(b" "), window)
            s += [at + x for x in a]
            e += [at + x for x in z]
        if s:
            rows.append((doc, pack(np.array(s)), pack(np.array(e))))
    columns = list(zip(*rows)) if rows else [[]] * 3
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, COVER_SCHEMA)], schema=COVER_SCHEMA)


def covered_spans(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, starts, ends): packed spans of words to remove; a document may have several rows."""
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    n = scaled_partitions(docs.select(text_col), RANGE_MB)
    packed = rows.mapInArrow(lambda batches: _windows(batches, window, n), PACKED)
    owners = packed.repartition(n, "bucket").groupBy("bucket").applyInArrow(lambda t: _owners(t, n), PACKED)
    needs = materialize(owners.repartition(n, "bucket").groupBy("bucket").applyInArrow(lambda t: _needs(t, window), NEED), "needs")
    release_shuffles(spark)
    shards = int(needs.agg(F.sum("words")).first()[0] or 0) // SHARD_WORDS + 1
    asked = rows.repartition(n, "doc_id").join(needs.repartition(n, "doc_id"), "doc_id")
    segments = materialize(asked.mapInArrow(lambda batches: _segments(batches, window, shards), SEGMENT), "segments")
    release_shuffles(spark)
    tasks = segments.where("role = 1").groupBy("shard").agg((F.floor(F.sum("n_bytes") / TASK_BYTES) + 1).cast("int").alias("tasks"))
    dealt = segments.join(F.broadcast(tasks) if shards <= BROADCAST_SHARDS else tasks, "shard").withColumn(
        "task", F.explode(F.when(F.col("role") == 0, F.sequence(F.lit(0), F.col("tasks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), F.col("tasks").cast("long")).cast("int"))))
    )
    dealt = dealt.select("shard", "task", "role", "doc_id", "starts", "body").repartition(n, "shard", "task")
    return materialize(dealt.groupBy("shard", "task").applyInArrow(lambda t: _covered(t, window), COVER), "spans")


KEPT = "doc_id long, n_words long, starts array<long>, ends array<long>, kept binary"


def _kept(batches: Iterator[pa.RecordBatch], layout: bool) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        n_words, starts, ends, kept = [], [], [], []
        for body, spans in zip(b.column("body").to_pylist(), b.column("spans").to_pylist()):
            words = body.split()
            s = e = np.zeros(0, np.int64)
            if spans:
                s, e = merged(np.concatenate([unpack(x["starts"]) for x in spans]), np.concatenate([unpack(x["ends"]) for x in spans]))
            cuts = [0, *(x for pair in zip(s.tolist(), e.tolist()) for x in pair), len(words)]
            n_words.append(len(words))
            starts.append(s)
            ends.append(e)
            kept.append(body if layout and not len(s) else b" ".join(w for i, j in zip(cuts[::2], cuts[1::2]) for w in words[i:j]))
        longs = pa.list_(pa.int64())
        columns = {"doc_id": b.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "starts": pa.array(starts, longs), "ends": pa.array(ends, longs), "kept": pa.array(kept, pa.binary())}
        if "carried" in b.schema.names:
            columns["carried"] = b.column("carried")
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def without_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), layout: bool = False) -> DataFrame:
    """(doc_id, n_words, starts, ends, kept): for each row its words, the spans of words removed, and the kept words with one space between.

    ``layout`` leaves texts that lose nothing as they are; the columns of ``carry`` come along in a struct, carried.
    """
    n = scaled_partitions(docs.select(text_col), 4)
    spans = covered_spans(docs, window, id_col, text_col).repartition(n, "doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("starts", "ends")).alias("spans"))
    rows, kind = texts(docs, id_col, text_col), KEPT
    if carry:
        rows = docs.select(F.struct(*carry).alias("carried"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"))
        kind += f", carried {rows.schema['carried'].dataType.simpleString()}"
    return joined_by_id(rows, spans, n).mapInArrow(lambda b: _kept(b, layout), kind)


def removed_words() -> F.Column:
    return F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
