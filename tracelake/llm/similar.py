"""Near-duplicates by similarity: texts whose sets of word shingles have a Jaccard similarity of 4/5 or more.

64 bits of SimHash do not tell 0.8 apart (texts of that similarity differ in about 10 bits, give or take 3, so that no
narrow threshold finds them all); it links the closest texts first, and a prefix filter finds the rest:

1. one pass names every text's set (a hash), with its SimHash, its size, and a bitmap of ``LOAD`` bits a shingle or more;
   equal sets are folded.
2. Shingles, packed in blocks by range of hashes, meet once and are counted: in how many different sets each of them is. What
   one set alone holds goes no further. Every set is put in one order of shingles, the rare ones first. Sets of similarity 0.8
   share a shingle of their first n - ceil(0.8 n) + 1, so a set whose own shingles fill these has no such partner. Rows of
   these prefixes meet by shingle; buckets of common shingles are dealt out by set as well.
3. Candidates are the SimHash links of ``TAU`` bits or fewer (``simhash.links``), and of each bucket its most central set (the
   one with the fewest rarer shingles: of edited copies the least edited) with the others; then, over the components that these
   leave, all pairs of different components in one bucket whose sizes and places allow 0.8. A bucket of over ``BLOCK`` sets is
   dealt into parts, and two parts at a time meet in a task.
4. A candidate is dropped if the bitmaps rule it out: a bit that only one has is a shingle that only one has. What is left is
   checked on the sets, which are spelled out for those texts alone.

No pair is accepted unchecked, and none of 0.8 is passed over unless its ends already share a component.

Defined cases are those of ``simhash``: a null text is empty, empty texts are alike, a text of fewer words than a shingle
is one shingle, a null id takes part and names nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import discard, give_back, materialize, mix, pack, release_shuffles, runs, scaled_partitions, slices, texts, unpack
from tracelake.llm.components import components
from tracelake.llm.simhash import SEED, links
from tracelake.llm.substrings import WordHashes, window_hashes

SHINGLE, TAU = 5, 3
#: Sets that hold a shingle, from which its bucket is dealt out by set.
HOT = 200_000
#: MB of documents' files for each range of shingle hashes.
RANGE_MB = 8
#: Bits of a bitmap for each shingle, at least.
LOAD = 4
#: Sets of a bucket that meet in one cell, about.
BLOCK = 4096
#: Ids that are still broadcast: 8 bytes each.
BROADCAST_IDS = 500_000
PAIR = "a long, b long"


def shingle_sets(bodies: list[bytes], shingle: int, known: WordHashes) -> list[np.ndarray]:
    """The set of each text: sorted hashes of its word shingles."""
    split = [b.lower().split() for b in bodies]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    words = np.fromiter((known[w] for ws in split for w in ws), np.uint64, int(sizes.sum()))
    h, at = window_hashes(words, shingle), (np.cumsum(sizes) - sizes).tolist()
    out = []
    for a, n in zip(at, sizes.tolist()):
        if n >= shingle:
            out.append(np.unique(h[a : a + n - shingle + 1]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(words[a : a + n].tobytes(), SEED)], np.uint64))
    return out


def _node(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """A Jaccard similarity of 4/5 or more, in whole numbers."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def bitmap(s: np.ndarray) -> bytes:
    width = max(64, 1 << (LOAD * len(s) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_be_alike(n: int, x: bytes, m: int, y: bytes) -> bool:
    """False only if the bitmaps of sets of n and m shingles rule a similarity of 4/5 out. The wider one folds onto the other."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    width = min(len(a), len(b))
    a, b = (np.bitwise_or.reduce(v.reshape(-1, width), axis=0) for v in (a, b))
    both = min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))
    return 9 * both >= 4 * (n + m)


def _simhashes(sets: list[np.ndarray]) -> np.ndarray:
    """A bit is set if it is set in over half of a set's hashes."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    bits = np.unpackbits(np.concatenate(sets).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _names(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, node, fp, n, bits) of each text."""
    known = WordHashes()
    names = ["doc_id", "node", "fp", "n", "bits"]
    for b in slices(batches, 2 << 20):
        sets = shingle_sets(b.column("body").to_pylist(), shingle, known)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(list(map(_node, sets)), pa.int64()), pa.array(_simhashes(sets).view(np.int64)), pa.array(list(map(len, sets)), pa.int32()), pa.array(list(map(bitmap, sets)), pa.binary())], names=names
        )


PACKED = "bucket long, node binary, n binary, held binary, low binary"
PACKED_SCHEMA = pa.schema([("bucket", pa.int64()), *((x, pa.binary()) for x in ("node", "n", "held", "low"))])


def _packed(batches: Iterator[pa.RecordBatch], shingle: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """Of each block of texts, for each range of hashes: the sets with shingles there (node, n), how many (held), and the low
    halves of their hashes, set by set. Equal sets of a block are one."""
    known = WordHashes()
    for b in slices(batches):
        found = {_node(s): s for s in shingle_sets(b.column("body").to_pylist(), shingle, known)}
        node, n = np.fromiter(found, np.int64, len(found)), np.fromiter(map(len, found.values()), np.int64, len(found))
        h = np.concatenate(list(found.values()))
        del found
        bucket = ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.uint16 if ranges <= 1 << 16 else np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, low, of = bucket[order], h.astype(np.uint32)[order], np.repeat(np.arange(len(n)), n)[order]
        del h, order
        rows, cut = [], np.r_[runs(bucket), len(bucket)]
        for s, e in zip(cut.tolist(), cut[1:].tolist()):
            first = runs(of[s:e])
            here = of[s:e][first]
            rows.append((int(bucket[s]), node[here].tobytes(), pack(n[here]), pack(np.diff(np.r_[first, e - s])), low[s:e].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), PACKED_SCHEMA)], schema=PACKED_SCHEMA)


COUNTED = "h long, node long, n int, df int"


def _counted(table: pa.Table) -> pa.Table:
    """Of one range: (h, node, n, df) of the shingles that df sets hold, two or more; h names a shingle by range and low half.

    Two shingles of one name are taken as one: both look more common than they are, which costs rows and loses nothing. If one
    set holds both they are numbered, so that no set has fewer names than shingles.
    """
    give_back()
    read = lambda c: np.concatenate([unpack(x.as_buffer()) for x in table[c]])
    node, n, held = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table["node"]]), read("n"), read("held")
    low = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table["low"]])
    once = np.zeros(len(node), bool)
    once[np.unique(node, return_index=True)[1]] = True  # equal sets of other blocks
    low, of = low[np.repeat(once, held)], np.repeat(np.flatnonzero(once), held[once])
    order = np.argsort(low, kind="stable")
    low, of = low[order], of[order]
    del order
    size = np.diff(np.r_[runs(low), len(low)])
    many = np.repeat(size > 1, size)
    low, of = low[many], of[many]
    del many, size
    order = np.lexsort((of, low))
    low, of = low[order], of[order]
    start = runs(low)
    new = np.r_[True, (low[1:] != low[:-1]) | (of[1:] != of[:-1])][: len(low)]
    df = np.repeat(np.add.reduceat(new, start, dtype=np.int64) if len(start) else start, np.diff(np.r_[start, len(low)]))
    alike_at = np.flatnonzero(new)
    number = np.arange(len(low)) - np.repeat(alike_at, np.diff(np.r_[alike_at, len(low)]))
    keep = df > 1
    h = (table["bucket"][0].as_py() << 32) + low.astype(np.int64) + (number << 52)
    columns = [h[keep], node[of[keep]], n[of[keep]].astype(np.int32), df[keep].astype(np.int32)]
    return pa.Table.from_arrays([pa.array(c) for c in columns], names=["h", "node", "n", "df"])


PREFIXES = "h long, salt int, salts int, node long, n int, place int"


def _places(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """(h, salt, salts, node, n, place) of rows sorted by (node, df, h): the first shingles of each set, n of its size; those
    that it alone holds come before them and count as places. salts: parts of the bucket."""

    def found(columns: list[np.ndarray]) -> pa.RecordBatch:
        h, node, n, df = columns
        start = runs(node)
        size = np.diff(np.r_[start, len(node)])
        place = np.arange(len(node)) + np.repeat(n[start] - size - start, size)
        keep = place < n - (4 * n + 4) // 5 + 1
        h, node, n, df, place = (x[keep] for x in (h, node, n, df, place))
        salts = df // hot + 1
        salt = mix(node.view(np.uint64)) % salts.astype(np.uint64)
        kinds = (np.int64, np.int32, np.int32, np.int64, np.int32, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip((h, salt, salts, node, n, place), kinds)], names=["h", "salt", "salts", "node", "n", "place"])

    held: list[np.ndarray] | None = None
    for b in batches:
        now = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        if not len(now[0]):
            continue
        cut = runs(now[1])[-1]
        held = [x[cut:] for x in now]
        if cut:
            yield found([x[:cut] for x in now])
    if held is not None:
        yield found(held)


def _prefixes(rows: DataFrame, shingle: int, ranges: int, parts: int) -> DataFrame:
    """(h, salt, salts, node, n, place): the shingles of each set's prefix that other sets hold too."""
    hot = HOT
    counted = rows.mapInArrow(lambda b: _packed(b, shingle, ranges), PACKED).repartition(ranges, "bucket").groupBy("bucket").applyInArrow(_counted, COUNTED)
    return counted.repartition(parts, "node").sortWithinPartitions("node", "df", "h").mapInArrow(lambda b: _places(b, hot), PREFIXES)


BUCKETS = "h long, salts int, node long, n int, place int, leader long, leader_n int, leader_place int"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by (h, salt, place, node), of buckets with two sets or more, each set once, beside the bucket's first one.

    Streams: of a bucket only its first row is held."""
    names = [c.split()[0] for c in BUCKETS.split(", ")]
    first = last = None  # the open bucket's first row (h, salt, salts, node, n, place), and its last node
    out = False  # whether that first row has been put out
    for b in batches:
        h, salt, salts, node, n, place = columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(h):
            continue
        same = lambda c, i: len(c) > i and first is not None and c[i] == first[0]
        goes_on = first is not None and h[0] == first[0] and salt[0] == first[1]
        once = np.r_[not (goes_on and node[0] == last), (h[1:] != h[:-1]) | (salt[1:] != salt[:-1]) | (node[1:] != node[:-1])]
        h, salt, salts, node, n, place = columns = [c[once] for c in columns]
        if not len(h):
            continue
        goes_on = goes_on and same(h, 0) and salt[0] == first[1]
        new = np.r_[not goes_on, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])]
        start = np.flatnonzero(new)
        size = np.diff(np.r_[start, len(h)])
        of = np.cumsum(new) - 1  # -1: the open bucket goes on
        keep = np.where(of < 0, True, (size[of] > 1) | (salts > 1)) if len(start) else np.ones(len(h), bool)
        lead = [np.where(of < 0, first[k] if goes_on else 0, c[start[of]] if len(start) else 0) for k, c in ((3, node), (4, n), (5, place))]
        rows = [h, salts, node, n, place, *lead]
        rows = [r[keep] for r in rows]
        if goes_on and not out:
            head = [first[0], first[2], first[3], first[4], first[5], first[3], first[4], first[5]]
            rows = [np.r_[x, r] for x, r in zip(head, rows)]
            out = True
        if len(start):
            i = start[-1]
            first, out = tuple(c[i] for c in columns), bool(keep[i])
        last = node[-1]
        if len(rows[0]):
            kinds = (np.int64, np.int32, np.int64, np.int32, np.int32, np.int64, np.int32, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(r.astype(k)) for r, k in zip(rows, kinds)], names=names)


def _possible(n: Column, place: Column, m: Column, other: Column) -> Column:
    """Whether what follows the shared shingle is long enough for 4/5; right for the first shingle that a pair shares."""
    return 9 * F.least(n - place, m - other) >= 4 * (n + m)


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _cells(rooted: DataFrame) -> DataFrame:
    """Rows of buckets with different roots, those of a large bucket dealt into parts of about ``BLOCK``: two parts meet in one cell.

    Every pair of a bucket is in exactly one cell as a pair of its two parts, or in one cell of a part with itself (``alone``).
    """
    apart = rooted.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / BLOCK).alias("parts")).where("lo <> hi").select("h", "parts")
    rows = rooted.join(apart, "h").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cell = F.least("part", "other") * F.col("parts") + F.greatest("part", "other")
    return rows.select("h", cell.alias("cell"), (F.col("part") == F.col("other")).alias("alone"), "part", "node", "n", "place", "root")


def _all_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of cells, sorted by h and cell, the pairs of different roots (and, of two parts, of different parts)."""

    def found(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, cell, alone, part, node, n, place, root = columns
        n, place = n.astype(np.int64), place.astype(np.int64)
        a, b, held = [], [], 0
        starts = _cell_starts(h, cell)
        for s, e in zip(starts.tolist(), np.r_[starts[1:], len(h)].tolist()):
            if (root[s:e] == root[s]).all():
                continue
            for x in range(s, e):
                y = np.arange(x + 1, e)
                y = y[(root[y] != root[x]) & (alone[x] | (part[y] != part[x]))]
                y = y[9 * np.minimum(n[x] - place[x], n[y] - place[y]) >= 4 * (n[x] + n[y])]
                if len(y):
                    a.append(np.minimum(node[x], node[y]))
                    b.append(np.maximum(node[x], node[y]))
                    held += len(y)
                    if held > 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b)], names=["a", "b"])
                        a, b, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b)], names=["a", "b"])

    held: list[np.ndarray] | None = None
    for b in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        if not len(now[0]):
            continue
        cut = _cell_starts(now[0], now[1])[-1]
        held = [x[cut:] for x in now]
        if cut:
            yield from found([x[:cut] for x in now])
    if held is not None and len(held[0]):
        yield from found(held)


def _cell_starts(h: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (cell[1:] != cell[:-1])])


def _by_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [may_be_alike(*x) for x in zip(*(b.column(c).to_pylist() for c in ("n", "left", "m", "right")))]
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _by_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(b.column("left"), b.column("right"))]
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _alike(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """The pairs whose sets are alike: first by bitmaps, then by the sets of those that are left."""
    side = lambda end, n, bits: nodes.select(F.col("node").alias(end), F.col("n").alias(n), F.col("bits").alias(bits))
    left = pairs.join(side("a", "n", "left"), "a").join(side("b", "m", "right"), "b").select("a", "b", "n", "left", "m", "right").mapInArrow(_by_bits, PAIR)
    left = materialize(left, "pairs")
    wanted = left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct()
    ids = materialize(nodes.join(wanted, "node", "left_semi").select("node", F.col("least").alias("doc_id")), "wanted")
    named = ids.where("doc_id is not null").select("doc_id").distinct()
    few = named.count() <= BROADCAST_IDS
    kept = rows.join(F.broadcast(named) if few else named, "doc_id", "left_semi")
    if not ids.where("doc_id is null").isEmpty():
        kept = kept.unionByName(rows.where("doc_id is null"))

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in slices(batches, 2 << 20):
            found = {_node(s): s.tobytes() for s in shingle_sets(b.column("body").to_pylist(), shingle, known)}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], names=["node", "grams"])

    sets = kept.mapInArrow(spelled, "node long, grams binary").join(ids.select("node"), "node", "left_semi").groupBy("node").agg(F.min("grams").alias("grams"))
    sets = materialize(sets, "shingles")
    both = left.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("left")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("right")), "b")
    found = materialize(both.select("a", "b", "left", "right").mapInArrow(_by_sets, PAIR), "alike")
    discard(left, ids, sets)
    release_shuffles(rows.sparkSession)
    return found


def similar(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id): component_id is the smallest id of all rows reachable over pairs of similarity 0.8 or more."""
    spark, rows = docs.sparkSession, texts(docs, id_col, text_col)
    parts = scaled_partitions(docs.select(text_col), 4)
    names = materialize(rows.mapInArrow(lambda b: _names(b, shingle), "doc_id long, node long, fp long, n int, bits binary"), "names")
    nodes = materialize(names.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("bits").alias("bits")), "nodes")
    release_shuffles(spark)
    prefixes = _prefixes(rows, shingle, scaled_partitions(docs.select(text_col), RANGE_MB), parts)
    buckets = prefixes.repartition(parts, "h", "salt").sortWithinPartitions("h", "salt", "place", "node").mapInArrow(_shared, BUCKETS)
    buckets = materialize(buckets, "buckets")
    release_shuffles(spark)

    heads = nodes.groupBy("fp").agg(F.min("node").alias("head"))
    ends = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}"))
    near = links(materialize(heads.select("fp"), "heads"), TAU).join(ends("a"), "a").join(ends("b"), "b").select(*_ordered("head_a", "head_b"))
    same = nodes.select("node", "fp").join(heads, "fp").where("node <> head").select(*_ordered("node", "head"))
    beside = buckets.where("node <> leader").where(_possible(F.col("n"), F.col("place"), F.col("leader_n"), F.col("leader_place"))).select(*_ordered("node", "leader"))
    tops = buckets.where("salts > 1 and node = leader").select("h", "node")
    across = tops.join(tops.groupBy("h").agg(F.min("node").alias("top")), "h").where("node <> top").select(*_ordered("node", "top"))
    pairs = materialize(near.unionByName(same).unionByName(beside).unionByName(across).distinct(), "candidates")
    found = _alike(pairs, nodes, rows, shingle)
    roots = materialize(components(found), "roots")
    rooted = buckets.select("h", "node", "n", "place").join(roots, "node", "left").select("h", "node", "n", "place", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "rooted")
    more = _cells(rooted).repartition(parts, "h", "cell").sortWithinPartitions("h", "cell", "node").mapInArrow(_all_pairs, PAIR)
    discard(pairs)
    pairs = materialize(more.distinct(), "candidates")
    discard(buckets, rooted, roots)
    release_shuffles(spark)
    found = found.unionByName(_alike(pairs, nodes, rows, shingle))
    roots = materialize(components(found), "roots")
    told = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = told.groupBy("root").agg(F.min("least").alias("component_id"))
    return names.select("doc_id", "node").join(told.join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id")
