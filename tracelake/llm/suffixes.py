"""Operator 7: suffix-array de-duplication of bytes by prefix-free parsing.

A byte is removed if a string of ``least`` bytes that covers it also starts earlier: in a document with a smaller id,
or in the same one further left. Strings are judged on the input and never cross documents.

1. parse: rolling hashes trigger phrase ends. Triggers are window minima (the smallest hash of every ``GAP`` places), so
   any string of ``least`` bytes holds a whole phrase, and equal strings are cut alike. The dictionary of phrases is
   counted across the corpus by hash, packed in blocks: what repeats within a block sends one entry for it;
2. a string with a phrase that occurs once cannot repeat, so only stretches between such phrases go on. A stretch is
   cut into pieces, one for each run of strings that share their smallest phrase, and goes where that phrase goes: all
   copies of a string meet in one task, however the documents were dealt. Equal pieces of one block travel once, and so
   do equal pieces of one phrase in a task: all their bytes repeat, and one of them is left to be sorted;
3. in a task, the pieces are parsed again, by triggers that depend on four bytes alone. The suffix array of the
   dictionary's phrases and that of the parse give the order of all suffixes: first by the rest of the phrase, then by
   the rank of what follows. Neighbours whose common prefix reaches ``least`` bytes are one string; all but its first
   start in the corpus are marked.

Skew: a phrase of more than ``HOT`` occurrences (a line of a third of all documents) is no one's to own. Its strings are
dealt by their own 128-bit hash, each once a block, and compared by it; so are those of one phrase whose different pieces
exceed ``AT_ONCE`` bytes in a task, where a suffix array would take some hundred times their size. Sent to all tasks: the
hashes of hot phrases, at most (phrases / HOT) of them, where HOT grows with the corpus, so that they stay below 64 MB.

Defined cases: null text is an empty text; texts under ``least`` bytes keep all; a row with a null id keeps all and
counts for none; repeated rows (same id) are one document; an empty table gives an empty result; other columns are
ignored. What is left of a document need not be valid UTF-8: it is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import bucket_of, joined_by_id, materialize, merged, mix, pack, release_shuffles, runs, scaled_partitions, slices, texts, unpack
from tracelake.llm.substrings import blocks

LEAST = 100
#: Bytes of a trigger, and of the triggers inside a task.
GRAM, INNER = 12, 4
#: Bytes of pieces whose suffixes are sorted at once.
AT_ONCE = 1 << 19
#: Occurrences of a phrase beyond which its strings are dealt one by one.
HOT = 20_000
#: One place in so many (a power of two) triggers inside a task.
EVERY = 16
BASE = np.uint64(0x9E3779B97F4A7C15)


def _gap(least: int) -> int:
    return (least + 1 - GRAM) // 2


def gram_hashes(x: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(x) - size + 1)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            h = h * BASE + x[j : j + n]
    return mix(h)


def minima(h: np.ndarray, width: int) -> np.ndarray:
    """For each ``width`` places in a row, the first that holds their smallest hash."""
    if len(h) < width:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 28) - 1)
    v, size = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    if size < width:
        v = np.minimum(v[: len(v) - (width - size)], v[width - size :])
    return (v & low).astype(np.int64)


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, key: str = "up") -> np.ndarray:
    """Powers of BASE, or of its inverse, modulo 2**64."""
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        base = BASE if key == "up" else np.uint64(pow(int(BASE), -1, 1 << 64))
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        _POWERS[key] = have
    return have[:n]


def parse(body: bytes, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each phrase, number of the trigger that is the minimum from each place on).

    A phrase runs from one trigger to the end of the next. A string of ``least`` bytes at s is sure to be cut alike
    wherever it stands only between the minima that lie in it whole: from trigger number[s] to number[s + last].
    """
    none = np.zeros(0, np.int64)
    if len(body) < least:
        return none.view(np.uint64), none
    n = len(body)
    up, down = powers(n), powers(n, "down")
    total = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        # a difference of prefix sums, freed of its place, is the hash of what lies between
        np.cumsum((np.frombuffer(body, np.uint8) + np.uint64(1)) * up, out=total[1:])
        at = minima(mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1]), _gap(least))
        new = np.r_[True, at[1:] != at[:-1]]
        number, at = np.cumsum(new) - 1, at[new]
        start, end = at[:-1], at[1:] + GRAM
        h = (total[end] - total[start]) * down[start]
        return mix(mix(h) + (end - start).astype(np.uint64)), number


PHRASES = "bucket long, kind int, doc binary, nth binary, hash binary, times binary"
PHRASES_SCHEMA = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), *((x, pa.binary()) for x in ("doc", "nth", "hash", "times"))])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _by_bucket(bucket: np.ndarray, kind: int, doc: np.ndarray, nth: np.ndarray, h: np.ndarray | None = None, times: np.ndarray | None = None) -> list[tuple]:
    order = np.argsort(bucket, kind="stable")
    cut = np.r_[runs(bucket[order]), len(order)]
    out = []
    for a, z in zip(cut, cut[1:]):
        at = order[a:z]
        out.append((int(bucket[at[0]]), kind, pack(doc[at]), pack(nth[at]), b"" if h is None else h[at].tobytes(), b"" if times is None else pack(times[at])))
    return out


def _phrases(batches: Iterator[pa.RecordBatch], least: int, n: int) -> Iterator[pa.RecordBatch]:
    """Kind 0: phrases to count; kind 1: phrases known to repeat; kind 2: one entry for a repeated one, to tell the others, and how often it is."""
    for ids, bodies in blocks(batches):
        got = [parse(b, least)[0] for b in bodies]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        h, doc = np.concatenate(got) if got else np.zeros(0, np.uint64), np.repeat(ids, sizes)
        if not len(h):
            continue
        nth = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(h, kind="stable")
        lead = runs(h[order])
        size = np.diff(np.r_[lead, len(h)])
        many = np.repeat(size > 1, size)
        alone, tell, one = np.sort(order[~many]), np.sort(order[many]), order[lead[size > 1]]
        rows = _by_bucket((h[alone] % np.uint64(n)).astype(np.int64), 0, doc[alone], nth[alone], h[alone])
        rows += _by_bucket((h[one] % np.uint64(n)).astype(np.int64), 2, doc[one], nth[one], h[one], size[size > 1])
        rows += _by_bucket(bucket_of(doc[tell], n), 1, doc[tell], nth[tell])
        yield _table(rows, PHRASES_SCHEMA)


def _repeated(table: pa.Table, n: int, hot: int) -> pa.Table:
    """Of one range of hashes: the phrases that occur more than once, for their documents' buckets; bucket -1: hashes of hot ones."""
    rows = [tuple(r.values()) for r in table.filter(pc.equal(table["kind"], 1)).to_pylist()]
    asked = table.filter(pc.not_equal(table["kind"], 1))
    if asked.num_rows:
        doc = np.concatenate([unpack(x) for x in asked["doc"].to_pylist()])
        nth = np.concatenate([unpack(x) for x in asked["nth"].to_pylist()])
        parts = [np.frombuffer(x, np.uint64) for x in asked["hash"].to_pylist()]
        times = np.concatenate([unpack(t) if t else np.ones(len(p), np.int64) for t, p in zip(asked["times"].to_pylist(), parts)])
        h = np.concatenate(parts)
        known = np.repeat(asked["kind"].to_numpy() == 2, [len(p) for p in parts])
        order = np.argsort(h, kind="stable")
        lead = runs(h[order])
        size = np.diff(np.r_[lead, len(h)])
        again = order[np.repeat(size > 1, size) & ~known[order]]
        again = again[np.lexsort((nth[again], doc[again]))]
        rows += _by_bucket(bucket_of(doc[again], n), 1, doc[again], nth[again])
        often = lead[np.add.reduceat(times[order], lead) > hot] if len(lead) else lead
        if len(often):
            rows.append((-1, 3, b"", b"", h[order[often]].tobytes(), b""))
    return pa.Table.from_batches([_table(rows, PHRASES_SCHEMA)])


def _per_document(table: pa.Table) -> pa.Table:
    """(doc_id, again): which phrases of a document repeat; without an id, the hashes of hot phrases."""
    schema = pa.schema([("doc_id", pa.int64()), ("again", pa.binary())])
    if table["bucket"][0].as_py() < 0:
        return pa.Table.from_batches([_table([(None, b"".join(table["hash"].to_pylist()))], schema)])
    doc = np.concatenate([unpack(x) for x in table["doc"].to_pylist()])
    nth = np.concatenate([unpack(x) for x in table["nth"].to_pylist()])
    order = np.lexsort((nth, doc))
    doc, nth = doc[order], nth[order]
    cut = np.r_[runs(doc), len(doc)]
    return pa.Table.from_batches([_table([(int(doc[a]), pack(nth[a:z])) for a, z in zip(cut, cut[1:])], schema)])


PIECE = "bucket long, kind int, key long, doc_id long, at long, twice boolean, body binary, docs binary, places binary"
PIECE_SCHEMA = pa.schema(
    [("bucket", pa.int64()), ("kind", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("twice", pa.bool_()), ("body", pa.binary()), ("docs", pa.binary()), ("places", pa.binary())]
)


def pieces_of(body: bytes, again: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first string, one past the last string, phrase hash, whether that phrase comes twice) of a text's pieces: strings
    all of whose phrases repeat, by their smallest phrase. A piece holds a string twice only if it holds its phrase twice."""
    h, number = parse(body, least)
    n = len(body) - least + 1
    if n <= 0 or not len(h):
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none.astype(bool)
    alone = np.ones(len(h), bool)
    alone[again[again < len(h)]] = False
    # the phrases that are sure in a string are lo..hi-1, and there is one at least
    last = least - GRAM - _gap(least) + 1
    lo, hi = number[:n], number[last : last + n]
    bad = np.r_[0, np.cumsum(alone)]
    good = bad[hi] == bad[lo]
    # strings change phrases only where lo or hi does: the smallest hash of lo..hi-1 by doubling, once for each such run
    edge = np.flatnonzero(np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
    a, z, good = lo[edge], hi[edge], good[edge]
    low, key = [h], np.zeros(len(edge), np.uint64)
    while 2 ** len(low) <= int((z - a).max(initial=1)):
        half = 2 ** (len(low) - 1)
        low.append(np.minimum(low[-1][:-half], low[-1][half:]))
    level = np.frexp(np.maximum(z - a, 1))[1] - 1
    for k in range(len(low)):
        m = good & (level == k)
        key[m] = np.minimum(low[k][a[m]], low[k][z[m] - 2**k])
    new = np.flatnonzero(np.r_[True, (good[1:] != good[:-1]) | (key[1:] != key[:-1])])
    begin, stop, key = edge[new], np.r_[edge[new[1:]], n], key[new]
    keep = good[new]
    begin, stop, key = begin[keep], stop[keep], key[keep]
    # a phrase's place among all by (hash, place): how many of its hash lie in the piece
    names, of = np.unique(h, return_inverse=True)
    places = np.sort(of * np.int64(len(h) + 1) + np.arange(len(h)))
    base = np.searchsorted(names, key) * np.int64(len(h) + 1)
    twice = np.searchsorted(places, base + hi[stop - 1]) - np.searchsorted(places, base + lo[begin]) > 1
    return begin, stop, key, twice


def _digests(body: bytes, n: int, least: int) -> bytes:
    return b"".join([xxhash.xxh3_128_digest(body[i : i + least]) for i in range(n)])


def _pieces(batches: Iterator[pa.RecordBatch], least: int, n: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Kind 0: pieces; kind 1: spans already known to be removed (pieces that equal an earlier one of the block), their
    sizes in places; kind 2: strings of hot phrases, dealt by hash."""
    for b in slices(batches, 8 << 20):
        rows, seen, known, strings = [], {}, [], {}
        order = np.argsort(b.column("doc_id").to_numpy(zero_copy_only=False), kind="stable").tolist()
        docs, bodies, again = b.column("doc_id"), b.column("body"), b.column("again")
        for i in order:
            doc, body = docs[i].as_py(), bodies[i].as_py()
            begin, stop, key, twice = pieces_of(body, unpack(again[i].as_py()), least)
            often = np.isin(key, hot).tolist() if len(hot) else [False] * len(key)
            for a, z, k, t, o in zip(begin.tolist(), stop.tolist(), key.tolist(), twice.tolist(), often):
                text = body[a : z + least - 1]
                if (first := seen.setdefault(text, (doc, a))) != (doc, a):
                    if first[0] < doc or first[1] < a:
                        known.append((doc, a, len(text)))
                elif o:
                    digests = _digests(text, z - a, least)
                    for j in range(z - a):
                        at = strings.setdefault(digests[16 * j : 16 * j + 16], (doc, a + j))
                        if at != (doc, a + j) and (at[0] < doc or at[1] < a + j):
                            known.append((doc, a + j, least))
                else:
                    rows.append((k % n, 0, k - (1 << 63), doc, a, t, text, b"", b""))
        if known:
            d, a, size = np.array(known, np.int64).T
            s, e, d = merged_by(d, a, a + size)
            rows.append((int(d[0]) % n, 1, 0, 0, 0, False, pack(e - s), pack(d), pack(s)))
        if strings:
            digests = np.frombuffer(b"".join(strings), np.uint64).reshape(-1, 2)
            of = np.array(list(strings.values()), np.int64)
            bucket = (digests[:, 0] % np.uint64(n)).astype(np.int64)
            by = np.lexsort((of[:, 1], of[:, 0], bucket))
            cut = np.r_[runs(bucket[by]), len(by)]
            for x, y in zip(cut, cut[1:]):
                at = by[x:y]
                rows.append((int(bucket[at[0]]), 2, 0, 0, 0, False, digests[at].tobytes(), pack(of[at, 0]), pack(of[at, 1])))
        yield _table(rows, PIECE_SCHEMA)


def merged_by(doc: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, doc): the union of intervals of each document."""
    if not len(doc):
        return starts, ends, doc
    names, rank = np.unique(doc, return_inverse=True)
    wide = np.int64(ends.max() + 2)
    s, e = merged(starts + rank * wide, ends + rank * wide)
    rank = s // wide
    return s - rank * wide, e - rank * wide, names[rank]


def _later(digests: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the strings is not the first of its 128 bits."""
    order = np.lexsort((at, doc, digests[:, 1], digests[:, 0]))
    d = digests[order]
    return order[np.r_[False, (d[1:] == d[:-1]).all(axis=1)]]


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def doubled(symbols: np.ndarray, reach: int, ends: np.ndarray | None = None) -> list[np.ndarray]:
    """Ranks of the substrings of 1, 2, 4 .. symbols at each place, up to ``reach``; they stop at the place's end, and shorter ones sort first."""
    levels, size = [_ranks(symbols)], 1
    ends = np.full(len(symbols), len(symbols) - 1) if ends is None else ends
    while size < reach:
        now = levels[-1]
        at = np.arange(size, size + len(now))
        after = np.where(at <= ends, now[np.minimum(at, len(now) - 1)] + 1, 0)
        levels.append(_ranks(now * np.int64(len(now) + 2) + after))
        size *= 2
        if levels[-1].max(initial=0) == len(now) - 1:
            break
    return levels


def common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols that the suffixes at a and b share, as far as the levels reach: binary lifting over ranks."""
    n, out = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        for _ in range(2 if k == len(levels) - 1 else 1):
            x, y = a + out, b + out
            ok = (x + 2**k <= n) & (y + 2**k <= n)
            ok[ok] = levels[k][x[ok]] == levels[k][y[ok]]
            out[ok] += 2**k
    return out


def first_starts(texts_: list[bytes], order_key: np.ndarray, least: int) -> list[np.ndarray]:
    """For each text, in which of its places a string of ``least`` bytes starts that a smaller order key (or, in one text,
    an earlier place) also starts: by suffix arrays of the dictionary and of the parse. order_key orders the texts' first bytes
    in the corpus: (rank of document, place) as a whole number, so that key + place compares across texts."""
    sizes = np.fromiter(map(len, texts_), np.int64, len(texts_))
    base = np.cumsum(sizes + 1) - sizes - 1
    x = np.frombuffer(b"\0".join(texts_) + b"\0", np.uint8).astype(np.int64) + 1
    x[base + sizes] = 0  # ends of texts; they sort first and never match (below)
    ends = base + sizes
    of = np.repeat(np.arange(len(texts_)), sizes + 1)
    # 1. phrases: from a trigger (or a text's start) to the next trigger's last byte (or the text's end)
    h = gram_hashes(x.astype(np.uint64), INNER)
    hit = np.flatnonzero((h & np.uint64(EVERY - 1)) == 0)
    hit = hit[(hit + INNER <= ends[of[hit]]) & (hit > base[of[hit]])]
    start = np.sort(np.r_[base, hit])
    text_of = of[start]
    last = np.r_[text_of[1:] != text_of[:-1], True]
    nxt = np.r_[start[1:], 0]
    stop = np.where(last, ends[text_of] + 1, nxt + INNER)  # the last phrase keeps its end mark
    core = np.where(last, ends[text_of] + 1, nxt) - start  # bytes before the next phrase starts
    # 2. the dictionary: distinct phrases, and ranks of all their suffixes
    flat = x.astype(np.uint8 if x.max(initial=0) < 256 else np.int16)
    raw = flat.tobytes()
    width = flat.itemsize
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(raw[a * width : z * width], len(names)) for a, z in zip(start.tolist(), stop.tolist())), np.int64, len(start))
    words = list(names)
    lengths = np.fromiter((len(w) // width for w in words), np.int64, len(words))
    offsets = np.cumsum(lengths + 1) - lengths - 1
    dictionary = np.zeros(int((lengths + 1).sum()), np.int64)
    where = np.repeat(offsets - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    dictionary[where] = np.frombuffer(b"".join(words), flat.dtype).astype(np.int64) + 1
    del names, words, raw
    suffixes = doubled(dictionary, least, np.repeat(offsets + lengths, lengths + 1))
    # 3. the parse: rank of each phrase, then of each suffix of the parse
    # (phrases that share their first ``least`` bytes are told apart in any order: strings that begin in them are equal)
    phrase_rank = _ranks(suffixes[-1][offsets] * np.int64(len(offsets) + 1) + np.arange(len(offsets)))[ids]
    parse_levels = doubled(np.r_[phrase_rank + 1, 0], least)
    rank = np.r_[parse_levels[-1], 0]
    # 4. all suffixes: (rank of the rest of the phrase, rank of the next phrase's suffix)
    place = np.arange(len(x))
    j = np.searchsorted(start, place, "right") - 1
    use = place + least <= ends[of]
    place, j = place[use], j[use]
    into = place - start[j]
    spot = offsets[ids[j]] + into
    rest = suffixes[-1][spot]
    order = np.lexsort((rank[j + 1], rest))
    place, j, into, spot, rest = place[order], j[order], into[order], spot[order], rest[order]
    a, b = slice(None, -1), slice(1, None)
    inside = common(suffixes, spot[a], spot[b])
    reach = np.minimum(inside, least)
    # equal to the end of a phrase that ends too soon: go on in the parse; the trigger at its end is the next phrase's start
    go = (rest[a] == rest[b]) & (lengths[ids[j[a]]] - into[a] < least)
    k = np.flatnonzero(go)
    left, right, done = j[:-1][k] + 1, j[1:][k] + 1, (core[j] - into)[:-1][k]
    whole = common(parse_levels, left, right)
    starts_of = np.r_[start, len(x)]
    top = np.minimum(left + whole, len(start))
    done = done + starts_of[top] - starts_of[left]
    ok = (left + whole < len(start)) & (right + whole < len(start)) & (done < least)
    p, q = np.minimum(left + whole, len(start) - 1), np.minimum(right + whole, len(start) - 1)
    done[ok] += common(suffixes, offsets[ids[p[ok]]], offsets[ids[q[ok]]])
    reach[k] = done
    group = np.cumsum(np.r_[True, reach < least]) - 1
    key = order_key[of[place]] + place - base[of[place]]
    least_key = np.minimum.reduceat(key, np.flatnonzero(np.r_[True, np.diff(group) != 0])) if len(key) else key
    later = place[key > least_key[group]] if len(key) else place
    later = np.sort(later)
    bounds = np.searchsorted(later, np.r_[base, len(x)])
    return [later[s:e] - base[i] for i, (s, e) in enumerate(zip(bounds, bounds[1:]))]


def _marked(table: pa.Table, least: int, at_once: int) -> pa.Table:
    """(doc_id, start, end) of spans to remove, of one bucket."""
    docs, starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def put(d: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        docs.append(d)
        starts.append(s)
        ends.append(e)

    def strings(digests: list[bytes], doc: np.ndarray, at: np.ndarray) -> None:
        later = _later(np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2), doc, at)
        put(doc[later], at[later], at[later] + least)

    for row in table.filter(pc.equal(table["kind"], 1)).select(["docs", "places", "body"]).to_pylist():
        d, s, size = (unpack(x) for x in row.values())
        put(d, s, s + size)
    dealt = table.filter(pc.equal(table["kind"], 2))
    if dealt.num_rows:
        strings(dealt["body"].to_pylist(), *(np.concatenate([unpack(x) for x in dealt[c].to_pylist()]) for c in ("docs", "places")))
    asked = table.filter(pc.equal(table["kind"], 0))
    key, doc, at, twice = (asked[c].to_numpy() for c in ("key", "doc_id", "at", "twice"))
    order = np.lexsort((at, doc, key))
    cut = np.r_[runs(key[order]), len(order)]
    # a piece that shares its phrase with none, and holds it once, repeats nothing
    groups = np.flatnonzero((np.diff(cut) > 1) | np.logical_or.reduceat(twice[order], cut[:-1])) if len(order) else []
    texts_ = asked["body"]
    apart: list[tuple[int, int, bytes]] = []
    copies: list[tuple[int, int, int]] = []
    size = 0

    def sort() -> None:
        nonlocal size
        d, a = np.array([x[0] for x in apart]), np.array([x[1] for x in apart])
        rank = _ranks(d) * (int(a.max()) + (1 << 32)) + a
        found = first_starts([x[2] for x in apart], rank, least)
        of = np.repeat(np.arange(len(apart)), [len(f) for f in found])
        first = np.concatenate(found) + a[of]
        s, e, text = merged_by(of, first, first + least)
        put(d[text], s, e)
        apart.clear()
        size = 0

    for g in groups:
        mine = order[cut[g] : cut[g + 1]]
        bodies: dict[bytes, tuple[int, int]] = {}
        for i in mine.tolist():
            body, here = texts_[i].as_py(), (int(doc[i]), int(at[i]))
            if bodies.setdefault(body, here) != here:
                copies.append((*here, here[1] + len(body)))
        if len(bodies) == 1 and not twice[mine[0]]:
            continue
        bytes_ = sum(map(len, bodies))
        if bytes_ > at_once and len(bodies) > 1:
            n = np.array([len(x) - least + 1 for x in bodies])
            d, a = np.array(list(bodies.values()), np.int64).T
            a = np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            strings([_digests(x, len(x) - least + 1, least) for x in bodies], np.repeat(d, n), a)
            continue
        apart.extend((d, a, body) for body, (d, a) in bodies.items())
        size += bytes_
        if size >= at_once:
            sort()
    if apart:
        sort()
    if copies:
        put(*np.array(copies, np.int64).T)
    s, e, d = merged_by(np.concatenate(docs), np.concatenate(starts), np.concatenate(ends))
    return pa.table({"doc_id": d, "start": s, "end": e})


def repeated_spans(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end): spans of bytes to remove, which may overlap."""
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    n = scaled_partitions(docs.select(text_col), 4)
    often, at_once = max(HOT, n // 16), AT_ONCE
    counted = rows.mapInArrow(lambda b: _phrases(b, least, n), PHRASES).repartition(n, "bucket").groupBy("bucket").applyInArrow(lambda t: _repeated(t, n, often), PHRASES)
    again = materialize(counted.repartition(n, "bucket").groupBy("bucket").applyInArrow(_per_document, "doc_id long, again binary"), "again")
    release_shuffles(spark)
    # one row, of at most (phrases / often) hashes
    hot = np.frombuffer(b"".join(bytes(r.again) for r in again.where("doc_id is null").collect()), np.uint64)
    sent = spark.sparkContext.broadcast(hot)
    asked = rows.repartition(n, "doc_id").join(again.where("doc_id is not null").repartition(n, "doc_id"), "doc_id")
    pieces = asked.mapInArrow(lambda b: _pieces(b, least, 8 * n, sent.value), PIECE)
    spans = materialize(pieces.repartition(n, "bucket").groupBy("bucket").applyInArrow(lambda t: _marked(t, least, at_once), SPAN), "byte-spans")
    release_shuffles(spark)
    return spans


SPAN = "doc_id long, start long, end long"
KEPT = "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary"


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        size, starts, ends, kept = [], [], [], []
        for body, first, last in zip(b.column("body").to_pylist(), b.column("starts"), b.column("ends")):
            s = e = np.zeros(0, np.int64)
            if first.is_valid:
                s, e = merged(first.values.to_numpy(), last.values.to_numpy())
            cuts = [0, *(x for pair in zip(s.tolist(), e.tolist()) for x in pair), len(body)]
            size.append(len(body))
            starts.append(s)
            ends.append(e)
            kept.append(b"".join(body[i:j] for i, j in zip(cuts[::2], cuts[1::2])))
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(starts, longs), pa.array(ends, longs), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "starts", "ends", "kept"])


def without_repeated_bytes(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept): for each row its bytes, the maximal runs removed, and the bytes left."""
    n = scaled_partitions(docs.select(text_col), 4)
    spans = repeated_spans(docs, least, id_col, text_col).repartition(n, "doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = spans.select("doc_id", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
    return joined_by_id(texts(docs, id_col, text_col), spans, n).mapInArrow(_kept, KEPT)
