"""Operator 9: byte-level BPE encoding and decoding with vectorised pre-tokenisation.

No regular expression runs over the text. Each code point gets a symbol from a class table (letter, number, other,
space, ...; a few neighbours decide on white space and on contractions), and a finite-state transducer says at which
symbols a piece starts. Its transition functions compose associatively, so the scan is done for many blocks at once:
first every block's function (from each state to a state), then a prefix composition over blocks, then the starts in
all blocks from their now known states. The slices between starts feed pair merging, which is cached by slice.
Byte offsets of pieces and tokens are kept, and decoding gathers the vocabulary's bytes by id.

Defined cases: null text is an empty text; an empty text has no tokens; texts are never cut; repeated rows give
repeated rows; a null id stays null; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame

from tracelake.llm.common import texts

# Symbols of the transducer.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE_LAST, BLANK_LAST, BLANK, RESET = range(9)
# Its states. PENDING is one space that may join the next piece; ONE and TWO are letters of a contraction to come.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, PENDING, IN_BLANKS, ONE, TWO = range(8)
# Code points of the White_Space property.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Endings that an apostrophe may take with it.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")

BLOCK = 256
NEVER = np.iinfo(np.int32).max
#: Slices kept in a worker's cache; a full cache is emptied, so its memory is bounded.
CACHE = 150_000
#: Longest slice that is merged with others in one matrix; longer ones are merged by a heap.
MATRIX = 64


@functools.cache
def class_table() -> np.ndarray:
    """Class of each code point: LETTER (L*), NUMBER (N*), BLANK (white space) or OTHER."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        # The library's own tables, once: classes change with the Unicode version. A match keeps its text, the rest is dropped.
        found = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}).encode_ordinary(every)
        table[np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)] = kind
    table[WHITE_SPACE] = BLANK
    return table


@functools.cache
def machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece starts), by state and symbol."""
    to, starts = np.zeros((8, 9), np.uint8), np.ones((8, 9), bool)
    for s in range(8):
        for symbol, state, joins in ((LETTER, IN_LETTERS, (IN_LETTERS, PENDING)), (NUMBER, IN_NUMBERS, (IN_NUMBERS, PENDING)), (OTHER, IN_OTHERS, (IN_OTHERS, PENDING))):
            to[s, symbol], starts[s, symbol] = state, s not in joins
        for symbol, state in ((SHORT, ONE), (LONG, TWO)):
            inside = s in (IN_OTHERS, PENDING)
            to[s, symbol], starts[s, symbol] = (IN_OTHERS if inside else state), not inside
        to[s, SPACE_LAST], to[s, BLANK_LAST], to[s, BLANK] = PENDING, FREE, IN_BLANKS
        starts[s, BLANK] = s != IN_BLANKS
        to[s, RESET], starts[s, RESET] = FREE, True
    to[TWO, :RESET], starts[TWO, :RESET] = ONE, False
    to[ONE, :RESET], starts[ONE, :RESET] = FREE, False
    return to, starts


def symbols(points: np.ndarray) -> np.ndarray:
    """Symbols of code points; a negative one (as unsigned, 0xFFFFFFFF) parts two texts."""
    part = points == 0xFFFFFFFF
    out = class_table()[np.where(part, 32, points)]
    blank = (out == BLANK) | part
    last = np.flatnonzero((out == BLANK) & ~np.r_[blank[1:], True])
    out[last] = np.where(points[last] == 32, SPACE_LAST, BLANK_LAST)
    at = np.flatnonzero(points == ord("'"))
    if len(at):
        ahead = np.r_[points, np.zeros(2, points.dtype)]
        one, two = ahead[at + 1], ahead[at + 2]
        out[at[np.isin(one, [ord(c) for c in SHORT_ENDINGS])]] = SHORT
        for a, b in LONG_ENDINGS:
            out[at[(one == ord(a)) & (two == ord(b))]] = LONG
    out[part] = RESET
    return out


def piece_starts(sym: np.ndarray) -> np.ndarray:
    """True where a piece starts, by scanning the transition functions of blocks."""
    to, starts = machine()
    n = len(sym)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, RESET, np.uint8)
    grid[:n] = sym
    columns = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    flat, width = to.ravel(), to.shape[1]
    function = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for c in columns:
        function = flat[function * np.uint8(width) + c[:, None]]
    step = 1  # inclusive prefix composition over blocks
    while step < rows:
        function[step:] = np.take_along_axis(function[step:], function[:-step].copy(), axis=1)
        step *= 2
    state = np.r_[np.uint8(FREE), function[:-1, FREE]]
    out, begins = np.empty((BLOCK, rows), bool), starts.ravel()
    for k, c in enumerate(columns):
        at = state * np.uint8(width) + c
        out[k] = begins[at]
        state = flat[at]
    return out.T.ravel()[:n]


@dataclass
class Codec:
    """A vocabulary of ranked byte strings, with caches for one worker."""

    ranks: dict[bytes, int]

    def __post_init__(self) -> None:
        self.cache: dict[bytes, bytes] = {}
        size = max(self.ranks.values(), default=-1) + 1
        pieces = [b""] * size
        for piece, rank in self.ranks.items():
            pieces[rank] = piece
        self.sizes = np.fromiter(map(len, pieces), np.int64, size)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {(self.ranks[p[:i]] << 32 | self.ranks[p[i:]]): r for p, r in self.ranks.items() for i in range(1, len(p)) if p[:i] in self.ranks and p[i:] in self.ranks}
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_values = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian unsigned 32-bit integers: the lowest-ranked pair joins first, leftmost on ties."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(piece) > MATRIX:
                out[i] = self._merge_long(piece)
            else:
                by_width.setdefault(max(8, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, rows in by_width.items():
            for i, ids in zip(rows, self._merge_matrix([pieces[i] for i in rows], width)):
                out[i] = ids
        return out

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (right >= 0), self.pair_values[at], NEVER)

    def _merge_matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        """A row for each piece; every round joins one pair in every row that still has one."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.full((len(pieces), width + 1), -1, np.int32)
        inside = np.arange(width + 1) < sizes[:, None]
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        pairs = self._pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width)
        live, columns = np.arange(len(pieces)), np.arange(width + 1)
        while True:
            j = pairs[live].argmin(axis=1)
            low = pairs[live, j]
            live, j, low = live[low < NEVER], j[low < NEVER], low[low < NEVER]
            if not len(live):
                break
            after = np.minimum(columns + (columns > j[:, None]), width)
            ids[live] = np.take_along_axis(ids[live], after, axis=1)
            ids[live, width] = -1
            ids[live, j] = low
            pairs[live] = np.take_along_axis(pairs[live], np.minimum(after[:, :-1], width - 1), axis=1)
            pairs[live, width - 1] = NEVER
            pairs[live, j] = self._pair_ranks(ids[live, j], ids[live, j + 1])
            back = j > 0
            pairs[live[back], j[back] - 1] = self._pair_ranks(ids[live[back], j[back] - 1], ids[live[back], j[back]])
        flat, ends = ids[ids >= 0].astype("<u4").tobytes(), np.cumsum((ids >= 0).sum(axis=1) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _merge_long(self, piece: bytes) -> bytes:
        """The same by a heap over a linked list: n log n for runs of any length."""
        import heapq

        n, get = len(piece), self.ranks.get
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)

        def push(i: int) -> None:
            j = end[i]
            if j < n and (r := get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        while heap:
            _, i, e = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != e:
                continue
            alive[end[i]] = False
            end[i] = e
            if e < n:
                before[e] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]].to_bytes(4, "little"))
            i = end[i]
        return b"".join(out)

    def encode_batch(self, bodies: list[bytes]) -> list[tuple[np.ndarray, list[bytes]]]:
        """For each text: byte offsets of its pieces (with its end), and the pieces' ids."""
        part = np.array([0xFFFFFFFF], np.uint32)
        points = [np.frombuffer(b.decode("utf-8").encode("utf-32-le"), np.uint32) for b in bodies]
        joined = np.concatenate([x for p in points for x in (p, part)]) if points else part
        begins = piece_starts(symbols(joined))
        bytes_of = 1 + (joined > 0x7F).astype(np.uint8) + (joined > 0x7FF) + (joined > 0xFFFF)
        cut_up, at, cache = [], 0, self.cache
        for body, p in zip(bodies, points):
            cut = np.flatnonzero(begins[at : at + len(p)])
            if len(p) == len(body):
                offsets = np.r_[cut, len(body)]
            else:
                offsets = np.r_[(np.cumsum(bytes_of[at : at + len(p)], dtype=np.int64) - bytes_of[at : at + len(p)])[cut], len(body)]
            at += len(p) + 1
            ends = offsets.tolist()
            pieces = [body[a:b] for a, b in zip(ends, ends[1:])]
            cut_up.append((offsets, pieces))
        new = list({p for _, pieces in cut_up for p in pieces if p not in cache})
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = list({p for _, pieces in cut_up for p in pieces})
        cache.update(zip(new, self.merge(new)))
        return [(offsets, list(map(cache.__getitem__, pieces))) for offsets, pieces in cut_up]

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return b""
        where = np.repeat(self.offsets[ids] - ends + sizes, sizes) + np.arange(ends[-1])
        return self.flat[where].tobytes()

    def token_spans(self, encoded: tuple[np.ndarray, list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, byte offset at which each token ends)."""
        ids = np.frombuffer(b"".join(encoded[1]), np.uint32)
        return ids, np.cumsum(self.sizes[ids])


@functools.lru_cache(maxsize=2)
def worker_codec(path: str) -> Codec:
    """One codec for each rank file and worker process: workers are used again, and so are their caches."""
    return Codec(rank_lines(path))


def rank_lines(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def batches_of(b: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts sum to about ``most`` bytes; a longer text stands alone, whole."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(b.column("body")).to_pylist()):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < b.num_rows:
        yield start, b.num_rows


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    codec = worker_codec(path)
    for b in batches:
        for i, j in batches_of(b):
            got = [codec.token_spans(e) for e in codec.encode_batch(b.column(1).slice(i, j - i).to_pylist())]
            counts = np.cumsum([0, *(len(ids) for ids, _ in got)]).astype(np.int32)
            none = np.zeros(0, np.int64)
            ids = np.concatenate([none, *(x for x, _ in got)]).astype(np.int32)
            ends = np.concatenate([none, *(x for _, x in got)]).astype(np.int32)
            columns = [b.column(0).slice(i, j - i), pa.ListArray.from_arrays(counts, ids), pa.ListArray.from_arrays(counts, ends), pa.array([codec.decode(x) for x, _ in got], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "ends", "decoded"])


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, ends array<int>, decoded binary): ids, the byte offset where each token ends, and the bytes they decode to.

    ``path`` names the rank file; every executor reads it there.
    """
    return texts(docs, id_col, text_col).mapInArrow(lambda batches: _encode(batches, path), "doc_id long, ids array<int>, ends array<int>, decoded binary")


def coded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): the ids that ``encoded`` returns, with digests made where the tokens are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _encode(batches, path):
            starts, ids = b.column("ids").offsets.to_numpy(), b.column("ids").values.to_numpy().astype("<u4")
            of_ids = [hashlib.sha256(ids[i:j].tobytes()).hexdigest() for i, j in zip(starts, starts[1:])]
            back = [hashlib.sha256(x).hexdigest() for x in b.column("decoded").to_pylist()]
            columns = [b.column("doc_id"), pa.array(np.diff(starts).astype(np.int64)), b.column("ids"), pa.array(of_ids, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")
