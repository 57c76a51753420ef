"""Operator 12: BPE encoding and decoding by a streaming transducer of bounded lookahead.

Text comes in chunks, and ids leave as soon as nothing that follows can change them. How far that is depends on the merge list alone.
Take two continuations of one prefix and apply the merges in their order: tokens left of a frontier are the same for both. A merge
(u, v) moves the frontier left only if v starts at it in one continuation, and then by u, which now starts at the frontier in both,
alone or grown on its right. So the next merge that moves it has a v with u on its left spine (v, its left half, that one's left
half, ...), and comes later in the list. The longest such chain, measured in bytes of its u's, is the sufficient lookahead: a token that ends so far
before the end of what was read is final. ``Merges.lookahead`` computes it in one pass over the list (667 bytes for the word vocabulary).
One more byte is held back, because the last byte of a word is another symbol than the same byte inside one.

A word that ends within the lookahead is encoded when it ends, and kept in a bounded cache. A longer word goes through a window of
thrice the lookahead, however long it is: the window is merged, its final tokens leave, the rest stays. Splitting at a boundary of final
tokens is exact, as no merge crosses it. Besides the window a stream holds one chunk: an open word and its class go on with the next.
Chunks end where composing characters (NFC) cannot reach over the cut, at white space if there is any.

Decoding reads ids in blocks and holds a state machine between them: whether a separator is due, and the bytes of an unfinished
code point. It has two readings: the library's for a file without decoder (vocabulary entries joined by spaces), and the text
that the bytes spell, a space after each word's end.

Defined cases: a null text is empty; an empty text has no ids and decodes to nothing; texts are never cut; a special token's string in
a text is that token, as in the library; repeated rows give repeated rows; a null id stays null; an empty table stays empty;
other columns are ignored. Merge lists where a part is made after its whole, or twice, are refused: the bound does not hold for them.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers

from tracelake.llm.common import small_batches

WORD_END = "</w>"
#: Code points of one chunk; words kept in a worker's cache (a full one is emptied); ids of one block when decoding.
CHUNK, CACHE, IDS = 1 << 16, 150_000, 1 << 16
#: Symbols up to which a list of pairs is searched for the lowest; more are kept in a heap.
SHORT = 48
NEVER = 1 << 62


@functools.cache
def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones stand for themselves, the others follow from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    of = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [of[b] for b in range(256)]


def as_class(points: list[int]) -> str:
    """A character class of code points, as ranges."""
    cuts = np.flatnonzero(np.diff(points) != 1) + 1
    return "".join(f"\\U{int(r[0]):08x}-\\U{int(r[-1]):08x}" for r in np.split(np.array(points), cuts) if len(r))


@functools.cache
def tables() -> dict[str, str]:
    """Character classes as the library has them, which knows another Unicode version than Python: letters, numbers, blanks, and the
    code points whose lower case or composition differs. Made once, on the driver, and sent along."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    joined, found = "".join(every), {}
    for name, pattern in (("letters", r"[^\p{L}]+"), ("numbers", r"[^\p{N}]+"), ("blanks", r"\S+")):
        found[name] = as_class([ord(c) for c in normalizers.Replace(Regex(pattern), "").normalize_str(joined)])
    lower, nfc = normalizers.Lowercase().normalize_str, normalizers.NFC().normalize_str
    odd = {c for c in every if lower(c) != c.lower()} | {"Σ"}  # capital sigma: its lower case depends on its place in Python
    odd |= {c for c in every if unicodedata.combining(c) and any(nfc(s) != unicodedata.normalize("NFC", s) for s in (f"a{c}̖", f"a{c}̀", f"à{c}"))}
    back = {d[-1] for c in every if (d := unicodedata.normalize("NFD", c)) != c}  # may join what stands before it
    back |= {chr(c) for c in range(0x1160, 0x1200)} | {c for c in every if unicodedata.combining(c)} | odd
    return found | {"odd": as_class(sorted(map(ord, odd))), "back": as_class(sorted(map(ord, back)))}


class Merges:
    """A merge list over symbols, and the lookahead that it needs."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> None:
        self.pairs, self.made = {}, []
        self.lookahead = self.sufficient(merges)
        for rank, (u, v) in enumerate(merges):
            self.pairs[vocabulary[u], vocabulary[v]] = rank
            self.made.append(vocabulary[u + v])
        keys = np.array([a << 32 | b for a, b in self.pairs], np.int64)
        self.order = np.argsort(keys)
        self.keys, self.makes = keys[self.order], np.array(self.made, np.int32)
        self.size = {i: len(t.removesuffix(WORD_END)) for t, i in vocabulary.items()}

    @staticmethod
    def sufficient(merges: list[tuple[str, str]]) -> int:
        """The longest way that a frontier can move left: a chain of merges, each of whose right part begins with the left part of the one before."""
        whole, parts = {u + v for u, v in merges}, set()
        if len(whole) < len(merges):
            raise ValueError("two merges make the same token")
        left, reach, longest = {}, {}, 0
        for u, v in merges:
            for part in (u, v):
                if part in whole and part not in parts:
                    raise ValueError(f"{part!r} is used before it is made")
            before, spine = 0, v
            while spine:
                before = max(before, reach.get(spine, 0))
                spine = left.get(spine)
            way = before + len(u)
            reach[u] = max(reach.get(u, 0), way)
            longest = max(longest, way)
            left[u + v] = u
            parts.add(u + v)
        return longest

    def settle(self, ids: list[int]) -> list[int]:
        """The tokens of a run of symbols: the lowest pair joins first, the leftmost of equal ones."""
        if len(ids) > SHORT:
            return self._settle_long(ids)
        get, made = self.pairs.get, self.made
        ranks = [get(p, NEVER) for p in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) != NEVER:
            i = ranks.index(low)
            ids[i : i + 2] = [made[low]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NEVER)
        return ids

    def settle_lanes(self, ids: np.ndarray) -> np.ndarray:
        """The same for many runs in step, a row each, -1 behind its end: every round joins one pair of every run that still has one."""
        ids = np.c_[ids, np.full(len(ids), -1, np.int32)]
        width = ids.shape[1]
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        places, live = np.arange(width), np.arange(len(ids))
        while len(live):
            now = ranks[live]
            at = now.argmin(axis=1)
            low = now[np.arange(len(live)), at]
            more = low < len(self.makes)
            live, at, low = live[more], at[more], low[more]
            if not len(live):
                break
            shift = np.minimum(places + (places > at[:, None]), width - 1)
            tokens = np.take_along_axis(ids[live], shift, axis=1)
            tokens[:, -1] = -1
            rows = np.arange(len(live))
            tokens[rows, at] = self.makes[low]
            ids[live] = tokens
            new = np.take_along_axis(now[more], np.minimum(shift[:, :-1], width - 2), axis=1)
            new[:, -1] = len(self.makes)
            new[rows, at] = self._ranks(tokens[rows, at], tokens[rows, at + 1])
            left = np.flatnonzero(at)
            new[left, at[left] - 1] = self._ranks(tokens[left, at[left] - 1], tokens[left, at[left]])
            ranks[live] = new
        return ids[:, :-1]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; those that are none have the rank after the last."""
        if not len(self.keys):
            return np.zeros(left.shape, np.int64)
        key = left.astype(np.int64) << 32 | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.order[at], len(self.makes))

    def _settle_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over linked places; a place whose pair has changed since is passed over."""
        n, get, made = len(ids), self.pairs.get, self.made
        ids = [*ids, -1]
        after, before = list(range(1, n + 2)), list(range(-1, n))
        now = [get((ids[i], ids[i + 1]), NEVER) for i in range(n)]
        heap = [(r, i) for i, r in enumerate(now) if r != NEVER]
        heapq.heapify(heap)
        while heap:
            low, i = heapq.heappop(heap)
            if now[i] != low:
                continue
            gone = after[i]
            ids[i], after[i], now[gone] = made[low], after[gone], NEVER
            if after[i] <= n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    now[k] = get((ids[k], ids[after[k]]), NEVER) if after[k] < n else NEVER
                    if now[k] != NEVER:
                        heapq.heappush(heap, (now[k], k))
            ids[gone] = -2
        return [x for x in ids[:n] if x != -2]


class Window:
    """A word of any length, read in parts: holds what may still change, thrice the lookahead at most."""

    def __init__(self, codec: Codec) -> None:
        self.codec, self.held = codec, bytearray()

    def feed(self, part: bytes) -> bytes:
        codec, out = self.codec, []
        room = 3 * codec.back
        for at in range(0, len(part), codec.back):
            self.held += part[at : at + codec.back]
            if len(self.held) >= room:
                out.append(self.leave())
        return b"".join(out)

    def leave(self) -> bytes:
        """The tokens that end the lookahead, or more, before the end of what is held."""
        codec = self.codec
        final, n, size, last = [], 0, codec.merges.size, len(self.held) - codec.back
        for i in codec.merges.settle([codec.inner[b] for b in self.held]):
            if n + size[i] > last:
                break
            n += size[i]
            final.append(i)
        del self.held[:n]
        return array("i", final).tobytes()

    def finish(self) -> bytes:
        """The word has ended: all that is held is final."""
        codec, held = self.codec, self.held
        out = codec.merges.settle([*(codec.inner[b] for b in held[:-1]), codec.ending[held[-1]]]) if held else []
        self.held = bytearray()
        return array("i", out).tobytes()


class Codec:
    """A tokenizer file's vocabulary, merges and special tokens, with the caches of one worker."""

    def __init__(self, path: str, classes: dict[str, str]) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        vocabulary = model["vocab"]
        self.merges = Merges(vocabulary, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self.back = self.merges.lookahead + 1
        alphabet = byte_alphabet()
        self.inner, self.ending = [vocabulary[c] for c in alphabet], [vocabulary[c + WORD_END] for c in alphabet]
        self.symbols = np.array([self.inner, self.ending], np.int32)
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.special = {t: array("i", [i]).tobytes() for t, i in special.items()}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        names = {i: t for t, i in (vocabulary | special).items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        back = {c: b for b, c in enumerate(alphabet)}
        spelt = lambda t: t.encode() if t in special else bytes(back[c] for c in t.removesuffix(WORD_END)) + b" " * t.endswith(WORD_END)
        self.bytes = [spelt(t) for t in self.names]
        self.digits = [str(i) for i in range(len(self.names))]
        kind = {"letters": f"[{classes['letters']}]+", "others": f"[^{classes['blanks']}{classes['letters']}{classes['numbers']}]+"}
        short = "'(?:[stmd]|re|ve|ll)"  # before other characters: an apostrophe is one of them
        self.pieces = re.compile(f"[{classes['blanks']}]*({kind['letters']}|[{classes['numbers']}]|{short}|{kind['others']})")
        self.ascii_pieces = re.compile(f"\\s*([a-z]+|[0-9]|{short}|[^\\sa-z0-9]+)", re.ASCII)
        self.runs = {k: re.compile(p) for k, p in kind.items()}
        self.blank, self.odd, self.joins = (re.compile(f"[{classes[k]}]") for k in ("blanks", "odd", "back"))
        self.slow = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        self.cache: dict[str, bytes] = {}

    def normal(self, chunk: str) -> str:
        """Composed and in lower case, as the library does it."""
        if chunk.isascii():
            return chunk.lower()
        if self.odd.search(chunk):
            return self.slow(chunk)
        return (chunk if unicodedata.is_normalized("NFC", chunk) else unicodedata.normalize("NFC", chunk)).lower()

    def chunks(self, text: str) -> Iterator[str]:
        """Parts that can be normalised and cut up on their own: none begins with what may join the end of the one before, or within a contraction."""
        at, size = 0, CHUNK
        while len(text) - at > size:
            cut = max(text.rfind(" ", at, at + size), text.rfind("\n", at, at + size))
            if cut <= at:
                cut = next((k for k in range(at + size, at, -1) if not self.joins.match(text, k) and "'" not in text[k - 3 : k] and not "\ud800" <= text[k] < ""), at)
            if cut <= at:
                size *= 2
                continue
            yield text[at:cut]
            at, size = cut, CHUNK
        yield text[at:]

    def cut(self, chunk: str, at: int = 0) -> list[str]:
        """Words of a normalised chunk; white space is dropped."""
        return (self.ascii_pieces if chunk.isascii() else self.pieces).findall(chunk, at)

    def ids(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers, put together from what its stream emits."""
        return b"".join(self.stream(text))

    def prepared(self, texts: list[str]) -> list[list[str] | None]:
        """Words of the texts that are one chunk without special tokens; those that are new are merged together."""
        words = [self.cut(self.normal(t)) if len(t) <= CHUNK and not (self.parts and self.parts.search(t)) else None for t in texts]
        self.learn({w for ws in words if ws for w in ws})
        return words

    def stream(self, text: str, words: list[str] | None = None) -> Iterator[bytes]:
        """Ids as they become final. ``words``: what ``prepared`` found."""
        if words is not None:
            yield self.words(words)
            return
        for part in self.parts.split(text) if self.parts else [text]:
            if part in self.special:
                yield self.special[part]
            elif part:
                yield from self.segment(part)

    def segment(self, text: str) -> Iterator[bytes]:
        """Ids of text between special tokens, chunk by chunk; ``open`` is the run that the chunk before ended in."""
        window, open_run = Window(self), None
        for chunk in self.chunks(text):
            chunk, at = self.normal(chunk), 0
            if open_run:
                went = open_run.match(chunk)
                at = went.end() if went else 0
                yield window.feed(chunk[:at].encode())
                if at == len(chunk):
                    continue
                yield window.finish()
                open_run = None
            pieces = self.cut(chunk, at)
            tail = b""
            if pieces and not self.blank.match(chunk[-1]):  # the last piece may go on
                open_run = next((r for r in self.runs.values() if r.fullmatch(pieces[-1])), None)
                if open_run:
                    tail = window.feed(pieces.pop().encode())
            yield self.words(pieces)
            yield tail
        yield window.finish()

    def words(self, pieces: list[str]) -> bytes:
        """Ids of whole words."""
        try:
            return b"".join(map(self.cache.__getitem__, pieces))
        except KeyError:
            self.learn(set(pieces))
            return b"".join(map(self.cache.__getitem__, pieces))

    def learn(self, words: set[str]) -> None:
        """Put words into the cache: short ones are merged in step, by their widths."""
        new = words.difference(self.cache)
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = words
        lanes: dict[int, list[tuple[str, bytes]]] = {}
        for word in new:
            spelt = word.encode()
            if len(spelt) > SHORT:
                self.cache[word] = self.word(spelt)
            else:
                lanes.setdefault(-(-len(spelt) // 4) * 4, []).append((word, spelt))
        for width, group in lanes.items():
            sizes = np.fromiter((len(b) for _, b in group), np.int64, len(group))[:, None]
            ids = np.full((len(group), width), -1, np.int32)
            place = np.arange(width)
            inside = place < sizes
            ids[inside] = self.symbols[np.broadcast_to(place == sizes - 1, ids.shape)[inside].astype(np.int8), np.frombuffer(b"".join(b for _, b in group), np.uint8)]
            ids = self.merges.settle_lanes(ids)
            flat, ends = ids[ids >= 0].tobytes(), np.cumsum((ids >= 0).sum(axis=1) * 4).tolist()
            self.cache.update((word, flat[a:b]) for (word, _), a, b in zip(group, [0, *ends], ends))

    def word(self, piece: bytes) -> bytes:
        if len(piece) >= 3 * self.back:
            window = Window(self)
            return window.feed(piece) + window.finish()
        inner = self.inner
        ids = [inner[b] for b in piece]
        ids[-1] = self.ending[piece[-1]]
        return array("i", self.merges.settle(ids)).tobytes()


class Decoder:
    """Ids to text, a block at a time: ``entries`` as the library joins vocabulary entries, ``text`` as the bytes spell it."""

    def __init__(self, codec: Codec, reading: str = "entries") -> None:
        self.codec, self.reading, self.due = codec, reading, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        if self.reading == "text":
            return self.utf8.decode(b"".join(map(self.codec.bytes.__getitem__, ids)))
        lead, self.due = " " if self.due else "", True
        return lead + " ".join(map(self.codec.names.__getitem__, ids))

    def finish(self) -> str:
        return self.utf8.decode(b"", True)


def blocks(ids: bytes) -> Iterator[list[int]]:
    for at in range(0, len(ids), 4 * IDS):
        yield array("i", ids[at : at + 4 * IDS]).tolist()


def decode(codec: Codec, ids: bytes, reading: str = "entries") -> str:
    decoder = Decoder(codec, reading)
    return "".join(decoder.feed(block) for block in blocks(ids)) + decoder.finish()


@functools.lru_cache(maxsize=2)
def _worker_codec(path: str, classes: tuple[tuple[str, str], ...]) -> Codec:
    return Codec(path, dict(classes))


def codec_of(path: str) -> Codec:
    return _worker_codec(path, tuple(tables().items()))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded, text): ids, the library's reading of them, and the text that they spell.

    ``path`` names the tokenizer file; every executor reads it there.
    """
    classes = tuple(tables().items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _worker_codec(path, classes)
        for b in batches:
            for i in range(b.num_rows):
                ids = codec.ids(b.column("text")[i].as_py())
                row = [b.column("doc_id").slice(i, 1), pa.array([np.frombuffer(ids, np.int32)], pa.list_(pa.int32())), pa.array([decode(codec, ids)], pa.string()), pa.array([decode(codec, ids, "text")], pa.string())]
                yield pa.RecordBatch.from_arrays(row, names=["doc_id", "ids", "decoded", "text"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string, text string")


def groups(column: pa.Array, most: int = 1 << 20) -> Iterator[list[str]]:
    """Texts of about ``most`` bytes together; a longer one stands alone, whole."""
    held: list[str] = []
    size = 0
    for text in column:
        text = text.as_py()
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def digests(codec: Codec, text: str, words: list[str] | None = None) -> tuple[int, str, str, str]:
    """(n_tokens, and digests of ids, of the library's reading, and of the text): each block of ids is read as it is emitted, and let go."""
    n, of_ids, of_entries, of_text = 0, hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
    entries, spelt = Decoder(codec), Decoder(codec, "text")
    for emitted in codec.stream(text, words):
        for ids in blocks(emitted):
            of_ids.update(((" " if n else "") + " ".join(map(codec.digits.__getitem__, ids))).encode())
            of_entries.update(entries.feed(ids).encode())
            of_text.update(spelt.feed(ids).encode())
            n += len(ids)
    of_text.update(spelt.finish().encode())
    return n, of_ids.hexdigest(), of_entries.hexdigest(), of_text.hexdigest()


def coded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, text_sha256), made while ids are emitted: a document's ids are never held whole."""
    classes = tuple(tables().items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _worker_codec(path, classes)
        for b in batches:
            found = [digests(codec, text, words) for texts in groups(b.column("text")) for text, words in zip(texts, codec.prepared(texts))]
            n, *of = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(x, pa.string()) for x in of)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "text_sha256"])

    if sys.byteorder != "little":
        raise RuntimeError("ids are emitted as little-endian integers")
    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, text_sha256 string")
