"""The streaming transducer against the library, and its lookahead against all continuations."""

import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracelake.llm import transducer

PATH = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = "doc_id long, text string, ids string, decoded string, classes string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return transducer.codec_of(PATH)


def odd_texts():
    rnd = random.Random(7)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    mixed = ["".join(rnd.choices(points[:0x3000] if k % 2 else points, k=300)) for k in range(60)]
    words = ["".join(rnd.choice(["ing", "exhilar", "ating", "the", "an", "s"]) for _ in range(n)) for n in (40, 900)]
    return mixed + words + [
        "", "  ", "Hello, it's", "'step don't we'll 'S", "a<|endoftext|>b <|startoftext|><|endoftext|>'s <|end", "ΣΑΣ ΑΣ'", "é à́ ", "İIıſ", "\x1c\x1da b c",
        "가각 각", "x" * 5000, "ab" * 3000, "漢字" * 3000, "é" * 3000, "!" * 3000 + "'s" + "'" * 3000 + "re", "a'" * 3000, "é" * 3000, "a" + "̖́" * 2000, "٣٤Ⅷ½", "_a_b__", "ᲉꟜ",
    ]


@pytest.mark.parametrize("chunk", [1 << 16, 50, 7])
def test_ids_and_text_equal_the_library(codec, library, monkeypatch, chunk):
    monkeypatch.setattr(transducer, "CHUNK", chunk)
    for text in odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        ids = codec.ids(text)
        assert np.frombuffer(ids, np.int32).tolist() == want
        assert b"".join(codec.stream(text, codec.prepared([text])[0])) == ids
        assert transducer.decode(codec, ids) == library.decode(want, skip_special_tokens=False)


def test_a_full_cache_is_emptied(codec, library, monkeypatch):
    monkeypatch.setattr(transducer, "CACHE", 3)
    text = "one two three four five six one two"
    assert np.frombuffer(codec.ids(text), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_text_is_spelt_again(codec, monkeypatch):
    monkeypatch.setattr(transducer, "IDS", 1)  # a block for each id: code points are cut between blocks
    assert transducer.decode(codec, codec.ids("Le CAFÉ,  漢字🙂 it's"), "text") == "le café , 漢字 🙂 it 's "


def test_a_long_word_leaves_a_window_of_bounded_size(codec, library):
    rnd = random.Random(2)
    word = "".join(rnd.choice(["exhilar", "ating", "e", "x", "hil", "ar"]) for _ in range(20_000))
    window, out, held = transducer.Window(codec), b"", 0
    for at in range(0, len(word), 997):
        out += window.feed(word[at : at + 997].encode())
        held = max(held, len(window.held))
    emitted = len(out)
    out += window.finish()
    assert held <= 3 * codec.back and emitted > 0.9 * len(out)
    assert np.frombuffer(out, np.int32).tolist() == library.encode(word, add_special_tokens=False).ids


def test_lookahead_suffices_for_every_continuation():
    """Small random merge lists: a token that ends the lookahead before the end of a prefix is a token of every text that goes on."""
    rnd = random.Random(11)
    for _ in range(60):
        tokens, merges = ["a", "b"], []
        for _ in range(rnd.randint(2, 8)):
            u, v = rnd.choice(tokens), rnd.choice(tokens)
            if u + v not in tokens:
                tokens.append(u + v)
                merges.append((u, v))
        vocabulary = {t: i for i, t in enumerate(tokens)}
        made = transducer.Merges(vocabulary, merges)
        reach = made.lookahead
        tails = ["".join(t) for n in range(5) for t in itertools.product("ab", repeat=n)]
        for _ in range(6):
            prefix = "".join(rnd.choice("ab") for _ in range(reach + rnd.randint(1, 12)))
            final, at = [], 0
            for i in made.settle([vocabulary[c] for c in prefix]):
                at += made.size[i]
                if at > len(prefix) - reach:
                    break
                final.append(i)
            for tail in tails:
                assert made.settle([vocabulary[c] for c in prefix + tail])[: len(final)] == final


def test_runs_settle_alike(codec):
    rnd = random.Random(4)
    runs = [[codec.inner[b] for b in "".join(rnd.choice("aeinrst") for _ in range(rnd.randint(1, 40))).encode()] for _ in range(200)]
    lanes = np.full((len(runs), 40), -1, np.int32)
    for row, run in zip(lanes, runs):
        row[: len(run)] = run
    for row, run in zip(codec.merges.settle_lanes(lanes), runs):
        assert codec.merges.settle(list(run)) == codec.merges._settle_long(list(run)) == row[row >= 0].tolist()


def test_lists_without_a_bound_are_refused():
    with pytest.raises(ValueError, match="before it is made"):
        transducer.Merges({"a": 0, "b": 1, "ab": 2, "abb": 3}, [("ab", "b"), ("a", "b")])
    with pytest.raises(ValueError, match="same token"):
        transducer.Merges({"a": 0, "aa": 1, "aaa": 2}, [("a", "a"), ("aa", "a"), ("a", "aa")])


def test_documents(spark, library):
    texts = [None, "", "One two", "One two", *odd_texts()[-20:]]
    rows = [(None if i == 2 else i, t, "x", "y", "z") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + [rows[3]], COLUMNS)
    want = []
    for i, t, *_ in rows + [rows[3]]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = transducer.coded(docs.repartition(3), PATH)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == sorted(want, key=str)
    whole = {r["doc_id"]: r for r in transducer.encoded(docs, PATH).collect()}
    assert whole[3]["ids"] == library.encode("One two", add_special_tokens=False).ids and whole[3]["text"] == "one two "
    assert transducer.coded(docs.limit(0), PATH).collect() == []
