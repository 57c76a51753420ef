"""The operators against brute force, on a fixture of awkward rows: nulls, empty and long texts, copies, clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from tracelake.llm import attribution, bpe, licences, pages, quality, simhash, substrings, suffixes, templates, toxicity
from tracelake.llm.components import components

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, body string, fp long, words string, h string"


def rows():
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefgéñ") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, line = prose(60), prose(14)
    texts = [None, "", "  \n\t ", "one", "one two", prose(5000), prose(80) + "\n" + passage, passage + "\n" + prose(70), line + "\n" + prose(50) + "\n" + line, "!" * 300, "ab" * 400]
    copy = prose(200)
    texts += [copy] * 4 + [copy + " tail", copy.replace("a", "A", 1)] + [prose(rnd.randint(1, 120)) for _ in range(40)] + [passage] * 2
    return [(i, t, None if i % 9 == 0 else "en", "s" if i % 3 else None, 1, "x", 2, "y", "z") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), COLUMNS)


@pytest.fixture(scope="module")
def with_oddities(spark, docs):
    """Also a row without id, and a repeated row."""
    return docs.unionByName(spark.createDataFrame([(None, rows()[6][1], "en", "s", 1, "", 0, "", ""), rows()[7]], COLUMNS))


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ")
    words = [w for part in words for w in part.replace("\t", "\n").split("\n") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fps, tau=3):
    ids, root = sorted(fps), {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= tau:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_classes_equal_brute_force(spark, docs, with_oddities):
    fps = {r[0]: fingerprint(r[1]) for r in rows()}
    want = linked(fps)
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex16("fp").alias("f"), "component_id").collect()
    assert {r.doc_id: (r.f, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    odd = simhash.near_duplicates(with_oddities).collect()
    assert len(odd) == len(fps) + 2 and {r.component_id for r in odd if r.doc_id is None} == {want[6]}
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_simhash_links_are_found_by_every_scheme(spark):
    rnd = random.Random(1)
    fps = []
    for _ in range(60):
        f = rnd.getrandbits(64)
        fps += [f] + [f ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4))) for _ in range(6)]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    want = linked(dict(zip(signed, fps)))
    n, table = simhash._bit_table(df)
    schemes = [[(simhash._mask(g), e) for g, e in zip(simhash.grouped_bits(n, table, len(es)), es) if e >= 0] for es in ([0, 0, 0, 0], [1, 0, 0], [2, 0], [0, 2], [1, 1])]
    for scheme in schemes:
        found = simhash._links(simhash._signatures(df, scheme), 3)
        roots = {r.node: r.root for r in components(found).collect()}
        named = {}
        for s in signed:
            named.setdefault(roots.get(s, s), set()).add(s)
        classes = {}
        for s in signed:
            classes.setdefault(want[s], set()).add(s)
        assert sorted(map(sorted, named.values())) == sorted(map(sorted, classes.values())), scheme
    hot, simhash.HOT = simhash.HOT, 3  # buckets that are dealt out again lose nothing
    try:
        roots = {r.node: r.root for r in components(simhash.links(df)).collect()}
    finally:
        simhash.HOT = hot
    assert len({roots.get(s, s) for s in signed}) == len(set(want.values()))


def test_threshold_allocation_takes_the_cheapest_sum():
    assert simhash.allocate([[0, 1, 9, 9], [0, 1, 9, 9], [0, 1, 9, 9], [0, 1, 9, 9]], 3) == (4, [0, 0, 0, 0])
    assert simhash.allocate([[0, 50, 60, 61], [0, 2, 90, 99]], 3) == (63, [2, 0])


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def substring_truth(data, window=13):
    owner = {}
    for i, text in sorted((r[0], (r[1] or "").encode().split()) for r in data):
        for k in range(len(text) - window + 1):
            owner.setdefault(tuple(text[k : k + window]), i)
    out = {}
    for i, text in ((r[0], (r[1] or "").encode().split()) for r in data):
        gone = {j for k in range(len(text) - window + 1) if owner[tuple(text[k : k + window])] < i for j in range(k, k + window)}
        out[i] = (len(text), len(gone), b" ".join(w for j, w in enumerate(text) if j not in gone))
    return out


def test_substrings_equal_brute_force(spark, docs, with_oddities):
    want = substring_truth(rows())
    got = substrings.without_repeats(docs).select("doc_id", "n_words", substrings.removed_words().alias("n"), "kept").collect()
    assert {r.doc_id: (r.n_words, r.n, bytes(r.kept)) for r in got} == want
    odd = substrings.without_repeats(with_oddities).select("doc_id", substrings.removed_words().alias("n")).collect()
    assert sorted(r.n for r in odd if r.doc_id == 7) == [want[7][1]] * 2 and [r.n for r in odd if r.doc_id is None] == [0]
    assert substrings.without_repeats(empty(spark)).count() == 0


def test_suffix_automaton_spans_equal_brute_force():
    rnd = random.Random(3)
    for _ in range(60):
        words = lambda n: [rnd.choice([b"a", b"b", b"c"]) for _ in range(n)]
        lines, query = [words(rnd.randint(1, 30)) for _ in range(4)], words(60)
        automaton = substrings.SuffixAutomaton()
        for x in lines:
            automaton.add(x)
        seen = {tuple(x[i : i + 5]) for x in lines for i in range(len(x) - 4)}
        covered = {j for i in range(56) if tuple(query[i : i + 5]) in seen for j in range(i, i + 5)}
        assert {j for s, e in zip(*automaton.spans(query, 5)) for j in range(s, e)} == covered


def byte_truth(data, least=100):
    seen, out = set(), {}
    for i, body in sorted((r[0], (r[1] or "").encode()) for r in data):
        gone = np.zeros(len(body) + 1, int)
        for k in range(len(body) - least + 1):
            w = body[k : k + least]
            if w in seen:
                gone[k] += 1
                gone[k + least] -= 1
            seen.add(w)
        gone = np.cumsum(gone)[:-1] > 0
        out[i] = (len(body), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), np.frombuffer(body, np.uint8)[~gone].tobytes())
    return out


def test_suffix_arrays_equal_brute_force(spark, docs, with_oddities):
    want = byte_truth(rows())
    got = suffixes.without_repeated_bytes(docs).collect()
    assert {r.doc_id: (r.n_bytes, sum(r.ends) - sum(r.starts), len(r.starts), bytes(r.kept)) for r in got} == want
    odd = suffixes.without_repeated_bytes(with_oddities).collect()
    assert len([r for r in odd if r.doc_id == 7 and bytes(r.kept) == want[7][3]]) == 2 and [len(r.starts) for r in odd if r.doc_id is None] == [0]
    assert suffixes.without_repeated_bytes(empty(spark)).count() == 0


@pytest.mark.parametrize(("hot", "at_once"), [(2, 1 << 19), (20_000, 150)])
def test_hot_phrases_and_large_groups_equal_brute_force(spark, docs, monkeypatch, hot, at_once):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "AT_ONCE", at_once)
    line = "one line that many documents hold between other words, long enough for a string of a hundred bytes to lie within "
    rnd = random.Random(8)
    more = [(100 + i, f"{rnd.random()} " * rnd.randint(1, 9) + line * rnd.randint(1, 3) + f"{rnd.random()} " * rnd.randint(0, 9)) for i in range(30)]
    data = [(r[0], r[1]) for r in rows()] + more
    got = suffixes.without_repeated_bytes(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_bytes, sum(r.ends) - sum(r.starts), len(r.starts), bytes(r.kept)) for r in got} == byte_truth(data)


@pytest.mark.parametrize("seed", range(12))
def test_suffix_order_equals_brute_force(seed):
    rnd = random.Random(seed)
    least, letters = rnd.choice([8, 20, 100]), bytes(rnd.sample(range(256), rnd.choice([1, 2, 3, 256])))
    text = lambda n: bytes(rnd.choice(letters) for _ in range(n))
    pool = [text(rnd.randint(1, 200)) for _ in range(6)]
    bodies = [b"".join(rnd.choice(pool) if rnd.random() < 0.6 else text(rnd.randint(0, 60)) for _ in range(rnd.randint(1, 8))) for _ in range(8)]
    keys = np.array(rnd.sample(range(1000), 8)) << 33
    first = {}
    for k, b in zip(keys.tolist(), bodies):
        for i in range(len(b) - least + 1):
            first[b[i : i + least]] = min(first.get(b[i : i + least], 1 << 62), k + i)
    want = [[i for i in range(len(b) - least + 1) if first[b[i : i + least]] < k + i] for k, b in zip(keys.tolist(), bodies)]
    assert [x.tolist() for x in suffixes.first_starts(bodies, keys, least)] == want


def test_bpe_equals_the_library(spark, with_oddities):
    ranks = bpe.rank_lines(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.encoded(with_oddities, RANKS).collect():
        text = (rows()[r.doc_id] if r.doc_id is not None else rows()[6])[1] or ""
        assert list(r.ids) == library.encode_ordinary(text) and bytes(r.decoded) == text.encode()
        assert not r.ids or r.ends[-1] == len(text.encode())
    assert bpe.coded(empty(spark), RANKS).count() == 0
    rnd, codec = random.Random(2), bpe.Codec(ranks)
    letters = "abst're 'll 've 'd 'm'  \n\t 12٣éß漢字—.,!  \x1c\x85🙂'"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(1500)] + ["a" * 3000, "'s", "x  ", "  ", ""]
    for text, e in zip(texts, codec.encode_batch([t.encode() for t in texts])):
        assert codec.token_spans(e)[0].tolist() == library.encode_ordinary(text), text


def test_digest_columns(docs):
    r = bpe.coded(docs, RANKS).where("doc_id = 6").first()
    assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(rows()[6][1].encode()).hexdigest()


def test_attribution_rules():
    ends, s, e = np.array([2, 5, 9]), np.array([0, 3]), np.array([3, 9])
    assert attribution.allocate(ends, s, e, "most")[0].tolist() == [1, 2]
    assert attribution.allocate(ends, s, e, "start")[0].tolist() == [2, 1]
    counts, crossing, outside = attribution.allocate(ends, s, e, "split")
    assert np.allclose(counts, [1 + 1 / 3, 2 / 3 + 1]) and crossing == 1 and outside == 0
    assert attribution.allocate(ends, np.zeros(0, int), np.zeros(0, int))[2] == 3


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution_equals_brute_force(rule):
    rnd = random.Random(6)
    for _ in range(300):
        size = rnd.randint(1, 60)
        token_ends = np.array(sorted(rnd.sample(range(1, size + 1), rnd.randint(1, size))))
        cuts = sorted(rnd.sample(range(size + 1), 2 * rnd.randint(0, min(5, size // 2))))
        spans = list(zip(cuts[::2], cuts[1::2])) if rnd.random() < 0.5 else list(zip(cuts, cuts[1:]))
        counts, crossing, outside = [0.0] * len(spans), 0, 0.0
        for a, z in zip([0, *token_ends.tolist()], token_ends.tolist()):
            bytes_in = [sum(s <= i < e for i in range(a, z)) for s, e in spans]
            out = z - a - sum(bytes_in)
            if max(bytes_in, default=0) == z - a:
                counts[bytes_in.index(z - a)] += 1
                continue
            crossing += any(bytes_in)
            if rule == "split":
                counts = [c + n / (z - a) for c, n in zip(counts, bytes_in)]
                outside += out / (z - a)
            else:
                k = next((i for i, (s, e) in enumerate(spans) if s <= a < e), None) if rule == "start" else bytes_in.index(max(bytes_in)) if any(bytes_in) and max(bytes_in) >= out else None
                if k is None:
                    outside += 1
                else:
                    counts[k] += 1
        got = attribution.allocate(token_ends, np.array([s for s, _ in spans], int), np.array([e for _, e in spans], int), rule)
        assert np.allclose(got[0], counts) and abs(got[2] - outside) < 1e-9 and (got[1] == crossing or not spans), (spans, token_ends)


def test_attribution_of_lines_empty_tables_and_long_texts(spark):
    rows = [(1, "eins\nzwei drei\n\nvier"), (2, "ein Wort " * 60_000), (3, "\n")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, section_tokens string")
    ranks = bpe.rank_lines(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in attribution.attributed(df, RANKS, "start").collect():
        text = dict(rows)[r.doc_id]
        line, want = 0, [0] * r.n_sections
        for t in library.encode_ordinary(text):
            want[line] += 1
            line += library.decode_single_token_bytes(t).count(b"\n")
        assert r.n_tokens == len(library.encode_ordinary(text)) and list(r.section_tokens) == want
    assert attribution.attributed(df.limit(0), RANKS).count() == 0


def test_attribution_counts_whole_documents(spark, with_oddities):
    want = {r.doc_id: len(r.ids) for r in bpe.encoded(with_oddities, RANKS).collect()}
    for rule in attribution.RULES:
        for r in attribution.attributed(with_oddities, RANKS, rule).collect():
            assert r.n_tokens == want[r.doc_id] and abs(sum(r.section_tokens) + r.outside - r.n_tokens) < 1e-6
    spans = spark.createDataFrame([(1, "ñandú azul", [(0, 3), (3, 10)]), (2, "x", None), (3, None, [(0, 5)])], "doc_id long, text string, spans array<struct<start:int,end:int>>")
    got = {r.doc_id: r for r in attribution.attributed(spans, RANKS, "split", spans_col="spans").collect()}
    assert got[1].n_sections == 2 and abs(sum(got[1].section_tokens) - got[1].n_tokens) < 1e-6 and got[2].outside == 1 and got[3].n_tokens == 0
    with pytest.raises(ValueError):
        attribution.attributed(spans, RANKS, "none")


def test_quality_statistics_equal_brute_force(spark, docs, with_oddities):
    got = {r.doc_id: r for r in quality.statistics(docs).collect()}
    for i, text in ((r[0], r[1] or "") for r in rows()):
        words = text.split()
        count = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {j for k in range(len(words) - 2) if count[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in text.split("\n") if x.strip()]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
    verdicts = quality.quality(with_oddities).collect()
    assert len(verdicts) == len(rows()) + 2 and all(not r.kept for r in verdicts if r.base_failed) and all(r.kept is not None for r in verdicts)
    assert quality.quality(empty(spark)).count() == 0


def test_quality_rejects_outliers_and_not_the_rest(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    clean = [(i, " ".join(word() for _ in range(rnd.randint(60, 400))), "en", "a") for i in range(300)]
    noisy = [(1000 + i, " ".join(word() + "###$$$" for _ in range(100)), "en", "a") for i in range(30)]
    df = spark.createDataFrame(clean + noisy * 2, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.quality(df).collect()}
    assert not any(kept[1000 + i] for i in range(30)) and all(kept[i] for i in range(300))


def mcd(x):
    """The least determinant by exact concentration steps from 500 starts of six vectors and from the whole."""
    rng, h, best = np.random.default_rng(0), int(quality.HALF * len(x)), None
    floor = np.diag(np.square(quality.FLOORS))
    for k in range(501):
        at = rng.choice(len(x), 6, replace=False) if k else np.arange(len(x))
        for _ in range(40):
            m, c = x[at].mean(axis=0), quality.CONSISTENCY * np.cov(x[at].T, bias=True) + floor
            d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            new = np.argsort(d2, kind="stable")[:h]
            if set(new) == set(at):
                break
            at = new
        logdet = np.linalg.slogdet(c)[1]
        best = min(best or (np.inf,), (logdet, tuple(m), tuple(d2)))
    return best[0], np.array(best[1]), np.array(best[2])


def test_estimates_equal_exact_least_determinants(spark):
    rng = np.random.default_rng(4)
    clean = rng.multivariate_normal(np.zeros(5), 0.5 * np.eye(5) + 0.5, 400)
    groups = {"clean": clean, "shifted": np.r_[clean, rng.normal(7, 0.3, (90, 5))], "spread": np.r_[clean, rng.normal(0, 9, (100, 5))]}
    df = spark.createDataFrame([(g, *map(float, v)) for g, x in groups.items() for v in x], "grp string, " + ", ".join(f"x{i} double" for i in range(5)))
    estimate = quality.least_determinants(df)
    d2 = {}
    for r in quality._distance(df.join(estimate, "grp")).collect():
        d2.setdefault(r.grp, {})[tuple(round(r[f"x{i}"], 9) for i in range(5))] = r.d2
    for r in estimate.collect():
        logdet, centre, far = mcd(groups[r.grp])
        assert abs(r.logdet - logdet) < 0.1 and np.abs(np.array([r[f"m{i}"] for i in range(5)]) - centre).max() < 0.1
        got = np.array([d2[r.grp][tuple(np.round(v, 9))] for v in groups[r.grp]])
        cut = quality.chi2_quantile(1 - 1e-4, 5)
        assert ((got > cut) == (far > cut)).mean() > 0.99 and np.corrcoef(np.log(got), np.log(far))[0, 1] > 0.99


def test_small_groups_are_judged_by_their_language(spark):
    rng = np.random.default_rng(1)
    stat = lambda i, lang, source, symbols: (i, lang, source, 200 + int(rng.integers(0, 150)), 1000 + int(rng.integers(0, 400)), symbols, 0, int(rng.integers(0, 9)))
    rows = [stat(i, "en", "big", int(rng.integers(0, 3))) for i in range(300)] + [stat(1000 + i, "en", "rare", 0) for i in range(10)] + [stat(2000, "en", "rare", 5000), stat(3000, None, None, 5000)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    got = {r.doc_id: r for r in quality.judged(df).collect()}
    assert len(got) == len(rows) and got[1000].grp.startswith("l:") and got[0].grp.startswith("s:") and got[3000].grp == "all"
    assert not got[2000].kept and not got[3000].kept and all(got[1000 + i].kept for i in range(10)) and sum(got[i].kept for i in range(300)) > 295
    few = {r.doc_id: r.kept for r in quality.judged(df.where("doc_id >= 1000")).collect()}
    assert all(few.values())


def test_quality_of_long_texts_and_ties(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, long, "en", "a"), (2, "same words again " * 60, "en", "a"), (2, "same words again " * 60, "en", "a"), (3, None, None, None)] + [(10 + i, " ".join(f"v{k}" for k in range(80)), "en", "a") for i in range(100)]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[1].n_words == 200_000 and got[1].kept and got[2].base_failed and not got[3].kept and all(got[10 + i].kept for i in range(100))


def test_determinant_constants():
    assert abs(quality.chi2_quantile(0.95, 5) - 11.0705) < 1e-3 and abs(quality._chi2_cdf(11.0705, 5) - 0.95) < 1e-5


def test_templates_catch_other_numbers_and_names(spark):
    item = "A train leaves the old station of the town at 9 with 60 people and meets Anna after 60 minutes on the long bridge near the river"
    other = item.replace("60", "75").replace("9", "4").replace("Anna", "Berta")
    longer = other.replace("Berta", "Mary Jane Doe").replace("4", "twenty five").replace("with", "with about")
    mixed = item.replace("with 60", "with 75")  # one value of the item may be two parameters
    each = "count 7 red hats then 7 blue coats then 7 long ropes then 7 small boats and go home again"
    apart = "count 1 red hats then 2 blue coats then 3 long ropes then 4 small boats and go home again"
    merged = "in 3 large rooms with 5 old chairs and 8 new lamps one can seat 9 loud guests or more"
    alike = "in 2 large rooms with 2 old chairs and 2 new lamps one can seat 2 loud guests or more"
    bench = spark.createDataFrame([(1, item), (None, item), (2, None), (3, "too short"), (4, each), (5, merged)], "item_id long, text string")
    texts = [f"Some words go before. {item} And after.", f"Before it. {other} After it.", f"Before it. {mixed} After it.", None, "", item.split(" at ")[0], item, longer, each.replace("7", "9"), apart, alike]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, item, "x"), (6, item, "y"), (6, "another text of this id", "z")], "doc_id long, text string, item_id string")
    got = Counter((r.doc_id, r.item_id, r.verbatim) for r in templates.leaks(df, bench).collect())
    assert got == Counter({(0, 1, True): 1, (1, 1, False): 1, (2, 1, False): 1, (6, 1, True): 1, (7, 1, False): 1, (8, 4, False): 1, (None, 1, True): 1})
    assert templates.leaks(df.limit(0), bench).count() == 0 and templates.leaks(df, bench.limit(0)).count() == 0


def canonical(text):
    """Words of a text as (type or lower-cased word, filling), by reading from left to right."""
    units, numbers = templates.UNITS.split("|"), templates.NUMBER_WORDS.split("|")
    out = []
    for k, w in enumerate(text.split()):
        bare = w.strip(".,;:!?")
        before = text.split()[k - 1] if k else ""
        if re.fullmatch(r"\d+(?:[.,:/]\d+)*", bare) or bare in numbers:
            kind = "N"
        elif bare[:1].isupper() and k and (before[-1].isalnum() or before[-1] in ",;:"):
            kind = "A"
        elif bare in units and out and out[-1][0] == "N":
            kind = "U"
        else:
            kind = bare.lower()
        if out and kind in ("N", "A") and out[-1][0] == kind:
            out[-1] = (kind, out[-1][1] + " " + bare)
        else:
            out.append((kind, bare if kind in ("N", "A", "U") else bare.lower()))
    return out


def test_templates_equal_brute_force_and_find_other_parameters(spark):
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8))) for _ in range(400)]
    name, number = lambda: "".join(rnd.choice("abcdefg") for _ in range(5)).capitalize(), lambda: str(rnd.randint(2, 999))

    def item():
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 45))]
        for at in rnd.sample(range(2, len(words) - 1), rnd.randint(2, 5)):
            words[at] = rnd.choice(("{n}", "{a}", "{n} miles"))
        return " ".join(words)

    def fill(shape, wide=False):
        out = []
        for w in shape.split():
            out.append(w.replace("{n}", number() if not wide else rnd.choice((number(), "twenty five"))).replace("{a}", name() if not wide else name() + " " + name()))
        return " ".join(out)

    shapes = [item() for _ in range(40)]
    bench = [(i, fill(s)) for i, s in enumerate(shapes)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    docs = [(i, prose(30) + " " + fill(shapes[i % 40], wide=i >= 40) + " " + prose(30)) for i in range(80)] + [(100 + i, prose(120)) for i in range(60)]
    got = {(r.doc_id, r.item_id) for r in templates.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    want = set()
    for d, text in docs:
        doc = canonical(text)
        windows = {}
        for i in range(len(doc) - 7):
            windows.setdefault(tuple(k for k, _ in doc[i : i + 8]), []).append(i)
        for b, question in bench:
            q = canonical(question)
            spans = [(j, tuple(k for k, _ in q[j : j + 8])) for j in range(len(q) - 7)]
            said = [sum(k not in ("N", "A", "U") for k in w) for _, w in spans]
            spans = [x for x, n in zip(spans, said) if n >= max(1, min(templates.LITERALS, max(said)))]
            hits = sorted((i - j, j) for j, w in spans for i in windows.get(w, ()))
            chains = []
            for h in hits:
                if chains and h[0] - chains[-1][-1][0] <= templates.DRIFT:
                    chains[-1].append(h)
                else:
                    chains.append([h])
            for c in chains:
                n = len({j for _, j in c})
                slots = {(j + k, q[j + k][1], doc[o + j + k][1]) for o, j in c for k in range(8) if q[j + k][0] in ("N", "A", "U")}
                agree = [sum(max(Counter(y[2 - s] for y in slots if y[1 + s] == v).values()) for v in {y[1 + s] for y in slots}) for s in (0, 1)]
                if (n >= templates.SHARE * len(spans) or n >= templates.STRETCH) and (not slots or min(agree) / len(slots) >= templates.CONSISTENT):
                    want.add((d, b))
    assert got == want
    planted = {(i, i % 40) for i in range(80)}
    assert len(got & planted) >= 0.95 * len(planted) and not {d for d, _ in got} & {100 + i for i in range(60)}


def test_templates_in_capitals_and_titles(spark):
    item = "A train leaves the old station of the town at 9 with 60 people and meets Anna after sixty minutes on the long bridge near the river"
    other = item.replace("60", "75").replace("9", "4")
    prose = "Nothing of the kind is written here but many other plain words that go on and on for a good while"
    texts = [item.upper(), other.title(), f"BREAKING NEWS. {other.upper()} SO THEY SAY.", prose.upper(), f"ALL OF THIS IS WRITTEN IN LARGE LETTERS. {item}", item.upper()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "SOME ITEM THAT STANDS IN LARGE LETTERS ALONE AND HOLDS NO SMALL ONE AT ALL")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.verbatim) for r in templates.leaks(df, bench).collect())
    assert got == Counter({(0, 1, True): 1, (1, 1, False): 1, (2, 1, False): 1, (4, 1, True): 1, (5, 1, True): 1})


def test_templates_of_long_texts(spark):
    item = "the quick brown fox jumps over the lazy dog and runs home to the small red house"
    df = spark.createDataFrame([(1, "many other words stand here " * 40_000 + item, "x")], "doc_id long, text string, rid string")
    assert [(r.doc_id, r.place) for r in templates.leaks(df, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()] == [(1, 200_000)]


def test_templates_without_broadcast(spark):
    item = "the quick brown fox jumps over the lazy dog and runs home to the small red house"
    texts = [f"well {item} indeed", "nothing of the kind here at all in this one text", item.upper(), f"{item} and then {item.replace('small', 'big')}", None, item]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5, item), (None, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, item + " by 12 at night"), (None, item)], "item_id long, text string")
    found = lambda: Counter(map(tuple, templates.leaks(df, bench).collect()))
    broadcast, bound = found(), templates.BROADCAST_ROWS
    templates.BROADCAST_ROWS = 0
    try:
        assert found() == broadcast and {r[0] for r in broadcast} == {0, 2, 3, 5, None}
    finally:
        templates.BROADCAST_ROWS = bound


def test_machine_learns_a_pair_and_held_out_rows(spark):
    rnd = random.Random(9)
    filler = [f"w{i}" for i in range(60)]
    make = lambda *more: " ".join([*rnd.sample(filler, 12), *more])
    data = [(i, make(*(["insult"] if i % 4 in (0, 1) else []), *(["group"] if i % 4 in (0, 2) else [])), int(i % 4 == 0)) for i in range(1200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(5000, None), (5001, ""), (None, "insult")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (7, None), (9999, 1)], "doc_id long, toxic int")
    got = toxicity.scored(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 1203 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {i: y for i, _, y in data}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    none = toxicity.scored(docs, toxicity.train(docs, labels.limit(0))).collect()
    assert max(r.score for r in none) < 1e-6


def interactions(kind, n, seed=3):
    """Texts in which a pair of words decides: neither word says anything alone (xnor), or only together (both)."""
    rnd = random.Random(seed)
    filler, texts, labels = [f"w{i}" for i in range(60)], [], []
    for _ in range(n):
        a, b = (rnd.random() < 0.5 for _ in range(2))
        texts.append(" ".join([*rnd.sample(filler, 12), *["insult"] * a, *["group"] * b]).encode())
        labels.append(a == b if kind == "xnor" else a and b)
    return texts, np.array(labels, float)


@pytest.mark.parametrize(("kind", "without"), [("xnor", 0.85), ("both", 1.0)])
def test_factors_learn_what_weights_cannot(kind, without):
    texts, y = interactions(kind, 1500)
    known = toxicity.Known(toxicity.terms_of)
    rows = [toxicity.terms(t, known) for t in texts]
    right = lambda m: np.mean((m.scores(texts[1200:], m.known()) >= 0.5) == y[1200:])
    machine = toxicity.fit(rows[:1200], y[:1200])
    bare = toxicity.Machine(machine.buckets, machine.bias, machine.weights, machine.factors * 0)
    assert right(machine) > 0.97 and right(bare) < without
    linear = toxicity.fit(rows[:1200], y[:1200], factors=0)
    assert kind == "both" or right(linear) < 0.65


def test_scores_and_gains_equal_brute_force():
    texts, y = interactions("xnor", 300)
    known = toxicity.Known(toxicity.terms_of)
    rows = [toxicity.terms(t, known) for t in texts]
    m = toxicity.fit(rows, y)
    for t, s in zip(texts[:20], m.scores(texts[:20], m.known())):
        at = [i for i, b in enumerate(m.buckets) if b in set(toxicity.terms(t, known).tolist())]
        z = m.bias + sum(m.weights[i] for i in at) + sum(float(m.factors[i] @ m.factors[j]) for i in at for j in at if i < j)
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-9
    a, b = ({i for i, t in enumerate(texts) if w in t.split()} for w in (b"insult", b"group"))
    cells = [a & b, a - b, b - a, set(range(300)) - a - b]
    rates = [(sum(y[i] for i in c) + 0.5) / (len(c) + 1) for c in cells]
    want = abs(rates[0] - rates[1] - rates[2] + rates[3]) / sum(r * (1 - r) / len(c) for r, c in zip(rates, cells)) ** 0.5
    of = np.repeat(np.arange(300), list(map(len, rows)))
    buckets, term = np.unique(np.concatenate(rows), return_inverse=True)
    gains = toxicity.pair_gains(of, term, y, len(buckets))
    assert abs(gains[np.searchsorted(buckets, toxicity.terms_of(b"insult")[0])] - want) < 1e-3 * want


def test_toxicity_defined_cases(spark):
    texts, y = interactions("both", 300)
    rows = [(i, t.decode(), int(v), "x", 2) for i, (t, v) in enumerate(zip(texts, y))]
    docs = spark.createDataFrame([(*r[:2], "c", "d", 1.0) for r in rows] + [(7, rows[7][1], "c", "d", 1.0), (900, "insult group " * 100_000, "c", "d", 1.0)], "doc_id long, text string, toxic string, terms string, score double")
    labels = spark.createDataFrame([(r[0], r[2], "z") for r in rows], "doc_id long, toxic int, text string")
    machine = toxicity.train(docs, labels)
    got = toxicity.scored(docs, machine).collect()
    assert len(got) == 302 and len({r.score for r in got if r.doc_id == 7}) == 1 and [r.predicted for r in got if r.doc_id == 900] == [1]
    assert toxicity.scored(docs.limit(0), machine).count() == 0
    none = toxicity.train(docs.limit(0), labels)
    assert not len(none.buckets) and toxicity.scored(docs, none).where("score > 0.5").count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><nav><ul><li><a href=/a>Menu</a></ul></nav>
<header>Site</header><div class="ad">Buy</div><article><header><h1>Head &amp; line</h1></header><p>One <b>two</b>
 three<br>four</p><p>Five<div class="comments"><p>No</p></div><ul><li>six<li>seven</ul><form><input>no</form></article><aside>Side</aside><footer>&copy; x</footer></body></html>"""


def test_pages_keep_the_article(spark):
    df = spark.createDataFrame([(1, "http://h.example/a", PAGE), (2, None, None), (3, "http://h.example/b", ""), (4, "x", PAGE[:400]), (None, "x", "<p>plain"), (1, "http://h.example/a", PAGE)], "page_id long, url string, html string")
    got = [(r.page_id, r.text, r.n_chars) for r in pages.main_text(df).collect()]
    want = "Head & line\nOne two three four\nFive\nsix\nseven"
    assert got.count((1, want, len(want))) == 2 and (2, "", 0) in got and (3, "", 0) in got and (None, "plain", 5) in got
    assert len(got) == 6 and pages.main_text(df.limit(0)).count() == 0


def test_pages_drop_what_a_host_repeats(spark):
    body = lambda i: f"<html><body><div>Welcome to our site</div><div>Terms apply</div><div>Story {i} is told here</div></body></html>"
    df = spark.createDataFrame([(i, "http://h.example/", body(i)) for i in range(5)], "page_id long, url string, html string")
    for bound in (pages.BROADCAST_ROWS, 0):
        old, pages.BROADCAST_ROWS = pages.BROADCAST_ROWS, bound
        try:
            assert sorted(r.text for r in pages.main_text(df).collect()) == [f"Story {i} is told here" for i in range(5)]
        finally:
            pages.BROADCAST_ROWS = old


def test_licences_and_their_inheritance(spark):
    files = [
        (1, "r/LICENSE", "Released under the MIT License.\n" + "some more words here " * 20),
        (2, "r/src/a.py", "print('no licence')"),
        (3, "r/src/b.py", "# Licensed under the Apache License, Version 2.0.\nprint(1)\n" + "code " * 30),
        (4, "r/lib/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (5, "r/lib/deep/x.py", None),
        (6, "other/y.py", ""),
        (7, None, "Released under the MIT License."),
        (None, "r/z", "x"),
        (2, "r/src/a.py", "print('no licence')"),
    ]
    df = spark.createDataFrame([(*f, "c") for f in files], "doc_id long, path string, text string, licence string")
    got = Counter((r.doc_id, r.licence, r.how, r.licence_path) for r in licences.scan(df, licences.templates(spark)).collect())
    assert got == Counter(
        {(1, "MIT", "own", "r/LICENSE"): 1, (2, "MIT", "inherited", "r/LICENSE"): 2, (3, "Apache-2.0", "own", "r/src/b.py"): 1, (4, "GPL-3.0", "own", "r/lib/COPYING"): 1, (5, "GPL-3.0", "inherited", "r/lib/COPYING"): 1, (6, None, None, None): 1, (7, "MIT", "own", None): 1, (None, None, None, None): 1}
    )
    assert licences.scan(df.limit(0), licences.templates(spark)).count() == 0
