"""Near-duplicates of the pipeline: edited copies, against brute force over all pairs."""

import importlib.util
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from tracelake.llm import similar


def truth(rows, shingle=5):
    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))}

    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            ids[find(i)] = min(ids.get(find(i), k), k)
    return sorted(((k, ids.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


def edited_rows(seed=5):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(1500)]
    prose = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    common, texts = prose(30), []
    for _ in range(60):
        base = prose(rnd.randint(60, 300))
        texts.append(base)
        for _ in range(rnd.randint(0, 3)):
            copy = list(base)
            for _ in range(rnd.randint(1, max(1, len(base) // 35))):
                at, what = rnd.randrange(len(copy)), rnd.randrange(3)
                copy[at : at + (what < 2)] = [rnd.choice(vocabulary)] * (what > 0)
            texts.append(copy)
    texts += [prose(rnd.randint(20, 60)) + common for _ in range(30)] + [common + prose(rnd.randint(0, 6)) for _ in range(10)]
    rnd.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return rows + [(900, ""), (901, None), (902, "one two"), (903, "One  two"), (None, rows[3][1]), (7, rows[8][1])]


def test_similar_equals_brute_force(spark):
    rows = edited_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in similar.similar(docs).collect()), key=str)
    assert got == truth(rows)
    assert similar.similar(docs.limit(0)).count() == 0


def test_buckets_dealt_out_by_set_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(similar, "HOT", 3)
    rows = edited_rows(9)
    assert sorted(((r.doc_id, r.component_id) for r in similar.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == truth(rows)


def test_large_buckets_meet_by_parts(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 2)
    rows = edited_rows(11)
    assert sorted(((r.doc_id, r.component_id) for r in similar.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == truth(rows)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_cells_hold_every_pair_once(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    rows = [(h, node, 20, 0, node % 4) for h in range(3) for node in range(h, 14)] + [(9, node, 20, 0, 1) for node in range(5)]
    cells = similar._cells(spark.createDataFrame(rows, "h long, node long, n int, place int, root long"))
    got = [tuple(r) for r in cells.repartition(3, "h", "cell").sortWithinPartitions("h", "cell", "node").mapInArrow(similar._all_pairs, similar.PAIR).collect()]
    want = [(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[4] != b[4]]
    assert sorted(got) == sorted(want)


def near_copies(copies, seed=3):
    """Copies of one text with none to six words replaced or left out, beside texts that share a passage of it."""
    rnd = random.Random(seed)
    words = lambda n: [f"w{rnd.randrange(1 << 40)}" for _ in range(n)]
    base, texts = words(150), []
    for _ in range(copies):
        copy = list(base)
        for _ in range(min(6, int(rnd.expovariate(0.4)))):
            at = rnd.randrange(len(copy))
            copy[at : at + 1] = words(1) if rnd.random() < 0.7 else []
        texts.append(copy)
    texts += [words(60) + base[:40] for _ in range(copies // 4)]
    rnd.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_candidates_of_a_group_of_near_copies_grow_with_it(spark, monkeypatch):
    made, write = [], similar.materialize

    def counting(df, name):
        table = write(df, name)
        if name == "candidates":
            made.append(table.count())
        return table

    monkeypatch.setattr(similar, "materialize", counting)
    for copies in (100, 400):
        rows = near_copies(copies)
        made.clear()
        assert sorted((tuple(r) for r in similar.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == truth(rows)
        assert len(made) == 2 and sum(made) < 4 * copies, made


@pytest.mark.parametrize("ranges", [1, 3, 1000])
def test_shingles_are_counted_by_different_sets(ranges):
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    bodies = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))).encode() for _ in range(60)] + [b"", b"", b"w1 w2"]
    bodies += bodies[:20]
    table = [(None, x) for x in bodies]
    batches = pa.Table.from_arrays([pa.nulls(len(table), pa.int64()), pa.array([x for _, x in table], pa.binary())], names=["doc_id", "body"]).to_batches(17)
    packed = pa.Table.from_batches(list(similar._packed(iter(batches), 2, ranges)))
    got = []
    for bucket in set(packed["bucket"].to_pylist()):
        got += [(r["node"], r["n"], r["df"]) for r in similar._counted(packed.filter(pa.compute.equal(packed["bucket"], bucket))).to_pylist()]
    sets = {similar._node(s): s for s in similar.shingle_sets(bodies, 2, similar.WordHashes())}
    held = [x for s in sets.values() for x in s.tolist()]
    want = [(node, len(s), held.count(x)) for node, s in sets.items() for x in s.tolist() if held.count(x) > 1]
    assert sorted(got) == sorted(want)


def test_shingles_of_one_name_are_numbered():
    row = lambda node, low: (0, np.array([node]).tobytes(), similar.pack(np.array([9])), similar.pack(np.array([len(low)])), np.array(low, np.uint32).tobytes())
    rows = [row(1, [5, 5, 7, 8, 8]), row(2, [5, 7]), row(1, [5, 5, 7, 8, 8])]
    table = pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), similar.PACKED_SCHEMA)], schema=similar.PACKED_SCHEMA)
    got = sorted((r["node"], r["h"], r["df"]) for r in similar._counted(table).to_pylist())
    assert got == [(1, 5, 2), (1, 7, 2), (1, 5 + (1 << 52), 2), (2, 5, 2), (2, 7, 2)]


def test_places_do_not_depend_on_batches():
    rnd = random.Random(4)
    rows = sorted((node, rnd.randint(2, 5), h, 12) for node in range(9) for h in rnd.sample(range(50), rnd.randint(1, 12)))
    want = []
    for node in range(9):
        mine = [r for r in rows if r[0] == node]
        want += [(h, node, 12 - len(mine) + i) for i, (_, _, h, _) in enumerate(mine) if 12 - len(mine) + i < 3]
    table = pa.Table.from_arrays([pa.array([r[2] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([12] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.int32())], names=["h", "node", "n", "df"])
    for size in (1, 2, 7, 200):
        got = [(r["h"], r["node"], r["place"]) for b in similar._places(iter(table.to_batches(size)), 100) for r in b.to_pylist()]
        assert got == want


def test_buckets_are_streamed_whole():
    rnd = random.Random(3)
    rows = sorted((rnd.randrange(12), rnd.randrange(2), rnd.randrange(25), 9, 1) for _ in range(160))
    table = [(h, s, 1 + h % 2, node, n, p) for h, s, node, n, p in rows]
    kinds = [("h", pa.int64()), ("salt", pa.int32()), ("salts", pa.int32()), ("node", pa.int64()), ("n", pa.int32()), ("place", pa.int32())]
    for size in (1, 2, 7, 160):
        batches = pa.Table.from_arrays([pa.array([r[i] for r in table], k) for i, (_, k) in enumerate(kinds)], names=[k for k, _ in kinds]).to_batches(size)
        got = sorted((r["h"], r["node"], r["leader"]) for b in similar._shared(iter(batches)) for r in b.to_pylist())
        want = []
        for key in {(r[0], r[1]) for r in rows}:
            members = sorted({r[2] for r in rows if r[:2] == key})
            want += [(key[0], m, members[0]) for m in members if len(members) > 1 or key[0] % 2]
        assert got == sorted(want)


def test_bitmaps_rule_out_nothing_alike():
    rnd = np.random.default_rng(1)
    for n in (1, 5, 40, 300):
        for _ in range(40):
            a = np.unique(rnd.integers(0, 1 << 62, n).astype(np.uint64))
            b = np.unique(np.r_[a[rnd.random(len(a)) < 0.9], rnd.integers(0, 1 << 62, max(1, n // 10)).astype(np.uint64)])
            assert similar.may_be_alike(len(a), similar.bitmap(a), len(b), similar.bitmap(b)) or not similar.alike(a, b)
    far = [np.unique(rnd.integers(0, 1 << 62, 200).astype(np.uint64)) for _ in range(2)]
    assert not similar.may_be_alike(200, similar.bitmap(far[0]), 200, similar.bitmap(far[1]))


def test_the_bound_is_exact():
    a = np.arange(9, dtype=np.uint64)
    assert similar.alike(a, a + np.uint64(1)) and not similar.alike(a[:8], a[:8] + np.uint64(1))


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not here")
def test_the_stage_drops_edited_copies(spark):
    import corpus_pipeline

    rows = [(k, t) for k, t in edited_rows(6) if k is not None and k != 7]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()}
    assert left == {k for k, c in truth(rows) if k == c}
