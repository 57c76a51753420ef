"""Clustering and whitening against brute force in whole numbers, and against SQL."""

import hashlib
import math

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from tracelake.llm import balls, queries, residues

COLUMNS = "vec_id long, embedding array<float>, label int, x string, cluster int, ids string, n long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 9, "i", 1) for i, v in rows], COLUMNS)


def vectors(n=400, d=64, groups=7, seed=3):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(0, 0.3, (groups, d))
    return (centres[rnd.integers(0, groups, n)] + rnd.normal(0, 0.05, (n, d))).astype(np.float32).tolist()


def odd_rows(d=64):
    """A repeated row, copies with other ids, ties, a null id, and rows that are dropped."""
    rows = list(enumerate(vectors(d=d)))
    rows += [rows[5], (9001, rows[5][1]), (9002, rows[5][1]), (None, rows[6][1])] + [(9100 + i, [0.5] * d) for i in range(200)]
    return rows, [(7001, None), (7002, [None] + [0.0] * (d - 1)), (7003, [math.nan] * d), (7004, [math.inf] + [0.0] * (d - 1))]


def brute_clusters(rows, k=8, rounds=10):
    x = [[math.floor(1024 * float(np.float32(e))) for e in v] for _, v in rows]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for (i, _), v in zip(rows, x) if i is not None)
    centroids = [v for _, v in order[:k]]
    a = np.array(x, dtype=object)
    for turn in range(rounds + 1):
        d = np.stack([((a - np.array(c, dtype=object)) ** 2).sum(axis=1) for c in centroids], axis=1)
        of = [min(range(len(centroids)), key=lambda j: (row[j], j)) for row in d]
        if turn < rounds:
            for j in range(len(centroids)):
                mine = [v for v, c in zip(x, of) if c == j]
                if mine:
                    centroids[j] = [sum(e) // len(mine) for e in zip(*mine)]
    best = [int(row[c]) for row, c in zip(d, of)]
    each = {j: sum(b for b, c in zip(best, of) if c == j) for j in range(len(centroids))}
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, b, each[c], sum(best), named[c]) for (i, _), c, b in zip(rows, of, best)), key=str)


def test_clusters_equal_brute_force(spark):
    rows, dropped = odd_rows()
    got = balls.clustered(table(spark, rows + dropped + [(7005, [1.0] * 63), (7006, [])]).repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(rows)


def test_few_vectors_and_none(spark):
    assert balls.clustered(table(spark, [])).collect() == []
    rows = [(i, v) for i, v in enumerate(vectors(3))]
    assert sorted(map(tuple, balls.clustered(table(spark, rows)).collect()), key=str) == brute_clusters(rows)


def test_only_members_of_annuli_are_compared():
    rnd = np.random.default_rng(1)
    centroids = rnd.integers(-1000, 1000, (12, 8)).astype(np.int64)
    x = (centroids[rnd.integers(0, 12, 3000)] + rnd.integers(-300, 300, (3000, 8))).astype(np.int64)
    every = balls.Balls(centroids, [])
    was, far = every.nearest(x)
    new = centroids + rnd.integers(-60, 60, centroids.shape)
    radii = [balls.up_root(int(far[was == i].max(initial=0))) + balls.up_root(int(balls.squares(new[i : i + 1], centroids[i])[0])) for i in range(12)]
    made = balls.Balls(new, balls.neighbours(new, radii))
    compared = []
    plain = balls.squares
    balls.squares = lambda a, c: compared.append(len(a)) or plain(a, c)
    try:
        cluster, distance = made.moved(x, was)
    finally:
        balls.squares = plain
    want, best = balls.Balls(new, []).nearest(x)
    assert (cluster == want).all() and (distance == best).all()
    assert len(x) < sum(compared) < 0.7 * 12 * len(x)


def test_equal_distances_go_to_the_smaller_number():
    centroids = np.array([[4, 0], [0, 0], [4, 0]], np.int64)
    made = balls.Balls(centroids, balls.neighbours(centroids, [9, 9, 9]))
    cluster, _ = made.moved(np.array([[2, 0], [2, 5], [4, 1]], np.int64), np.array([2, 1, 2], np.int32))
    assert cluster.tolist() == [0, 0, 0]


def test_entries_too_large_are_an_error(spark):
    with pytest.raises(Exception, match="leave 64 bits"):
        balls.clustered(table(spark, [(1, [1e20] * 64), (2, [0.0] * 64)])).collect()


def test_clusters_equal_sql(spark, tmp_path):
    rows, _ = odd_rows()
    path = str(tmp_path / "embeddings.parquet")
    table(spark, [r for r in rows if r[0] is not None]).select("vec_id", "embedding").toArrow()
    pq.write_table(table(spark, [r for r in rows if r[0] is not None]).select("vec_id", "embedding").toArrow(), path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}')")
    assert sorted(map(tuple, queries.op11_balls(spark, str(tmp_path)).collect()), key=str) == sorted(db.execute(queries.op11_sql()).fetchall(), key=str)


def brute_whitening(rows, components=16):
    x = [[math.floor(64 * float(np.float32(e))) + 1_000_000 for e in v] for _, v in rows]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(e) for e in zip(*fit)]
    centred = [[n * e - s for e, s in zip(v, sums)] for v in fit]
    c = np.array(centred, dtype=object)
    exact = c.T @ c
    v = np.array([[e / n**3 for e in row] for row in exact])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    own = np.array([[n * e - s for e, s in zip(r, sums)] for r in x], dtype=object)
    projected = (own / n).astype(float) @ vectors[:, :components] / np.sqrt(values[:components])
    return n, (own**2).sum(axis=1).tolist(), projected, values[:components] / np.trace(v)


def test_whitening_equals_brute_force(spark):
    rows, dropped = odd_rows()
    got = residues.whitened(table(spark, rows + dropped).repartition(5)).toPandas()
    n, deviations, projected, explained = brute_whitening(rows)
    assert len(got) == 16 * len(rows) and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    wide = got[got.vec_id.notna() & ~got.vec_id.isin([5])]
    by = {i: k for k, (i, _) in enumerate(rows)}
    for component in range(1, 17):
        part = wide[wide.component == component]
        want = np.array([projected[by[int(i)], component - 1] for i in part.vec_id])
        sign = np.sign(want @ part.whitened.to_numpy())
        assert np.allclose(part.whitened, sign * want, rtol=0, atol=1e-8)
        assert np.allclose(part.explained, explained[component - 1], rtol=1e-9)
    assert all(int(r.deviation) == deviations[by[int(r.vec_id)]] for r in wide[wide.component == 1].itertuples())
    assert (got.vec_id == 5).sum() == 32 and got.vec_id.isna().sum() == 16


def test_scatter_is_exact_beyond_64_bits():
    rnd = np.random.default_rng(2)
    x = rnd.integers(10**12, 2 * 10**12, (9000, 3))
    import pyarrow as pa

    moduli = residues.primes(2 * len(x) * (2 * 10**12) ** 2 + 1)
    batches = [pa.RecordBatch.from_arrays([pa.array(part.tolist(), pa.list_(pa.int64()))], names=["x"]) for part in np.array_split(x, 3)]
    rows = [r for part in (batches[:2], batches[2:]) for b in residues.matrices(iter(part), moduli, 3) for r in [b]]
    of = {(k, i): v for b in residues.added(iter(rows), moduli) for k, i, v in zip(b.column("k").to_pylist(), b.column("i").to_pylist(), b.column("sums").to_pylist())}
    ones = np.c_[x, np.ones(len(x), np.int64)].astype(object)
    exact = ones.T @ ones
    assert all(residues.rebuilt([of[k, i][j] for k in range(len(moduli))], moduli) == exact[i, j] for i in range(4) for j in range(4))
    assert residues.rebuilt([(-5) % p for p in moduli], moduli) == -5


def test_whitening_of_few_vectors(spark):
    assert residues.whitened(table(spark, [])).collect() == []
    assert residues.whitened(table(spark, [(1, [0.5] * 8), (2, [0.5] * 8)])).collect() == []  # one distinct vector has no spread
    rows = [(i, v) for i, v in enumerate(vectors(5, d=8))]
    got = residues.whitened(table(spark, rows)).toPandas()
    assert set(got.component) == {1, 2, 3, 4} and got.identity_error.max() < 1e-9
    with pytest.raises(ValueError, match="no covariance"):
        residues.whitened(table(spark, [(1, [0.5] * 8), (2, [0.5] * 9)]))
