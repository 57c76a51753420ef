"""Operator 13: embedding whitening by a scatter matrix in residue numbers.

Entries become whole numbers, and every distinct vector counts once (the fit list). A task multiplies its vectors modulo
several primes: residues below 2^20 in magnitude, 4,096 vectors at a time, so that every sum in a double-precision matrix product
is below 2^53 and exact. Tasks' matrices are added modulo the primes by Spark, strip by strip, and the driver puts
the d x d sums together by Chinese remaindering: the scatter, the sums and the count (a column of ones) are exact, however
many vectors there are. n * scatter - S S' is then n^2 times the covariance, centred, without rounding; it is rounded once, to
doubles, for the eigenvectors. Vectors are centred in whole numbers as well (n * x - S) before they are projected.

What moves: distinct vectors by their hash, pre-aggregated by each task; a matrix a task and prime. What is collected: d x d
residues a prime, and the covariance of the whitened components; both are bounded by the dimensions.

Defined cases: vectors that are null or hold nulls or entries that are not finite are dropped; a null id keeps its row; repeated
rows are returned again but count once; vectors of different lengths have no covariance and are an error; components whose
eigenvalue is nil (under 1e-13 of the largest: fewer distinct vectors than dimensions, or constant ones) have no whitened
value and are left out, so one distinct vector, or an empty table, gives an empty result; other columns are ignored.
Deviations are exact; where they would leave 64 bits they are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import materialize, shuffle_partitions, small_batches

#: Vectors of one matrix product, and what bounds a residue: (2^20)^2 * 4096 = 2^52.
ROWS = 4096
PRIMES_BELOW = 1 << 21
#: Eigenvalues below this share of the largest are nil.
NIL = 1e-13


def whole_vectors(table: DataFrame, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>): floor(scale * entry) + offset of the vectors whose entries are all finite."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return table.where(v.isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda e: F.floor(F.lit(float(scale)) * e) + F.lit(offset)).alias("x"))


def primes(least: int) -> list[int]:
    """The largest primes below ``PRIMES_BELOW`` whose product is over ``least``."""
    sieve = np.ones(PRIMES_BELOW, bool)
    sieve[:2] = False
    for i in range(2, int(PRIMES_BELOW**0.5) + 1):
        if sieve[i]:
            sieve[i * i :: i] = False
    found, product = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        if product > least:
            break
        found.append(p)
        product *= p
    return found


def rebuilt(residues: list[int], moduli: list[int]) -> int:
    """The whole number of least magnitude with these residues."""
    x, product = 0, 1
    for r, p in zip(residues, moduli):
        x += product * ((r - x) * pow(product, -1, p) % p)
        product *= p
    return x - product if 2 * x > product else x


def matrices(batches: Iterator[pa.RecordBatch], moduli: list[int], dimensions: int) -> Iterator[pa.RecordBatch]:
    """A task's X'X modulo each prime, X with a last column of ones: a row a prime and strip."""
    sums = np.zeros((len(moduli), dimensions + 1, dimensions + 1), np.int64)
    seen = False
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            x = with_ones(b.column("x").slice(at, ROWS), dimensions)
            seen = True
            for k, p in enumerate(moduli):
                r = x % p
                r = np.where(r > p // 2, r - p, r).astype(np.float64)
                sums[k] = (sums[k] + (r.T @ r).astype(np.int64)) % p
    if seen:
        yield strips((k, i, sums[k, i]) for k in range(len(moduli)) for i in range(dimensions + 1))


def strips(rows: Iterator[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    k, i, values = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(i, pa.int32()), pa.array([v.tolist() for v in values], pa.list_(pa.int64()))], names=["k", "i", "sums"])


def added(batches: Iterator[pa.RecordBatch], moduli: list[int]) -> Iterator[pa.RecordBatch]:
    """Strips of one prime and row added up, one at a time: a task holds the strips that are dealt to it, not what tasks sent."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for k, i, v in zip(b.column("k").to_pylist(), b.column("i").to_pylist(), b.column("sums")):
            held[k, i] = (held.get((k, i), 0) + v.values.to_numpy()) % moduli[k]
    if held:
        yield strips((k, i, v) for (k, i), v in held.items())


def with_ones(column: pa.Array, dimensions: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    return np.c_[x, np.ones(len(x), np.int64)]


@dataclass
class Whitening:
    """Exact moments of a fit list, and the components made of them."""

    n: int
    sums: list[int]
    largest: int
    scatter: list[list[int]]

    def __post_init__(self) -> None:
        d, n = len(self.sums), self.n
        exact = [[n * self.scatter[i][j] - self.sums[i] * self.sums[j] for j in range(d)] for i in range(d)]
        covariance = np.array([[c / (n * n) for c in row] for row in exact])
        values, vectors = np.linalg.eigh(covariance)
        self.trace = sum(exact[i][i] for i in range(d)) / (n * n)
        self.values, self.vectors = values[::-1], vectors[:, ::-1]
        self.rank = int((self.values > NIL * max(self.values[0], 0)).sum()) if d and self.values[0] > 0 else 0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        if self.n * (2 * self.largest + 1) < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def deviations(self, centred: np.ndarray) -> np.ndarray:
        most = max(abs(int(centred.max())), abs(int(centred.min()))) if centred.size else 0
        if len(self.sums) * most**2 < 1 << 63:
            return np.einsum("ij,ij->i", centred.astype(np.int64), centred.astype(np.int64))
        exact = (centred.astype(object) ** 2).sum(axis=1)
        if max(exact) >= 1 << 63:
            raise OverflowError("a deviation leaves 64 bits")
        return exact.astype(np.int64)

    def whitened(self, centred: np.ndarray, components: int) -> np.ndarray:
        return (centred.astype(np.float64) / self.n) @ (self.vectors[:, :components] / np.sqrt(self.values[:components]))


def fitted(fit: DataFrame) -> Whitening | None:
    """The exact moments of distinct vectors (x array<long>); None if there are none."""
    span = fit.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("d"), F.max(F.greatest(F.array_max("x"), -F.array_min("x"))).alias("largest")).first()
    n, d, largest = span["n"], span["d"], span["largest"]
    if not n or not d:
        return None
    if span["least"] != d:
        raise ValueError(f"vectors of {span['least']} to {d} entries have no covariance")
    moduli = primes(2 * n * max(largest, 1) ** 2 + 1)
    parts = fit.select("x").mapInArrow(lambda b: matrices(b, moduli, d), "k int, i int, sums array<long>")
    whole = parts.repartition(min(shuffle_partitions(fit.sparkSession), len(moduli) * (d + 1)), "k", "i").mapInArrow(lambda b: added(b, moduli), "k int, i int, sums array<long>")
    of = {(r["k"], r["i"]): r["sums"] for r in whole.collect()}
    exact = [[rebuilt([of[k, i][j] for k in range(len(moduli))], moduli) for j in range(d + 1)] for i in range(d + 1)]
    return Whitening(exact[d][d], exact[d][:d], largest, [row[:d] for row in exact[:d]])


def identity_error(fit: DataFrame, made: Whitening, components: int) -> float:
    """The largest absolute entry of the covariance of whitened distinct vectors minus the identity."""
    d = len(made.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((components + 1, components + 1))
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                w = made.whitened(made.centred(with_ones(b.column("x").slice(at, ROWS), d)[:, :d]), components)
                w = np.c_[w, np.ones(len(w))]
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])

    cells = fit.select("x").mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((components + 1) ** 2)
    for r in cells:
        total[r["at"]] = r["v"]
    total = total.reshape(components + 1, -1) / made.n
    mean = total[components, :components]
    return float(np.abs(total[:components, :components] - np.outer(mean, mean) - np.eye(components)).max())


def whitened(table: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row a vector and component."""
    small_batches(table.sparkSession)
    vectors = whole_vectors(table, scale, offset, id_col, vec_col)
    fit = materialize(vectors.select("x").distinct(), "fit")
    made = fitted(fit)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if made is None or not made.rank:
        return table.sparkSession.createDataFrame([], schema)
    components, d = min(components, made.rank), len(made.sums)
    error = identity_error(fit, made, components)
    explained = made.values[:components] / made.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                centred = made.centred(with_ones(b.column("x"), d)[:, :d])
                m = b.num_rows
                rows = np.repeat(np.arange(m), components)
                columns = [b.column("vec_id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, components + 1, dtype=np.int32), m)), pa.array(np.full(len(rows), made.n, np.int64)), pa.array(made.deviations(centred)[rows]), pa.array(made.whitened(centred, components).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(len(rows), error))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, schema)
