"""Operator 11: centroid clustering by ball k-means, in whole numbers.

A cluster is a ball: its centroid and the distance of its farthest member. Another centroid can only win a member of a ball
if it is closer to the ball's centroid than twice the radius: those are the ball's neighbours. Members closer to their
centroid than half the way to the nearest neighbour are the stable core and stay without a comparison. The others lie in
annuli between half the ways to one neighbour and to the next, and are compared, exactly, with the neighbours up to theirs.

The first round compares every vector with every centroid. Each later round reads blocks of vectors with their clusters,
measures every vector's own distance anew, and moves members of annuli. A task adds up its counts, sums, distances and radii,
a row a cluster; Spark adds those, and the driver holds centroids, radii and neighbours, bounded by clusters x dimensions.
No row moves between tasks: there is no shuffle but of those sums, so neither hot clusters nor repeated vectors matter.
Each round's blocks are a table in the shared folder, which a lost executor's tasks read again; the round before it is deleted.

All arithmetic is on whole numbers: distances are squared, and "half the way" compares four times a squared distance.
A ball's radius around a moved centroid is bounded by the old radius and the shift, both rounded up, so no neighbour is missed.

Defined cases: vectors that are null, of another length, or hold nulls or entries that are not finite are dropped; entries
whose squared distances would leave 64 bits are an error; a null id keeps its row but starts no centroid; repeated rows are
repeated vectors; equal hashes of ids start in the order of their vectors; fewer vectors than clusters give as many clusters as
vectors; an empty centroid stays where it is; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import discard, materialize, small_batches

#: Vectors in a block, one row of a round's table: 256 KB at 64 dimensions.
BLOCK = 1024
BLOCKS = "ids array<long>, x binary, cluster binary, distance binary, stats array<struct<cluster: int, n: long, inertia: long, radius: long, sums: array<long>>>"
STATS = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("inertia", pa.int64()), ("radius", pa.int64()), ("sums", pa.list_(pa.int64()))]))
SCHEMA = pa.schema([("ids", pa.list_(pa.int64())), ("x", pa.binary()), ("cluster", pa.binary()), ("distance", pa.binary()), ("stats", STATS)])


def whole_vectors(table: DataFrame, dimensions: int = 64, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>): floor(scale * entry) of the vectors that have ``dimensions`` finite entries."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return table.where((F.size(v) == dimensions) & finite).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda e: F.floor(F.lit(float(scale)) * e)).alias("x"))


@dataclass
class Balls:
    """Centroids, and of each the other centroids that its members may be closer to, nearest first, with squared distances."""

    centroids: np.ndarray
    neighbours: list[tuple[np.ndarray, np.ndarray]]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) by comparing with every centroid; of equal ones the smaller number."""
        cluster, best = np.zeros(len(x), np.int32), squares(x, self.centroids[0])
        for j in range(1, len(self.centroids)):
            d = squares(x, self.centroids[j])
            closer = d < best
            cluster[closer], best[closer] = j, d[closer]
        return cluster, best

    def moved(self, x: np.ndarray, was: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for vectors that were in the clusters ``was``: only annuli are compared, with the neighbours they reach."""
        cluster, best = was.copy(), np.empty(len(x), np.int64)
        for i in np.unique(was):
            rows = np.flatnonzero(was == i)
            own = squares(x[rows], self.centroids[i])
            best[rows] = own
            others, apart = self.neighbours[i]
            reach = np.searchsorted(apart, 4 * own, side="right")
            for rank in range(int(reach.max(initial=0))):
                ring, j = rows[reach > rank], int(others[rank])
                d = squares(x[ring], self.centroids[j])
                wins = (d < best[ring]) | ((d == best[ring]) & (j < cluster[ring]))
                cluster[ring[wins]], best[ring[wins]] = j, d[wins]
        return cluster, best


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def neighbours(centroids: np.ndarray, radii: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each ball the centroids that are no farther than twice its radius; radii are upper bounds, not squared."""
    found = []
    for i, c in enumerate(centroids):
        apart = squares(centroids, c)
        near = np.flatnonzero((apart <= min(4 * radii[i] ** 2, np.iinfo(np.int64).max)) & (np.arange(len(centroids)) != i))
        order = near[np.argsort(apart[near], kind="stable")]
        found.append((order, apart[order]))
    return found


def up_root(n: int) -> int:
    """The square root, rounded up."""
    return 0 if n <= 0 else math.isqrt(n - 1) + 1


class Sums:
    """What a task adds up of its clusters."""

    def __init__(self, k: int, dimensions: int) -> None:
        self.n, self.inertia, self.radius, self.sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)

    def add(self, x: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> None:
        self.n += np.bincount(cluster, minlength=len(self.n))
        np.add.at(self.inertia, cluster, distance)
        np.maximum.at(self.radius, cluster, distance)
        for i in np.unique(cluster):
            self.sums[i] += x[cluster == i].sum(axis=0)

    def rows(self) -> list[dict]:
        return [{"cluster": int(i), "n": int(self.n[i]), "inertia": int(self.inertia[i]), "radius": int(self.radius[i]), "sums": self.sums[i].tolist()} for i in np.flatnonzero(self.n)]


def block(ids: pa.Array, x: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    columns = [pa.ListArray.from_arrays([0, len(ids)], ids), *(pa.array([a.tobytes()], pa.binary()) for a in (x.astype("<i4"), cluster.astype("<i4"), distance.astype("<i8"))), pa.array([None], STATS)]
    return pa.RecordBatch.from_arrays(columns, schema=SCHEMA)


def last(sums: Sums) -> pa.RecordBatch:
    """A task's own row: no vectors, but what it added up."""
    return pa.RecordBatch.from_pylist([{"ids": [], "x": b"", "cluster": b"", "distance": b"", "stats": sums.rows()}], schema=SCHEMA)


def vectors_of(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def first_round(batches: Iterator[pa.RecordBatch], balls: Balls) -> Iterator[pa.RecordBatch]:
    k, dimensions = balls.centroids.shape
    sums, most = Sums(k, dimensions), math.isqrt((1 << 60) // dimensions)
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            b = whole.slice(at, BLOCK)
            x = vectors_of(b.column("x"), dimensions)
            if len(x) and max(abs(int(x.max())), abs(int(x.min()))) > min(most, (1 << 31) - 1):
                raise OverflowError(f"an entry beyond {most}: squared distances would leave 64 bits")
            cluster, distance = balls.nearest(x)
            sums.add(x, cluster, distance)
            yield block(b.column("vec_id"), x, cluster, distance)
    yield last(sums)


def later_round(batches: Iterator[pa.RecordBatch], balls: Balls) -> Iterator[pa.RecordBatch]:
    k, dimensions = balls.centroids.shape
    sums = Sums(k, dimensions)
    for b in batches:
        for i in range(b.num_rows):
            ids = b.column("ids")[i].values
            if not len(ids):
                continue
            x = np.frombuffer(b.column("x")[i].as_buffer(), "<i4").reshape(-1, dimensions).astype(np.int64)
            cluster, distance = balls.moved(x, np.frombuffer(b.column("cluster")[i].as_buffer(), "<i4"))
            sums.add(x, cluster, distance)
            yield block(ids, x, cluster, distance)
    yield last(sums)


def totals(state: DataFrame) -> dict[int, dict]:
    """Of each cluster that has vectors: n, inertia, radius (squared) and sums; a row a task and cluster is added up by Spark."""
    rows = state.where("stats is not null").select(F.explode("stats").alias("s")).select("s.*")
    found: dict[int, dict] = {}
    parts = rows.select("cluster", "n", "inertia", "radius", F.posexplode("sums").alias("d", "v"))
    for r in parts.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.max("radius").alias("radius"), F.sum("v").alias("v")).collect():
        found.setdefault(r["cluster"], {"n": r["n"], "inertia": r["inertia"], "radius": r["radius"], "sums": {}})["sums"][r["d"]] = r["v"]
    return found


@dataclass
class Clustering:
    """What ``clustering`` found: blocks of vectors with clusters, the centroids, each cluster's totals, and the rounds it took."""

    state: DataFrame
    centroids: np.ndarray
    totals: dict[int, dict]
    rounds: int

    def members(self) -> DataFrame:
        """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row a vector."""
        inertia = {i: t["inertia"] for i, t in self.totals.items()}
        every, of = sum(inertia.values()), np.array([inertia.get(i, 0) for i in range(len(self.centroids))], np.int64)
        names = pa.array([hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in self.centroids], pa.string())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    cluster = np.frombuffer(b.column("cluster")[i].as_buffer(), "<i4")
                    distance = np.frombuffer(b.column("distance")[i].as_buffer(), "<i8")
                    columns = [b.column("ids")[i].values, pa.array(cluster), pa.array(distance), pa.array(of[cluster]), pa.array(np.full(len(cluster), every, np.int64)), names.take(pa.array(cluster))]
                    yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

        return self.state.where("stats is null").select("ids", "cluster", "distance").mapInArrow(run, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def starts(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in their order."""
    named = vectors.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)).where("vec_id is not null")
    return np.array([r["x"] for r in named.orderBy("h", "x").limit(clusters).collect()], np.int64)


def clustering(vectors: DataFrame, clusters: int = 8, rounds: int = 10, seed: int = 3) -> Clustering | None:
    """Clusters of (vec_id long, x array<long>): ``rounds`` rounds, then every vector assigned once more. None if no vector can start.

    Once no centroid moves, later rounds would change nothing, and are left out.
    """
    small_batches(vectors.sparkSession)
    centroids = starts(vectors, clusters, seed)
    if not len(centroids):
        return None
    balls = Balls(centroids, [])
    state = materialize(vectors.select("vec_id", "x").mapInArrow(lambda batches, b=balls: first_round(batches, b), BLOCKS), "balls")
    found = totals(state)
    for done in range(1, rounds + 1):
        new = centroids.copy()
        for i, t in found.items():
            new[i] = [t["sums"][d] // t["n"] for d in range(centroids.shape[1])]
        if (new == centroids).all():
            return Clustering(state, centroids, found, done)
        radii = [up_root(found[i]["radius"]) + up_root(int(squares(new[i : i + 1], centroids[i])[0])) if i in found else 0 for i in range(len(new))]
        centroids = new
        balls = Balls(centroids, neighbours(centroids, radii))
        before, state = state, materialize(state.where("stats is null").mapInArrow(lambda batches, b=balls: later_round(batches, b), BLOCKS), "balls")
        discard(before)
        found = totals(state)
    return Clustering(state, centroids, found, rounds)


def clustered(table: DataFrame, clusters: int = 8, rounds: int = 10, seed: int = 3, dimensions: int = 64, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept."""
    found = clustering(whole_vectors(table, dimensions, scale, id_col, vec_col), clusters, rounds, seed)
    if found is None:
        return table.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.members()
