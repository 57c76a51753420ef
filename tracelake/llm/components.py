"""Connected components of a distributed edge list, by alternating large-star and small-star rounds.

No edge list ever reaches the driver: each round is two shuffles, its result is written to the shared folder, and
only one number (edges that still move) comes back. A node's neighbours are never gathered: minima are aggregated
map-side first, and joined back on the node, which adaptive execution can split if a hub is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import discard, materialize, release_shuffles


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.select("a", F.least("a", "b").alias("m")).unionByName(edges.select(F.col("b").alias("a"), F.least("a", "b").alias("m"))).groupBy("a").agg(F.min("m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a long, b long) -> (node, root): root is the smallest node reachable; isolated nodes are not listed.

    Null ends and loops are dropped; an empty edge list gives an empty result.
    """
    now = materialize(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        old, now = now, materialize(_small_star(_large_star(now)), "stars")
        discard(old)
        state = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        release_shuffles(edges.sparkSession)
        if state == before or not state[0]:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
