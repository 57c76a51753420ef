"""Findings of investigations (IW04-IW06, X13) as a table that many writers merge into.

Findings are dealt into buckets by their id; each bucket is a table of the ledger. A merge reads a bucket as it is, folds the new rows into it
(the last writer of an id counts), writes the bucket anew beside the old one and publishes it as the next commit. If another writer has
published meanwhile, the merge is done again on what that one wrote: nothing is lost, and readers see whole buckets only.
Rows of one merge that share an id count in the order of ``nth``, if they have such a column. A null id is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.graph import overwrite
from tracelake.sources.ledger import Ledger

COLUMNS = ["id", "case_id", "hypothesis", "verdict", "confidence", "step_id", "summary"]
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)


class Findings:
    """A table of findings under one root."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.buckets, self.ledger = spark, buckets, Ledger(spark, root)

    def merge(self, rows: DataFrame) -> int:
        """Merge rows (any of the columns; what is left out is null); the number of buckets that were written."""
        nth = F.col("nth").cast("long") if "nth" in rows.columns else F.lit(0).cast("long")
        have = [F.col(c).cast("string").alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS]
        named = F.when(F.col("id").isNull(), F.raise_error(F.lit("a finding without an id")).cast("long")).otherwise(F.pmod(F.xxhash64("id"), F.lit(self.buckets)))
        new = rows.select(nth.alias("nth"), *have).select("*", named.alias("bucket"))
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # one of ``buckets`` each
        for bucket in touched:
            mine = new.where(F.col("bucket") == bucket).drop("bucket")
            self.ledger.update(f"findings-{bucket:04d}", lambda held, mine=mine: self._folded(held, mine))
        return len(touched)

    @staticmethod
    def _folded(held: DataFrame | None, new: DataFrame) -> DataFrame:
        later = new.select(F.struct(F.lit(1).alias("turn"), "nth").alias("seq"), *COLUMNS)
        if held is not None:
            later = later.unionByName(held.select(F.struct(F.lit(0).alias("turn"), F.lit(0).cast("long").alias("nth")).alias("seq"), *COLUMNS))
        return overwrite(later, ["id"], COLUMNS[1:])

    def read(self) -> DataFrame:
        """All findings, of each bucket as it was last published."""
        commits = [c for t in self.ledger.tables() if t.startswith("findings-") and (c := self.ledger.current(t))]
        if not commits:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*(c.folder for c in commits))

    def summary(self) -> DataFrame:
        """IW06: of each case and hypothesis the strongest verdict that any step gave it."""
        rank = F.when(F.col("verdict") == "supported", 2).when(F.col("verdict") == "inconclusive", 1).otherwise(0)
        return self.read().groupBy("case_id", "hypothesis").agg(F.max(F.struct(rank.alias("rank"), "verdict")).getField("verdict").alias("verdict"), F.count("*").alias("steps"))
