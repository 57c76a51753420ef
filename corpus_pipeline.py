"""The corpus pipeline: five stages, each an operator of ``tracelake.llm``, each written as Parquet and read again.

Rows are named by doc_id, the key of documents. A row without one cannot be named: no stage rejects it.

Defined cases: a null text is an empty text, which the quality rules reject; null languages, sources and counts pass
through; texts are taken whole, however long; repeated rows (same id) share their fate, and of equal texts with different ids
the smallest id stays; an empty table stays empty; columns beyond those of documents are dropped, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.bpe import coded
from tracelake.llm.common import materialize
from tracelake.llm.quality import quality
from tracelake.llm.similar import similar
from tracelake.llm.substrings import without_repeats
from tracelake.llm.templates import leaks

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    rejected = materialize(quality(docs).where(~F.col("kept")).select("doc_id"), "rejected")
    return docs.select(COLUMNS).join(rejected, "doc_id", "left_anti")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts that share 0.8 or more of their shingles of five words the smallest id stays."""
    copies = materialize(similar(docs).where("doc_id <> component_id").select("doc_id"), "copies")
    return docs.select(COLUMNS).join(copies, "doc_id", "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that an earlier document holds in a window of 13 go; a document that loses all of them goes as well."""
    kept = without_repeats(docs, carry=("lang", "source"), layout=True).where((F.size("starts") == 0) | (F.length("kept") > 0))
    text = F.col("kept").cast("string")
    return kept.select("doc_id", text.alias("text"), F.col("carried.lang").alias("lang"), F.col("carried.source").alias("source"), F.length(text).cast("long").alias("n_chars"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one with other numbers, names or units, go."""
    leaked = materialize(leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct(), "leaked")
    return docs.select(COLUMNS).join(leaked, "doc_id", "left_anti")


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of them and of the bytes they decode to."""
    return coded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]

#: The robust estimate, components of fingerprints and the merges of BPE are iterative: no SQL states them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over the whole of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
