"""Registered queries of the training-data operators, one opN_<name> each, and their oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANKS = "byte_bpe_multi_50k.tiktoken"
WORDS = "word_bpe_49k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document; a token over a line end goes to the line that holds most of it."""
    from tracelake.llm.attribution import attributed

    out = attributed(_documents(spark, sf_dir), public_tokenizers.path(RANKS))
    return out.withColumn("outside", F.col("outside").cast("long")).withColumn("section_tokens", F.col("section_tokens").cast("array<long>"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.quality import quality

    return quality(_documents(spark, sf_dir)).drop("grp", "d2")


def op4_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.templates import leaks

    return leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.simhash import hex16, near_duplicates

    return near_duplicates(_documents(spark, sf_dir)).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.toxicity import scored, train

    docs = _documents(spark, sf_dir)
    return scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.pages import main_text

    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.substrings import removed_words
    from tracelake.llm.suffixes import without_repeated_bytes

    return without_repeated_bytes(_documents(spark, sf_dir)).select("doc_id", "n_bytes", removed_words().alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of documents, as files of the tree source/language/id."""
    from tracelake.llm.licences import scan, templates

    files = _documents(spark, sf_dir).withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))
    return scan(files, templates(spark))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.bpe import coded

    return coded(_documents(spark, sf_dir), public_tokenizers.path(RANKS)).drop("ids")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.substrings import removed_words, without_repeats

    return without_repeats(_documents(spark, sf_dir)).select("doc_id", "n_words", removed_words().alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.balls import clustered

    return clustered(_embeddings(spark, sf_dir))


def op12_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.transducer import coded

    return coded(_documents(spark, sf_dir), public_tokenizers.path(WORDS))


def op13_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.residues import whitened

    return whitened(_embeddings(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_tokens": op1_tokens, "op2_quality": op2_quality, "op4_templates": op4_templates, "op3_simhash": op3_simhash, "op5_toxicity": op5_toxicity, "op6_pages": op6_pages, "op7_suffixes": op7_suffixes, "op8_licences": op8_licences, "op9_bpe": op9_bpe, "op10_substrings": op10_substrings, "op11_balls": op11_balls, "op12_transducer": op12_transducer, "op13_residues": op13_residues}


#: The words a text keeps, by the smallest document of every window of 13 words.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
o AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT w.doc_id, w.i FROM w JOIN o USING (s) WHERE o.first < w.doc_id), range(13) AS r(k)),
kept AS (SELECT t.doc_id, string_agg(t.x, ' ' ORDER BY t.i) AS text FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM d) t ANTI JOIN gone g ON g.doc_id = t.doc_id AND g.i = t.i GROUP BY t.doc_id)
SELECT d.doc_id, len(ws) :: bigint AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""


#: The bytes a text keeps, by the first start of every string of 100 bytes (as hexadecimal digits, grouped by 64 bits of hash).
OP7_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, hash(substr(x, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS i FROM d)),
o AS (SELECT s, min({'doc': doc_id, 'i': i}) AS first FROM w GROUP BY s),
gone AS (SELECT doc_id, i FROM w JOIN o USING (s) WHERE {'doc': doc_id, 'i': i} > o.first),
marks AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM gone),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM marks) GROUP BY doc_id, n),
cuts AS (SELECT doc_id, a, z, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS n FROM runs),
parts AS (SELECT c.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(CASE WHEN n = 1 THEN substr(x, 1, 2 * a) ELSE '' END || substr(x, 2 * z + 1, 2 * (coalesce(next, len(x) // 2) - z)), '' ORDER BY a) AS kept FROM cuts c JOIN d USING (doc_id) GROUP BY c.doc_id)
SELECT d.doc_id, (len(x) // 2) :: bigint AS n_bytes, coalesce(n_removed, 0) :: bigint AS n_removed, coalesce(n_spans, 0) :: bigint AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN parts USING (doc_id)"""


def op11_sql(rounds: int = 10, clusters: int = 8) -> str:
    """Every round as tables of its own: all distances, the nearest centroid, and the means of what it took, rounded down."""
    parts = [
        "v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda e: floor(1024 * e :: double) :: bigint) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS c, x AS m FROM v WHERE vec_id IS NOT NULL QUALIFY c < {clusters})",
    ]
    for k in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) :: bigint"
        parts.append(f"a{k} AS MATERIALIZED (SELECT r, vec_id, x, c, {distance} AS d FROM v, c{k} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if k < rounds:
            parts.append(f"s{k} AS (SELECT c, i, sum(e) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS e, unnest(range(64)) AS i FROM a{k}) GROUP BY c, i)")
            parts.append(f"m{k} AS (SELECT c, list(((s - ((s % n) + n) % n) // n) :: bigint ORDER BY i) AS m FROM s{k} GROUP BY c)")
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT c, coalesce(m{k}.m, c{k}.m) AS m FROM c{k} LEFT JOIN m{k} USING (c))")
    last = f"a{rounds}"
    return f"WITH {', '.join(parts)} SELECT vec_id, c :: int AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c)) :: bigint AS cluster_inertia, (sum(d) OVER ()) :: bigint AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM {last} JOIN c{rounds} USING (c)"


def oracle_sql() -> dict[str, str]:
    return {"op7_suffixes": OP7_SQL, "op10_substrings": OP10_SQL, "op11_balls": op11_sql()}
