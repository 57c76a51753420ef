"""Seeds (L10, L16): fragments of paths, and the files whose path holds one of them.

Thousands of seeds are neither one predicate each nor a nested loop: every seed is looked up by the three-character gram of it that the
fewest paths hold, an equi-join on that gram finds the candidates, and a semi-join condition verifies them. A seed with a gram
that no path holds is gone before the join. Grams of paths are counted once, combined by each task before they are dealt.

A path matches a seed of three characters or more that it contains, in any case, or whose last component it ends with; back and forward
slashes of a path are alike. A seed that ends in a separator has no last component and must be contained.
Null paths match nothing; repeated files are returned as often as they stand; no seeds match no file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM, LEAST, SALTS = 3, 3, 16
#: Stands behind a path and behind a last component, so that "ends with" is "contains"; long enough to give any component a gram.
END = "\u0003\u0003"


def grams(text: Column) -> Column:
    """The distinct grams of a text; none of one that is shorter."""
    every = F.transform(F.sequence(F.lit(1), F.length(text) - (GRAM - 1)), lambda i: F.substring(text, i, GRAM))
    return F.when(F.length(text) >= GRAM, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def needles(seed: Column) -> Column:
    """What a path, in lower case and with its end marked, must contain one of."""
    low = F.lower(seed)
    last = F.substring_index(low, "\\", -1)
    ends = F.when(low.contains("\\") & (last != ""), F.array(low, F.concat(last, F.lit(END))))
    return F.when(F.length(low) >= LEAST, F.coalesce(ends, F.array(low)))


def matching(files: DataFrame, column: str, seeds: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Files whose path matches a seed (column ``seed``), of the same host or whatever ``by`` names."""
    keys = [*by, "_gram"]
    path = F.concat(F.lower(F.replace(F.col(column), F.lit("/"), F.lit("\\"))), F.lit(END))
    paths = files.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("_raw"), path.alias("_path"))
    wanted = seeds.select(*by, F.explode(needles(F.col("seed"))).alias("_needle")).distinct()
    # thousands of seeds share a gram: each gram's count is dealt to ``SALTS`` places, and a seed asks one of them
    held = wanted.select(*by, "_needle", F.pmod(F.xxhash64("_needle"), F.lit(SALTS)).cast("int").alias("_salt"), F.explode(grams(F.col("_needle"))).alias("_gram"))
    seen = paths.select(*by, F.explode(grams(F.col("_path"))).alias("_gram")).groupBy(*keys).agg(F.count("*").alias("_n"))
    dealt = seen.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    counted = held.join(dealt, [*keys, "_salt"], "left").groupBy(*by, "_needle").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_rarest"))
    asked = counted.where("_rarest.n > 0").select(*(F.col(k).alias(f"_seed_{k}") for k in by), "_needle", F.col("_rarest.gram").alias("_by"))
    told = paths.select("*", F.explode(grams(F.col("_path"))).alias("_gram"))
    same = F.col("_gram") == F.col("_by")
    for k in by:
        same &= F.col(k) == F.col(f"_seed_{k}")
    hits = told.join(asked, same & F.col("_path").contains(F.col("_needle")), "left_semi").select(*by, F.col("_raw").alias(column)).distinct()
    return files.join(hits, [*by, column], "left_semi")


def matching_seeds(files: DataFrame, column: str, seeds: list[str]) -> DataFrame:
    """L10 with a handful of seeds by hand."""
    return matching(files, column, files.sparkSession.createDataFrame([(s,) for s in seeds], "seed string"))


#: Process, file and deletion events, whose commands and images name paths.
NAMING_EVENTS = (1, 11, 23)


def event_seeds(events: DataFrame) -> DataFrame:
    """(hostname, seed): commands and images that hold a path, up to the first quotation mark."""
    named = events.where(F.col("event_id").isin(*NAMING_EVENTS)).select("hostname", F.explode(F.array("command_line", "image")).alias("value"))
    return named.where(F.col("value").contains("\\")).select("hostname", F.substring_index("value", '"', 1).alias("seed")).where("seed <> ''").distinct()


def path_seeds(files: DataFrame) -> DataFrame:
    """(hostname, seed): the paths that a host is known to have."""
    return files.where("path <> ''").select("hostname", F.replace("path", F.lit("/"), F.lit("\\")).alias("seed")).distinct()


def case_seeds(roots: list[str] = (), keywords: list[str] = (), aliases: dict[str, list[str]] | None = None, sensitive: list[str] = (), least: int = 4) -> list[str]:
    """What a case itself asks for: roots, keywords that are long enough, aliases, and what sensitive patterns spell."""
    found = [r.replace("/", "\\") for r in roots] + [k for k in keywords if len(k) >= least]
    for name, others in (aliases or {}).items():
        found += [name, *others]
    found += [pattern.replace("*", "").strip("\\/") for pattern in sensitive]
    return sorted({f for f in found if f})


def discovery_seeds(hosts: DataFrame, events: DataFrame, files: DataFrame, case: list[str]) -> DataFrame:
    """(hostname, seed) of all hosts: a case's seeds for each, and those that a host's own files and events give."""
    asked = hosts.select("hostname", F.explode(F.lit(case).cast("array<string>") if case else F.array().cast("array<string>")).alias("seed"))
    return asked.unionByName(path_seeds(files)).unionByName(event_seeds(events)).distinct()
