"""Scoring of verdicts against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verdicts by severity, and thresholds of a passing report.
SEVERITY = {"BENIGN": 0, "ABSTAIN": 0, "SUSPICION": 1, "MALICE": 2}
THRESHOLDS = {"verdict_accuracy": (">=", 0.80), "false_positive_rate": ("<=", 0.20), "fnr_mal": ("<=", 0.10), "ttp_coverage": (">=", 0.60)}
TOKEN_FIELDS = ("input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "output_tokens")


def base_technique(ttp: Column) -> Column:
    """K01"""
    return F.split_part(F.upper(F.trim(ttp)), F.lit("."), F.lit(1))


def coverage(detected: Column, expected: Column) -> list[Column]:
    """Expected techniques, those found as such, and those found by family; coverages are null without any."""
    clean = lambda a: F.array_distinct(F.transform(a, lambda t: F.upper(F.trim(t))))
    found, wanted = clean(detected), clean(expected)
    families = F.transform(found, base_technique)
    n, exact = F.size(wanted), F.size(F.array_intersect(found, wanted))
    family = F.size(F.filter(wanted, lambda t: F.array_contains(families, base_technique(t))))
    share = lambda k: F.when(n > 0, k / n)
    return [n.alias("n_expected"), exact.alias("n_exact"), family.alias("n_family"), share(exact).alias("exact_coverage"), share(family).alias("family_coverage")]


def recall(values: DataFrame, documents: DataFrame) -> DataFrame:
    """values(case_id, value), documents(case_id, blob): how many of a case's values its document holds, in any case."""
    found = values.join(documents, "case_id").withColumn("hit", (F.trim("value") != "") & F.lower("blob").contains(F.lower(F.trim("value"))))
    return found.groupBy("case_id").agg(F.count("*").alias("n_canonical"), F.sum(F.col("hit").cast("int")).alias("n_recovered"))


def confusion(verdicts: DataFrame) -> DataFrame:
    """verdicts(verdict, expected) -> accuracy, false positives among cases that are not malice, and missed malice."""
    got, want = F.upper(F.trim("verdict")), F.upper(F.trim("expected"))
    rank = lambda v: F.element_at(F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv)), v)
    rows = verdicts.select(got.alias("got"), want.alias("want")).where(F.col("got").isNotNull() & F.col("want").isNotNull())
    eligible, malice = F.col("want").isin("BENIGN", "SUSPICION"), F.col("want") == "MALICE"
    over = eligible & F.col("got").isin(*SEVERITY) & (rank(F.when(F.col("got").isin(*SEVERITY), F.col("got")).otherwise("BENIGN")) > rank(F.when(eligible, F.col("want")).otherwise("BENIGN")))
    mean = lambda hit, among: F.avg(F.when(among, hit.cast("int")))
    return rows.agg(
        F.count("*").alias("cases"),
        F.avg((F.col("got") == F.col("want")).cast("int")).alias("verdict_accuracy"),
        mean(over, eligible).alias("false_positive_rate"),
        mean(F.col("got") == "BENIGN", malice).alias("fnr_mal"),
        F.sum((over).cast("int")).alias("over_calls"),
    )


def checks(metrics: dict[str, float | None]) -> dict[str, bool | None]:
    """Whether each metric meets its threshold; null metrics are not judged."""
    return {k: None if metrics.get(k) is None else (metrics[k] >= t if op == ">=" else metrics[k] <= t) for k, (op, t) in THRESHOLDS.items()}


def token_usage(turns: DataFrame, order: Column, fields: tuple[str, ...] = TOKEN_FIELDS) -> DataFrame:
    """Only the listed fields, with running totals in order within a session."""
    from pyspark.sql import Window

    by = Window.partitionBy("session").orderBy(order)
    kept = [F.coalesce(F.col(f), F.lit(0)).cast("long").alias(f) for f in fields if f in turns.columns]
    return turns.select("session", order.alias("nth"), F.row_number().over(by).cast("long").alias("turn"), *kept, *(F.sum(F.coalesce(F.col(f), F.lit(0)).cast("long")).over(by).alias(f"total_{f}") for f in fields if f in turns.columns))
