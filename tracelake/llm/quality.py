"""Operator 2: quality rules by robust multivariate outliers, in DataFrame operations only.

Every text gives exact statistics (words, characters, symbols, repeated lines, repeated three-word windows), and a
vector of five transformed ones. For each language and source the minimum covariance determinant estimate of the
vectors' centre and scatter is found as deterministic MCD does: from four robust starts (medians and quartiles, all vectors,
spatial signs, hyperbolic tangents), concentration steps until the determinants settle, and the start with the lowest
determinant wins. Rows far from the centre by Mahalanobis distance are rejected. How the steps stay cheap for any size and
skew of the groups:

- a step's share ``HALF`` of nearest vectors is cut on a fixed logarithmic grid of distances, the cell at the cut counting in
  part. One aggregation by (group, start, grid cell) sums counts, vectors and products; a running total over the cells of a
  group (a few hundred, whatever the rows) gives the cut and the new estimate. A hot source is combined before it is shuffled;
- medians and quartiles come from the same kind of grid. No row is sampled or sorted, no group meets in a task;
- estimates (some dozens of numbers a group) are broadcast if there are at most ``BROADCAST_GROUPS`` groups, so that rows are
  never dealt by group;
- repeated rows of a group count once in its estimate, so that a thousand copies of a text do not become the norm;
- a group under ``least`` distinct vectors is judged by all vectors of its language, or by all; below that there is no
  estimate and the base rules alone decide;
- a floor on the scatter keeps constant statistics (no symbols in any text) from rejecting the first other value.

Defined cases: null text is an empty text (which fails the base rules); null language or source is a group of its
own; a null id stays null; repeated rows get the same verdict; of equal distances neither is ahead of the other (cells count
as a whole or by a share); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import WORD, discard, materialize

#: Base rules of the contract.
LEAST_WORDS, MOST_REPEATED = 50, 50
DIMS = 5
#: Share of a group that a concentration step keeps.
HALF = 0.75
#: Concentration steps at most, and the change of a determinant's logarithm at which they end.
STEPS, SETTLED = 12, 1e-3
#: Groups whose estimates are still broadcast: some 200 bytes for each start.
BROADCAST_GROUPS = 20_000
#: Grid cells for each unit of a transformed statistic, and for each doubling of a squared distance.
FINE, OCTAVE = 64, 16
#: Distinct vectors that an estimate needs.
LEAST = 60
#: Upper tail of the chi-squared law at which a vector is rejected.
TAIL = 1e-9
#: Least standard deviations: log words, word length, symbols, repeated lines, repeated words.
FLOORS = (0.35, 0.08, 0.05, 0.08, 0.12)


def _chi2_cdf(x: float, k: int) -> float:
    term = total = math.exp(-x / 2 + k / 2 * math.log(x / 2) - math.lgamma(k / 2 + 1)) if x > 0 else 0.0
    n = k / 2 + 1
    while total and term > total * 1e-16:
        term *= x / 2 / n
        total += term
        n += 1
    return total


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, k) < p else (low, mid)
    return low


#: A half's scatter is too small by this factor if the vectors are normal.
CONSISTENCY = HALF / _chi2_cdf(chi2_quantile(HALF, DIMS), DIMS + 2)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of each row's whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), text.alias("body"))
    rows = rows.withColumn("words", F.filter(F.split("body", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = rows.withColumn("lines", F.filter(F.split("body", "\n"), lambda x: x.rlike(WORD)))
    # hash and place of each three-word window, sorted: equal windows become neighbours
    windows = F.when(
        F.size("words") >= 3,
        F.sort_array(F.transform(F.slice("words", 1, F.size("words") - 2), lambda w, i: F.struct(F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")))),
    )
    rows = rows.withColumn("windows", windows)
    same = lambda a, b: F.get("windows", a).getField("h") == F.get("windows", b).getField("h")
    found = F.filter(F.col("windows"), lambda w, k: (F.coalesce(same(k, k - 1), F.lit(False)) & (k > 0)) | F.coalesce(same(k, k + 1), F.lit(False)))
    rows = rows.withColumn("again", F.sort_array(F.transform(found, lambda w: w.getField("i"))))
    # each repeated window covers three words, or those up to the next one
    covered = F.aggregate(F.transform(F.col("again"), lambda i, k: F.least(F.lit(3), F.coalesce(F.get("again", k + 1) - i, F.lit(3)))), F.lit(0), lambda a, n: a + n)
    return rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.regexp_replace("body", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics x0..x4: logarithms and square roots that make clean texts nearly normal."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    values = [F.log(n.cast("double")), F.log1p(F.col("word_chars") / n), F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n)]
    return [v.cast("double").alias(f"x{i}") for i, v in enumerate(values)]


PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]
ESTIMATE = [*(f"m{i}" for i in range(DIMS)), *(f"l{i}{j}" for i, j in PAIRS)]


def _sums(x: list[Column], weight: Column | None = None) -> list[Column]:
    w = F.lit(1.0) if weight is None else weight
    return [F.sum(w).alias("n"), *(F.sum(w * x[i]).alias(f"a{i}") for i in range(DIMS)), *(F.sum(w * x[i] * x[j]).alias(f"p{i}{j}") for i, j in PAIRS)]


def _factored(rows: DataFrame, keys: list[str], centre: list[Column], scatter: dict[tuple[int, int], Column]) -> DataFrame:
    """Estimates: the centre and the scatter's Cholesky factor, with the floors, and the determinant's logarithm."""
    rows = rows.select(*keys, *(c.alias(f"m{i}") for i, c in enumerate(centre)), *(c.alias(f"c{i}{j}") for (i, j), c in scatter.items()))
    for i, j in PAIRS:
        floor = FLOORS[i] ** 2 if i == j else 0.0
        rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{i}{j}") + floor)
        rows = rows.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(floor))) if i == j else rest / F.col(f"l{j}{j}"))
    return rows.select(*keys, *ESTIMATE, (2 * reduce(lambda a, b: a + b, (F.log(f"l{i}{i}") for i in range(DIMS)))).alias("logdet"))


def _covariance(factor: float) -> tuple[list[Column], dict[tuple[int, int], Column]]:
    """Centre and scatter of sums n, a, p."""
    mean = [F.col(f"a{i}") / F.col("n") for i in range(DIMS)]
    return mean, {(i, j): factor * (F.col(f"p{i}{j}") / F.col("n") - mean[i] * mean[j]) for i, j in PAIRS}


def _medians(points: DataFrame) -> DataFrame:
    """(grp, q0.., s0..): medians and normalised quartile ranges, from counts on a grid."""
    cells = points.select("grp", F.posexplode(F.array(*(F.round(F.col(f"x{i}") * FINE).cast("long") for i in range(DIMS)))).alias("dim", "cell"))
    counts = cells.groupBy("grp", "dim", "cell").agg(F.count("*").alias("n"))
    by = Window.partitionBy("grp", "dim")
    ranked = counts.withColumn("upto", F.sum("n").over(by.orderBy("cell"))).withColumn("total", F.sum("n").over(by))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("cell"))) / FINE
    quartiles = ranked.groupBy("grp", "dim").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    pick = lambda d, c: F.max(F.when(F.col("dim") == d, c))
    return quartiles.groupBy("grp").agg(
        *(pick(d, F.col("q2")).alias(f"q{d}") for d in range(DIMS)), *(pick(d, F.greatest((F.col("q3") - F.col("q1")) / 1.349, F.lit(FLOORS[d]))).alias(f"s{d}") for d in range(DIMS))
    )


def _beside(rows: DataFrame, estimates: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with their group's estimates: broadcast while the groups are few, so that a hot group is never dealt to one task."""
    return rows.join(F.broadcast(estimates) if estimates.count() <= 4 * BROADCAST_GROUPS else estimates, "grp", how)


def _starts(points: DataFrame) -> DataFrame:
    """(grp, start, estimate, logdet) of the four starts."""
    medians = materialize(_medians(points), "medians")
    rows = _beside(points, medians)
    z = [(F.col(f"x{i}") - F.col(f"q{i}")) / F.col(f"s{i}") for i in range(DIMS)]
    norm = F.greatest(F.sqrt(reduce(lambda a, b: a + b, (c * c for c in z))), F.lit(1e-9))
    seen = rows.select("grp", *(f"x{i}" for i in range(DIMS)), *(c / norm for c in z), *(F.tanh(c) for c in z)).toDF("grp", *(f"{k}{i}" for k in "xut" for i in range(DIMS)))
    centre, scale = [F.col(f"q{i}") for i in range(DIMS)], [F.col(f"s{i}") for i in range(DIMS)]
    out = [_factored(medians, ["grp"], centre, {(i, j): scale[i] * scale[j] if i == j else F.lit(0.0) for i, j in PAIRS}).withColumn("start", F.lit(0))]
    whole = seen.groupBy("grp").agg(*_sums([F.col(f"x{i}") for i in range(DIMS)]))
    out.append(_factored(whole, ["grp"], *_covariance(1.0)).withColumn("start", F.lit(1)))
    for start, kind in ((2, "u"), (3, "t")):
        sums = seen.groupBy("grp").agg(*_sums([F.col(f"{kind}{i}") for i in range(DIMS)])).join(medians, "grp")
        cov = _covariance(1.0)[1]
        like = {(i, j): scale[i] * scale[j] * (F.lit(1.0) if i == j else F.coalesce(cov[i, j] / F.sqrt(F.greatest(cov[i, i] * cov[j, j], F.lit(1e-18))), F.lit(0.0))) for i, j in PAIRS}
        out.append(_factored(sums, ["grp"], centre, like).withColumn("start", F.lit(start)))
    return reduce(DataFrame.unionByName, out)


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution in the scatter's Cholesky factor."""
    for i in range(DIMS):
        known = reduce(lambda a, j: a - F.col(f"l{i}{j}") * F.col(f"y{j}"), range(i), F.col(f"x{i}") - F.col(f"m{i}"))
        rows = rows.withColumn(f"y{i}", known / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", reduce(lambda a, b: a + b, (F.col(f"y{i}") * F.col(f"y{i}") for i in range(DIMS)))).drop(*(f"y{i}" for i in range(DIMS)))


def _step(points: DataFrame, estimate: DataFrame) -> DataFrame:
    """A concentration step of every start: the estimate from the nearest HALF of each group."""
    far = _distance(_beside(points, estimate)).withColumn("cell", F.floor(F.log2(F.col("d2") + 1e-6) * OCTAVE))
    cells = far.groupBy("grp", "start", "cell").agg(*_sums([F.col(f"x{i}") for i in range(DIMS)]))
    by = Window.partitionBy("grp", "start")
    near = cells.withColumn("before", F.sum("n").over(by.orderBy("cell")) - F.col("n")).withColumn("total", F.sum("n").over(by))
    share = F.least(F.lit(1.0), (HALF * F.col("total") - F.col("before")) / F.col("n"))
    near = near.withColumn("share", share).where("share > 0")
    now = near.groupBy("grp", "start").agg(*(F.sum(F.col("share") * F.col(c)).alias(c) for c in ("n", *(f"a{i}" for i in range(DIMS)), *(f"p{i}{j}" for i, j in PAIRS))))
    return _factored(now, ["grp", "start"], *_covariance(CONSISTENCY))


def least_determinants(points: DataFrame, steps: int = STEPS) -> DataFrame:
    """points(grp, x0..) -> (grp, estimate, logdet): of each group the settled estimate with the least determinant."""
    estimate = materialize(_starts(points), "starts")
    for _ in range(steps):
        old, estimate = estimate, materialize(_step(points, estimate), "estimates")
        moved = estimate.alias("n").join(old.alias("o"), ["grp", "start"]).agg(F.max(F.abs(F.col("n.logdet") - F.col("o.logdet")))).first()[0]
        discard(old)
        if moved is None or moved <= SETTLED:
            break
    best = estimate.groupBy("grp").agg(F.min(F.struct("logdet", "start", *ESTIMATE)).alias("b"))
    return best.select("grp", *(F.col(f"b.{c}").alias(c) for c in (*ESTIMATE, "logdet")))


def _named(distinct: DataFrame, least: int) -> DataFrame:
    """(lang, source, grp, feeds): the group that judges a language and source, and the groups its vectors count in."""
    sizes = distinct.groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = Window.partitionBy("lang")
    sizes = sizes.withColumn("of_lang", F.sum("n").over(by_lang))
    own, lang = F.concat(F.lit("s:"), F.to_json(F.struct("lang", "source"))), F.concat(F.lit("l:"), F.to_json(F.struct("lang")))
    sizes = sizes.withColumn("grp", F.when(F.col("n") >= least, own).when(F.col("of_lang") >= least, lang).otherwise("all"))
    sizes = sizes.withColumn("lang_name", lang).withColumn("in_lang", F.when(F.max((F.col("grp") == F.col("lang_name")).cast("int")).over(by_lang) == 1, F.col("lang_name")))
    sizes = sizes.withColumn("in_all", F.lit(None if sizes.where("grp = 'all'").isEmpty() else "all").cast("string"))
    return sizes.select("lang", "source", "grp", F.filter(F.array(F.when(F.col("n") >= least, F.col("grp")), "in_lang", "in_all"), lambda g: g.isNotNull()).alias("feeds"))


def judged(stats: DataFrame, tail: float = TAIL, steps: int = STEPS, least: int = LEAST) -> DataFrame:
    """stats with base_failed, grp (the group that judged the row), d2 and kept."""
    rows = stats.withColumn("base_failed", base_failed()).select("*", *vector())
    xs = [f"x{i}" for i in range(DIMS)]
    distinct = materialize(rows.where(~F.col("base_failed")).select("lang", "source", *xs).distinct(), "vectors")
    named = materialize(_named(distinct, least), "groups")
    few = named.count() <= BROADCAST_GROUPS
    of = lambda df, *what: df.alias("d").join(F.broadcast(named.alias("g")) if few else named.alias("g"), F.col("d.lang").eqNullSafe(F.col("g.lang")) & F.col("d.source").eqNullSafe(F.col("g.source")), "left").select(*what)
    points = materialize(of(distinct, F.explode("g.feeds").alias("grp"), *(f"d.{x}" for x in xs)).distinct(), "points")
    known = points.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("grp")
    estimate = materialize(least_determinants(points, steps).join(known, "grp", "left_semi"), "estimate")
    discard(distinct, points)
    far = _distance(_beside(of(rows, "d.*", "g.grp"), estimate, "left"))
    return far.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= chi2_quantile(1 - tail, DIMS), F.lit(True)))


def quality(docs: DataFrame, tail: float = TAIL, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, grp, d2), one row for each row."""
    stats = materialize(statistics(docs, id_col, text_col, lang_col, source_col), "statistics")
    return judged(stats, tail).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "grp", "d2")
