"""Operator 4: benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers, names and units become typed slots, other words are lower-cased and freed of punctuation: a question with
other numbers or names keeps its template. Neighbouring names are one slot, and so are neighbouring numbers: "Anna" may
become "Mary Jane", and 25 "twenty five". Windows of ``window`` template words are hash-joined with those of the
benchmark. Hits on one diagonal (document place minus item place), or on diagonals at most ``DRIFT`` apart (a word more
or less in between), are one alignment of an item. An alignment counts if it covers enough of the item (or a long
enough stretch of it), and if its slots are consistent: going by places of the item, what share of them is filled as most
places of the same value are, and holds the value that most places of the same filling hold; the lesser share must reach
``CONSISTENT``. Filling every slot with the item's own values is a verbatim copy.

Where a text has a run of ``window`` capitalised words (a title, or all in capitals) capitals tell no names: such a text is
read a second time in lower case (``form`` 1), against the items in lower case. A document and an item that have alignments in
both forms are reported by the first.

The benchmark's windows are broadcast only if they are fewer than ``BROADCAST_ROWS``. A larger benchmark is joined by
shuffle: of documents only ids, places and hashes are dealt, with ``SALTS`` salts against passages that very many share,
and the words of a hit come from the documents that have one. A window with few words besides its slots says little about a
text: an item's windows count if they hold ``LITERALS`` such words, or as many as the best of its windows does.

Defined cases: null text is an empty text; texts and items under ``window`` words have no window and so no hit, nor have
items of nothing but slots; null ids of documents stay null, items without an id are left out; repeated rows share their
hits, rows of one id and another text have their own; empty tables give no hits; other columns are ignored. A text that
itself holds the marker characters U+0001..U+0004 is read as if its words were marked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import materialize

WINDOW = 8
#: Words other than slots that a window needs.
LITERALS = 4
#: Share of an item's windows, or windows in all, on one diagonal that make a leak.
SHARE, STRETCH = 0.5, 12
#: Words that an alignment may gain or lose at once, and least share of its slots' places that agree.
DRIFT, CONSISTENT = 3, 0.5
#: Windows of a benchmark that are still broadcast: rows of about 100 bytes, so 20 MB at most.
BROADCAST_ROWS = 200_000
#: Parts of a window's documents where the benchmark is not broadcast.
SALTS = 16
NAME, NUMBER, UNIT, JOINED = "\u0001", "\u0002", "\u0003", "\u0004"
# Units and number words that become slots.
UNITS = "mm|cm|m|km|g|kg|t|l|ml|s|sec|min|h|hr|hrs|hour|hours|minute|minutes|second|seconds|day|days|week|weeks|month|months|year|years|mile|miles|foot|feet|inch|inches|pound|pounds|dollar|dollars|euro|euros|cent|cents|usd|eur|percent|degrees|meter|meters|metre|metres|liter|liters|litre|litres|gram|grams"
NUMBER_WORDS = "two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|twenty|thirty|forty|fifty|hundred|thousand|million"
NUMBERS = rf"(?<![\p{{L}}\p{{N}}])(?:\p{{N}}+(?:[.,:/]\p{{N}}+)*|(?:{NUMBER_WORDS})(?![\p{{L}}\p{{N}}]))"
NAMES = r"(?<=[\p{L}\p{N},;:]\s)\p{Lu}[\p{L}'’-]*"


def marked(df: DataFrame) -> DataFrame:
    """body with slots marked by a leading character, and without punctuation around words."""
    marks = NAME + NUMBER + UNIT
    df = df.withColumn("body", F.regexp_replace(F.coalesce(F.col("body").cast("string"), F.lit("")), NAMES, NAME + "$0"))
    df = df.withColumn("body", F.regexp_replace("body", NUMBERS, NUMBER + "$0"))
    df = df.withColumn("body", F.when(F.col("body").contains(NUMBER), F.regexp_replace("body", rf"({NUMBER}[^\s]*\s)({UNITS})(?![\p{{L}}\p{{N}}])", "$1" + UNIT + "$2")).otherwise(F.col("body")))
    df = df.withColumn("body", F.regexp_replace("body", rf"(?<![\p{{L}}\p{{N}}])[^\p{{L}}\p{{N}}\s{marks}]+|[^\p{{L}}\p{{N}}\s{marks}]+(?![\p{{L}}\p{{N}}{marks}])", ""))
    # a name after a name, a number after a number: one slot
    return df.withColumn("body", F.regexp_replace("body", rf"\s{{1,3}}[{NAME}{NUMBER}](?:(?<={NAME}[^\s]{{1,40}}\s{{1,3}}{NAME})|(?<={NUMBER}[^\s]{{1,40}}\s{{1,3}}{NUMBER}))", JOINED))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _windows(df: DataFrame, window: int) -> DataFrame:
    """Adds filled (marked words), shape (template words) and hashes (one for each window, of one form).

    Explode hashes with posexplode_outer only: the inner form adds a filter on its size, for which the optimizer would
    write the whole expression of ``shape`` into the lambda, once for each word.
    """
    df = marked(df).withColumn("filled", _words(F.col("body")))
    df = df.withColumn("shape", _words(F.lower(F.regexp_replace("body", rf"([{NAME}{NUMBER}{UNIT}])[^\s]*", "$1"))))
    at = lambda i, k: F.get("shape", i + k)
    hashes = F.transform(F.slice("shape", 1, F.greatest(F.size("shape") - (window - 1), F.lit(0))), lambda w, i: F.xxhash64("form", w, *(at(i, k) for k in range(1, window))))
    return df.withColumn("hashes", hashes)


def _forms(df: DataFrame, window: int, every: bool = False) -> DataFrame:
    """Rows as they are (form 0), and again in lower case (form 1): those with a run of capitalised words, or every row."""
    run = F.col("body").rlike(rf"(?:(?<!\S)[^\p{{Ll}}\s]\S*+\s++){{{window - 1}}}[^\p{{Ll}}\s]")
    own, lower = F.struct(F.lit(0).alias("form"), F.col("body")), F.struct(F.lit(1).alias("form"), F.lower("body").alias("body"))
    forms = F.array(own, lower) if every else F.when(run, F.array(own, lower)).otherwise(F.array(own))
    return df.select(*(c for c in df.columns if c != "body"), F.explode(forms).alias("f")).select("*", "f.form", "f.body").drop("f")


def _literal(word: Column) -> Column:
    return ~(word.startswith(NAME) | word.startswith(NUMBER) | word.startswith(UNIT))


def bench_windows(benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(h, item_id, form, j, n_windows, item_words): the item's windows that hold enough literal words, for an item and form."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("body")).where("item_id is not null")
    all_of = _windows(_forms(items, window, every=True), window).select("item_id", "form", "shape", "filled", F.posexplode_outer("hashes").alias("j", "h"))
    told = all_of.where("h is not null").withColumn("said", F.size(F.filter(F.slice("shape", F.col("j") + 1, window), _literal)))
    told = told.withColumn("most", F.max("said").over(Window.partitionBy("item_id", "form"))).where(F.col("said") >= F.greatest(F.lit(1), F.least(F.lit(literals), F.col("most"))))
    told = told.select("h", "item_id", "form", "j", F.slice("filled", F.col("j") + 1, window).alias("item_words"))
    sizes = told.groupBy("item_id", "form").agg(F.count("*").alias("n_windows"))
    return told.join(sizes, ["item_id", "form"]).select("h", "item_id", "form", "j", "n_windows", "item_words")


def _hits(rows: DataFrame, bench: DataFrame, window: int) -> DataFrame:
    """(rid, doc_id, item_id, form, diagonal, j, n_windows, item_words, words): windows that rows and items share."""
    probes = _windows(_forms(rows, window), window)
    item = ["item_id", "form", "j", "n_windows", "item_words"]
    if bench.count() <= BROADCAST_ROWS:
        hits = probes.select("rid", "doc_id", "filled", F.posexplode_outer("hashes").alias("i", "h")).join(F.broadcast(bench), "h")
    else:
        dealt = probes.select("rid", F.posexplode_outer("hashes").alias("i", "h")).withColumn("salt", F.pmod("rid", F.lit(SALTS)))
        salted = bench.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = materialize(dealt.join(salted, ["h", "salt"]).select("rid", "i", *item).dropDuplicates(["rid", "form", "i", "item_id", "j"]), "met")
        wanted = materialize(met.select("rid").distinct(), "wanted")
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        hit = rows.join(wanted, "rid", "left_semi").groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("body").alias("body"))
        hits = met.join(_windows(_forms(hit, window), window).select("rid", "form", "doc_id", "filled"), ["rid", "form"])
    return hits.select("rid", "doc_id", *item, (F.col("i") - F.col("j")).alias("diagonal"), F.slice("filled", F.col("i") + 1, window).alias("words"))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, place, n_hits, share, n_slots, consistent, verbatim): alignments of items in documents.

    place: the word of the document where the item would start; n_hits: item windows found there; share: of the item's
    windows; n_slots: slots compared; consistent: share of them that agree; verbatim: all of them the item's own.
    """
    bench = materialize(bench_windows(benchmark, window), "bench")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("body"))
    rows = rows.withColumn("rid", F.xxhash64("doc_id", "body"))
    hits = materialize(_hits(rows, bench, window).dropDuplicates(["rid", "item_id", "form", "diagonal", "j"]), "hits")
    by = Window.partitionBy("rid", "item_id", "form").orderBy("diagonal", "j")
    hits = hits.withColumn("new", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > DRIFT, F.lit(True)).cast("int")).withColumn("nth", F.sum("new").over(by))
    key = ["rid", "item_id", "form", "nth"]
    found = hits.groupBy(*key).agg(F.first("doc_id").alias("doc_id"), F.min("diagonal").alias("place"), F.countDistinct("j").alias("n_hits"), F.max("n_windows").alias("n_windows"))
    found = found.where((F.col("n_hits") >= SHARE * F.col("n_windows")) | (F.col("n_hits") >= STRETCH))
    pairs = F.filter(F.transform(F.arrays_zip("item_words", "words"), lambda p, k: F.struct((F.col("j") + k).alias("at"), p["item_words"].alias("own"), p["words"].alias("other"))), lambda p: ~_literal(p["own"]))
    slots = hits.select(*key, F.explode(pairs).alias("p")).select(*key, "p.*").distinct()
    both = slots.groupBy(*key, "own", "other").agg(F.count("*").alias("n"))
    most = lambda side: both.groupBy(*key, side).agg(F.max("n").alias("most"), F.sum("n").alias("n")).groupBy(*key).agg(F.sum("most").alias(f"by_{side}"), F.sum("n").alias("n_slots"))
    changed = both.groupBy(*key).agg(F.max(F.col("own") != F.col("other")).alias("changed"))
    told = most("own").join(most("other").drop("n_slots"), key).join(changed, key)
    told = told.withColumn("consistent", F.least("by_own", "by_other") / F.col("n_slots"))
    out = found.join(told, key, "left").withColumn("consistent", F.coalesce("consistent", F.lit(1.0))).where(F.col("consistent") >= CONSISTENT)
    out = out.withColumn("least", F.min("form").over(Window.partitionBy("rid", "item_id"))).where("form = least")
    return out.select("doc_id", "item_id", "place", "n_hits", (F.col("n_hits") / F.col("n_windows")).alias("share"), F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"), "consistent", (~F.coalesce("changed", F.lit(False))).alias("verbatim"))
