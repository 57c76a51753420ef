"""Operator 5: toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w[t] + sum over pairs of terms <v[t], v[u]>), over the distinct terms of a text: besides each
term's own weight, a pair (an insult and the mention of a group) has one, from factors that pairs share. Pairs cost no
more than terms: for each factor the squared sum less the sum of squares, halved. Terms are lower-cased words without
punctuation, and their beginnings, hashed into ``BUCKETS``.

Fitting keeps a term for what it says alone or for what it says with another: its smoothed log-odds in the sample, or the
best gain of a pair, which is what the pair's texts leave unexplained once both terms have had their say (a two-by-two
table's interaction over its standard error). So a pair of terms that are harmless apart is kept as well, and terms that
keep company with the label by chance are not. Pairs are tried among the ``PAIR_TERMS`` terms with the most even split.
Then full-batch Adam fits weights and factors together, so that equal rows give an equal model.

The sample: at most ``SAMPLE`` labelled texts and ``SAMPLE_BYTES`` bytes of them (those with the smallest hash of their id),
which bounds the driver's work whatever the corpus. Scoring covers every whole text, with the model sent to all executors:
at most ``BUCKETS`` terms of (1 + FACTORS) numbers, in practice some thousands.

Defined cases: null text is an empty text, which scores the model's intercept; a label without id, text row or value is
left out; several labels of one id count as toxic if one is, several texts of one id as the first in byte order; without
labels every score is 0; a null id is not held out and stays null; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import materialize, slices, texts, unpack
from tracelake.llm.common import pack as packed

SAMPLE, SAMPLE_BYTES = 4000, 32 << 20
BUCKETS, FACTORS = 1 << 20, 4
#: Terms among which pairs are tried.
PAIR_TERMS = 4096
#: Texts of the sample that a term must be in.
LEAST_TEXTS = 5
#: Texts without association that smooth a term's log-odds.
SMOOTH = 20.0
#: Least log-odds, either way, of a term that is kept for itself, and least standard errors of a pair's interaction.
LEAST_ODDS, LEAST_GAIN = 0.3, 6.5
STEPS, RATE, L2_WEIGHTS, L2_FACTORS = 150, 0.05, 1e-3, 3e-3
#: Lengths of a word's beginnings that are terms.
STEMS = range(4, 9)
EDGES = re.compile(rb"^[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+$")


def terms_of(word: bytes) -> list[int]:
    """Buckets of a word as it stands: of the word, and of its beginnings (inflected insults share a stem)."""
    text = EDGES.sub(b"", word.decode("utf-8", "replace").lower().encode()).decode("utf-8", "replace")
    return [xxhash.xxh64_intdigest(p) % BUCKETS for p in (text, *(text[:n] + "\0" for n in STEMS if len(text) >= n))]


class Known(dict):
    """What is asked of a word, kept for words seen; emptied when full."""

    def __init__(self, of) -> None:
        self.of = of

    def __missing__(self, word: bytes):
        if len(self) > 150_000:
            self.clear()
        got = self[word] = self.of(word)
        return got


def terms(body: bytes, known: Known) -> np.ndarray:
    return np.unique(np.array([t for w in set(body.split()) for t in known[w]], np.int64))


@dataclass
class Machine:
    buckets: np.ndarray  # sorted
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def known(self) -> Known:
        """Places of a word's terms in the model; most words have none."""
        place = {int(b): i for i, b in enumerate(self.buckets)}
        return Known(lambda word: tuple(place[t] for t in terms_of(word) if t in place))

    def scores(self, bodies: list[bytes], known: Known) -> np.ndarray:
        out = np.full(len(bodies), self.bias)
        for i, body in enumerate(bodies):
            at = sorted({t for w in set(body.split()) for t in known[w]})
            if at:
                v = self.factors[at]
                out[i] += self.weights[at].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v * v).sum())
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def pair_gains(of: np.ndarray, term: np.ndarray, labels: np.ndarray, n_terms: int, most: int = PAIR_TERMS) -> np.ndarray:
    """For each term the largest interaction with another, in standard errors; (of, term): which texts hold which terms."""
    n, gains = len(labels), np.zeros(n_terms)
    seen = np.bincount(term, minlength=n_terms)
    chosen = np.sort(np.lexsort((np.arange(n_terms), -np.minimum(seen, n - seen)))[:most])
    place = np.full(n_terms, -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((n, len(chosen)), np.float32)
    inside = place[term] >= 0
    x[of[inside], place[term[inside]]] = 1
    y = labels.astype(np.float32)
    size, bad, yx = x.sum(axis=0), x.T @ y, x * y[:, None]
    for s in range(0, len(chosen), 512):
        rows = slice(s, s + 512)
        n11, k11 = x[:, rows].T @ x, yx[:, rows].T @ x
        n10, k10 = size[rows, None] - n11, bad[rows, None] - k11
        n01, k01 = size[None, :] - n11, bad[None, :] - k11
        n00, k00 = n - n11 - n10 - n01, y.sum() - k11 - k10 - k01
        z, variance = np.zeros_like(n11), np.zeros_like(n11)
        for count, of_bad, sign in ((n11, k11, 1), (n10, k10, -1), (n01, k01, -1), (n00, k00, 1)):
            p = (of_bad + 0.5) / (count + 1)
            z += sign * p
            variance += p * (1 - p) / np.maximum(count, 1e-9)
        z = np.abs(z) / np.sqrt(variance)
        z[np.minimum(np.minimum(n11, n10), np.minimum(n01, n00)) < LEAST_TEXTS] = 0
        gains[chosen[rows]] = np.maximum(gains[chosen[rows]], z.max(axis=1))
    return gains


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7, factors: int = FACTORS) -> Machine:
    """rows: sorted distinct buckets of each text's terms; labels: 0 or 1."""
    if not len(labels):
        return Machine(np.zeros(0, np.int64), -50.0, np.zeros(0), np.zeros((0, factors)))
    n = len(labels)
    rate = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    of = np.repeat(np.arange(n), list(map(len, rows)))
    buckets, term = np.unique(np.concatenate(rows), return_inverse=True)
    seen, toxic = np.bincount(term, minlength=len(buckets)), np.bincount(term, labels[of], minlength=len(buckets))
    value = np.log((toxic + SMOOTH * rate) / rate / ((seen - toxic + SMOOTH * (1 - rate)) / (1 - rate)))
    often = (seen >= LEAST_TEXTS) & (seen < n)
    alone = often & (np.abs(value) >= LEAST_ODDS)
    paired = often & ~alone & (pair_gains(of, term, labels, len(buckets)) >= LEAST_GAIN)
    value[paired] = 1.0
    keep = alone | paired
    place = np.cumsum(keep) - 1
    buckets, value, of, term = buckets[keep], value[keep], of[keep[term]], place[term[keep[term]]]
    bias = np.array([np.log(rate / (1 - rate))])
    if not len(buckets):
        return Machine(buckets, float(bias[0]), np.zeros(0), np.zeros((0, factors)))
    by_term = np.argsort(term, kind="stable")
    term_starts = np.searchsorted(term[by_term], np.arange(len(buckets)))
    of_sorted = of[by_term]
    row_starts = np.searchsorted(of, np.arange(n))
    empty = np.bincount(of, minlength=n) == 0

    def by_row(x: np.ndarray) -> np.ndarray:
        out = np.add.reduceat(np.concatenate([x, np.zeros((1, *x.shape[1:]))]), np.minimum(row_starts, len(x)), axis=0)
        out[empty] = 0
        return out

    w, v = np.zeros(len(buckets)), np.random.default_rng(seed).normal(0, 0.05, (len(buckets), factors))
    # terms that are kept for themselves start without factors to speak of; those kept for a pair need some to grow from
    v[alone[keep]] *= 0.2
    v[paired[keep]] *= 4
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (bias, w, v)]
    for step in range(1, STEPS + 1):
        vx = (v * value[:, None])[term]
        total = by_row(vx)
        z = bias[0] + by_row((w * value)[term][:, None])[:, 0] + 0.5 * ((total**2).sum(axis=1) - by_row(vx * vx).sum(axis=1))
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels) / n
        gs = g[of_sorted]
        each = np.add.reduceat(gs, term_starts) * value
        grads = (
            np.array([g.sum()]),
            each + L2_WEIGHTS * w,
            np.add.reduceat(gs[:, None] * total[of_sorted], term_starts, axis=0) * value[:, None] - (each * value)[:, None] * v + L2_FACTORS * v,
        )
        for p, grad, s in zip((bias, w, v), grads, state):
            s[0] += 0.1 * (grad - s[0])
            s[1] += 0.001 * (grad * grad - s[1])
            p -= RATE * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8)
    return Machine(buckets, float(bias[0]), w * value, v * value[:, None])


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", factors: int = FACTORS) -> Machine:
    """labels(doc_id, toxic) -> a machine fitted on those that are not held out."""
    chosen = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out("doc_id"))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # SAMPLE rows of two numbers
    rows = texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("body").alias("body"))
    rows = materialize(rows, "labelled")
    upto = rows.select("doc_id", F.sum(F.length("body")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")).alias("upto")).where(F.col("upto") <= SAMPLE_BYTES).select("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(terms_of)
        for b in slices(batches):
            t = [packed(terms(x, known)) for x in b.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(t, pa.binary())], names=["doc_id", "toxic", "terms"])

    found = rows.join(F.broadcast(upto), "doc_id").select("doc_id", "toxic", "body").mapInArrow(run, "doc_id long, toxic int, terms binary").toPandas().sort_values("doc_id", kind="stable")
    return fit([unpack(t) for t in found["terms"]], found["toxic"].to_numpy(np.float64), factors=factors)


def scored(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row's whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value.known()
        for b in slices(batches):
            score = sent.value.scores(b.column("body").to_pylist(), known)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    out = texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
