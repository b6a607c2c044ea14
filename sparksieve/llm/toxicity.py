"""Severity of toxicity by cumulative-link ordinal regression (operator 8).

Terms are counted over all labelled documents; the ``FEATURES`` terms that tell
toxic from other documents best (largest |log-odds| / standard error) are the
features, log(1 + occurrences) their values.  The model is
P(grade > k) = sigmoid(w.x - theta_k) with one weight vector for all ordered
thresholds, fitted by full-batch gradient steps on a sample of at most
``max_rows`` labelled rows (a hash of the id picks them).  Every whole text is
scored; the expected severity is the sum of P(grade > k) over k.

Labels say toxic or not, so only the first threshold is learned from what people
said.  A toxic document's training grade 1, 2 or 3 is its tertile by the
score of a binary model fitted on the other half of the sample, which has not
seen it (cross-fitting): severity means how surely a stranger's model calls it toxic.

Defined results: null and empty texts have no terms; labels without a toxic
value are left out, several labels of one id count as toxic if one is; without
toxic or without other labels every severity is 0 or 3; documents with equal
texts get equal scores, and of two grades with equal mass the lower is the
severity; repeated rows are scored each; an empty table gives an empty result;
input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .decontam import LooseWords
from .durable import checked_broadcast, written
from .rows import need, others, spare
from .textkit import list_array, mix64, regrouped, signed, slices, tidy

#: Features, a documented bound of the classifier; more terms make it worse on rows it has not seen (see the README).
FEATURES = 2048
SAMPLE_ROWS = 20_000
#: Labelled documents that a term needs.
LEAST_DOCS = 5
STEPS, RATE, RIDGE = 400, 0.1, 1e-4
OUTPUTS = {"latent": T.DoubleType(), "expected_severity": T.DoubleType(), "p_toxic": T.DoubleType(), "severity": T.IntegerType(), "toxic": T.BooleanType()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Severity:
    """Sorted term hashes, their weights, the ordered thresholds."""

    terms: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def latent(self, words: LooseWords) -> np.ndarray:
        row, term, times = term_counts(words, self.terms)
        return np.bincount(row, self.weights[term] * np.log1p(times), len(words.counts)) if len(self.terms) else np.zeros(len(words.counts))

    def exceed(self, latent: np.ndarray) -> np.ndarray:
        """P(grade > k) for every threshold, a column each."""
        return sigmoid(latent[:, None] - self.thresholds)


def term_counts(words: LooseWords, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, occurrences) of the given terms in every text."""
    if not len(terms):
        none = np.empty(0, np.int64)
        return none, none, none
    at = np.minimum(np.searchsorted(terms, words.hashes), len(terms) - 1)
    hit = terms[at] == words.hashes
    key, times = np.unique(words.rows[hit] * len(terms) + at[hit], return_counts=True)
    return key // len(terms), key % len(terms), times


def fit(row: np.ndarray, term: np.ndarray, value: np.ndarray, grade: np.ndarray, terms: np.ndarray, levels: int = 3) -> Severity:
    """Maximum likelihood of the cumulative-link model with a ridge, by Adam."""
    n = len(grade)
    w = np.zeros(len(terms))
    share = np.clip([(grade > k).mean() if n else 0.0 for k in range(levels)], 1e-4, 1 - 1e-4)
    theta = -np.log(share / (1 - share))
    theta = np.maximum.accumulate(theta + np.arange(levels) * 1e-3)
    gaps = np.r_[theta[0], np.log(np.maximum(np.diff(theta), 1e-3))]
    p = np.r_[w, gaps]
    m, v = np.zeros(len(p)), np.zeros(len(p))
    for t in range(1, STEPS + 1 if n and len(terms) else 1):
        w, gaps = p[: len(terms)], p[len(terms) :]
        theta = np.cumsum(np.r_[gaps[0], np.exp(gaps[1:])])
        eta = np.bincount(row, w[term] * value, n)
        s = sigmoid(np.c_[np.full(n, 500.0), eta[:, None] - theta, np.full(n, -500.0)])
        i = np.arange(n)
        mass = np.maximum(s[i, grade] - s[i, grade + 1], 1e-12)
        ds = s * (1 - s)
        d_eta = (ds[i, grade] - ds[i, grade + 1]) / mass
        d_theta = np.zeros(levels + 2)
        np.add.at(d_theta, grade, -ds[i, grade] / mass)
        np.add.at(d_theta, grade + 1, ds[i, grade + 1] / mass)
        d_theta = d_theta[1:-1]
        tail = np.cumsum(d_theta[::-1])[::-1]
        g = np.r_[np.bincount(term, d_eta[row] * value, len(terms)) / n - RIDGE * w, np.r_[tail[0], tail[1:] * np.exp(gaps[1:])] / n]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    gaps = p[len(terms) :]
    return Severity(terms, p[: len(terms)], np.cumsum(np.r_[gaps[0], np.exp(gaps[1:])]))


def cross_fitted_grades(row: np.ndarray, term: np.ndarray, value: np.ndarray, toxic: np.ndarray, half: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """0 of documents that are not toxic; 1 to 3 of the toxic ones, by tertiles of the scores that the other half's model gives."""
    latent = np.zeros(len(toxic))
    for side in (False, True):
        place = np.cumsum(half != side) - 1
        own = half[row] != side
        model = fit(place[row[own]], term[own], value[own], toxic[half != side], terms, levels=1)
        latent += np.where(half == side, np.bincount(row, model.weights[term] * value, len(toxic)), 0.0)
    grade = np.zeros(len(toxic), dtype=np.int64)
    bad = toxic == 1
    if bad.any():
        grade[bad] = 1 + np.searchsorted(np.quantile(latent[bad], [1 / 3, 2 / 3]), latent[bad])
    return grade


def term_table(labelled: DataFrame) -> DataFrame:
    """(term, bad, good): labelled documents of either kind that have each term; input (text, toxic)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in regrouped(batches, "text", 4 << 20):
            found = []
            toxic = part.column("toxic").to_numpy(zero_copy_only=False)
            at = 0
            for s in slices(part, "text"):
                w = LooseWords(s.column("text"))
                order = np.lexsort((w.hashes, w.rows))
                h, r = w.hashes[order], w.rows[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                found.append((h[new], toxic[at + r[new]]))
                at += s.num_rows
            h, bad = (np.concatenate(x) for x in zip(*found))
            term, place = np.unique(h, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(term)), pa.array(np.bincount(place, bad, len(term)).astype(np.int64)), pa.array(np.bincount(place, 1 - bad, len(term)).astype(np.int64))], names=["term", "bad", "good"])

    return labelled.mapInArrow(run, "term long, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> Severity:
    """The model of (id, text) under labels (id, toxic)."""
    known = written(labels.where("id is not null and toxic is not null").groupBy("id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")), "labels")
    size = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    n, bad = size["n"], size["bad"]
    joined = docs.join(checked_broadcast(known), "id").select("id", "text", "toxic")
    bads, goods = float(bad), float(n - bad)
    odds = F.log((F.col("bad") + 0.5) / (bads - F.col("bad") + 0.5)) - F.log((F.col("good") + 0.5) / (goods - F.col("good") + 0.5))
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    scored = term_table(joined).where(F.col("bad") + F.col("good") >= LEAST_DOCS).select("term", "bad", "good", F.abs(odds / error).alias("z"))
    best = scored.orderBy(F.desc("z"), "term").limit(features).toArrow()
    terms = best.column("term").to_numpy().view(np.uint64)
    terms = np.sort(terms)
    picked = joined.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(min(1.0, max_rows / max(1, n)) * 1_000_000))
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, term, times = term_counts(LooseWords(part.column("text")), shared.value)
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("toxic"), list_array(term, bounds, pa.int64()), list_array(times, bounds, pa.int64())], names=["id", "toxic", "terms", "times"])

    rows = picked.mapInArrow(run, "id long, toxic int, terms array<long>, times array<long>").orderBy(F.xxhash64("id"), "id").limit(max_rows).toArrow().combine_chunks()
    take = lambda name: rows.column(name).combine_chunks()
    lists = take("terms")
    size = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(lists)), size)
    term, times = lists.flatten().to_numpy(), take("times").flatten().to_numpy()
    toxic, half = take("toxic").to_numpy().astype(np.int64), (mix64(take("id").to_numpy().view(np.uint64)) & np.uint64(1)).astype(bool)
    grade = cross_fitted_grades(row, term, np.log1p(times), toxic, half, terms) if len(terms) else toxic
    return fit(row, term, np.log1p(times), grade, terms)


def toxicity(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "toxic", max_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> DataFrame:
    """df with the latent score, expected severity, P(toxic), the likeliest grade and a flag."""
    need(df, id, text)
    need(labels, label_id, label)
    docs = df.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    model = train(docs, labels.select(F.col(f"`{label_id}`").cast("long").alias("id"), F.col(f"`{label}`").alias("toxic")), max_rows, features)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept, body = others(df, *OUTPUTS), spare(df, "text")
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(body))
    schema = T.StructType([*df.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, *[T.StructField(k, t) for k, t in OUTPUTS.items()]])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, body):
                latent = model.latent(LooseWords(part.column(body)))
                over = model.exceed(latent)
                mass = np.c_[np.ones(len(over)), over] - np.c_[over, np.zeros(len(over))]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(len(kept))], pa.array(latent), pa.array(over.sum(axis=1)), pa.array(over[:, 0]), pa.array(mass.argmax(axis=1).astype(np.int32)), pa.array(over[:, 0] >= 0.5)], names=[*kept, *OUTPUTS]
                )

    return source.mapInArrow(run, schema)
