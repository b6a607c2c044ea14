"""Quality classifier over random-indexing word vectors (operator 12).

A text's words are its runs of letters and digits, case kept, and its runs of
other signs.  By its hash a word has a sparse index vector (``ACTIVE`` entries of
+1 or -1 among ``WIDTH``) and a bucket.  A bucket's context vector is the sum
of the index vectors of the words within ``REACH`` places of its words, over
every word of every document: a task adds up its own share, and shares are added
block by block, in two rounds, so that no task sees more than a part of them.
What comes out has a fixed size, whatever the corpus, and goes to the tasks.
Buckets make word vectors of an open vocabulary possible without a table of all
words and their vectors (hundreds of bytes for each word that ever occurs); rare
words that share one blur, frequent ones drown what else is in theirs.

The corpus' mean context is taken off every vector and the rest is brought to unit
length.  A document is pooled to the mean and spread of its words' vectors, the
lengths of that mean and of its words' mean index vector, the mean product of
the index vectors of words that follow each other, and the number of words.  A network of one hidden layer
turns these into a logit; it is fitted in numpy on at most ``max_rows`` labelled
rows (those with the least hashes of their ids), but for a fifth of them, on which
the temperature that divides the logit is fitted afterwards.

Labels are learned from rows whose crc32(id as text) mod 5 is not 0 only; no
label, language, source or id is an input of a score.

Defined results: null and empty texts have no words and get the score of that;
null ids have no label and are not held out; null labels are left out, and several
labels of one id count as their rounded mean; without labels every score is one half,
and with labels of one kind only it is their smoothed share; equal texts get equal
scores; repeated rows are scored each; an empty table gives an empty result; input
columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .decontam import LooseWords
from .durable import remove, scratch_path, written
from .rows import need, others, spare
from .textkit import Words, hash_spans, list_array, mix64, raw_bytes, slices, spans, tidy

WIDTH, ACTIVE, REACH = 64, 4, 2
BUCKETS = 1 << 14
#: Buckets whose sums travel together.
BLOCK = 1 << 10
#: Parts that the tasks' shares are dealt to before they are added up over all.
ROUNDS = 32
SAMPLE_ROWS = 20_000
#: Inputs of the network.
INPUTS = 2 * WIDTH + 4
HIDDEN, EPOCHS, BATCH, RATE, RIDGE = 32, 30, 256, 0.003, 1e-4
FOLDS = 5
#: The score from which a document counts as good.
CUT = 0.3
OUTPUTS = {"held_out": T.BooleanType(), "score": T.DoubleType(), "predicted": T.IntegerType()}
_SIGN = Words.inside & ~LooseWords.inside


class Tokens:
    """Words and runs of signs of every row of a string column, in order: hashes, rows and their bounds."""

    def __init__(self, column: pa.Array):
        buf, offsets = raw_bytes(column)
        parts = [spans(buf, offsets, mask[buf]) for mask in (LooseWords.inside, _SIGN)]
        starts, ends = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
        self.hashes = hash_spans(buf, starts, ends)
        self.bounds = np.searchsorted(starts, offsets)
        self.counts = np.diff(self.bounds)
        self.rows = np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def buckets(self) -> np.ndarray:
        return (self.hashes % np.uint64(BUCKETS)).astype(np.int64)


def index_vectors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the nonzero entries of each word's index vector; a place may come twice."""
    bits = mix64(hashes ^ np.uint64(0xA24BAED4963EE407))
    shifts = np.arange(ACTIVE, dtype=np.uint64) * np.uint64(8)
    places = (bits[:, None] >> shifts) % np.uint64(WIDTH)
    signs = (bits[:, None] >> (shifts + np.uint64(32))) & np.uint64(1)
    return places.astype(np.int64), signs.astype(np.int64) * 2 - 1


def context_sums(tokens: Tokens) -> np.ndarray:
    """Row b: the sum of the index vectors around the words of bucket b, and at the end the number of these words."""
    bucket, rows = tokens.buckets, tokens.rows
    places, signs = index_vectors(tokens.hashes)
    total = np.zeros(BUCKETS * WIDTH)
    for k in range(1, REACH + 1):
        at = np.flatnonzero(rows[:-k] == rows[k:]) if len(rows) > k else np.empty(0, np.int64)
        for word, around in ((at, at + k), (at + k, at)):
            key = bucket[word][:, None] * WIDTH + places[around]
            total += np.bincount(key.reshape(-1), signs[around].reshape(-1), BUCKETS * WIDTH)
    return np.c_[total.reshape(BUCKETS, WIDTH), np.bincount(bucket, minlength=BUCKETS)].astype(np.int64)


def corpus_contexts(texts: DataFrame) -> np.ndarray:
    """The context sums over every text of the one column ``text``."""

    @tidy
    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in slices(batch, "text"):
                one = context_sums(Tokens(part.column("text")))
                total = one if total is None else total + one
        if total is not None:
            blocks = range(BUCKETS // BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([total[b * BLOCK : (b + 1) * BLOCK].tobytes() for b in blocks])], names=["block", "sums"])

    @tidy
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                one = np.frombuffer(sums.as_buffer(), np.int64)
                totals[block] = totals[block] + one if block in totals else one.copy()
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()])], names=["block", "sums"])

    schema = "block int, sums binary"
    first = texts.mapInArrow(share, schema).withColumn("part", F.spark_partition_id() % ROUNDS)
    second = first.repartition("block", "part").select("block", "sums").mapInArrow(added, schema)
    rows = second.repartition("block").mapInArrow(added, schema).toArrow().to_pylist()
    out = np.zeros((BUCKETS, WIDTH + 1), dtype=np.int64)
    for r in rows:
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["sums"], np.int64).reshape(BLOCK, WIDTH + 1)
    return out


def word_vectors(contexts: np.ndarray) -> np.ndarray:
    """Unit vectors of the buckets: contexts without the corpus' mean context."""
    sums, n = contexts[:, :WIDTH].astype(float), contexts[:, WIDTH].astype(float)
    away = sums - n[:, None] * (sums.sum(axis=0) / max(n.sum(), 1))
    return (away / (np.linalg.norm(away, axis=1, keepdims=True) + 1)).astype(np.float32)


def pooled(tokens: Tokens, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of every row, the lengths of the mean and of the mean index vector, the mean product of neighbours' index vectors, the logarithm of the number of words."""
    n = len(tokens.counts)
    places, signs = index_vectors(tokens.hashes)
    index = np.bincount((tokens.rows[:, None] * WIDTH + places).reshape(-1), signs.reshape(-1), n * WIDTH).reshape(n, WIDTH)
    near = np.flatnonzero(tokens.rows[:-1] == tokens.rows[1:])
    product = sum(((places[near] == np.roll(places, k, axis=1)[near + 1]) * signs[near] * np.roll(signs, k, axis=1)[near + 1]).sum(axis=1) for k in range(ACTIVE))
    alike = np.bincount(tokens.rows[near], product, n)
    key, times = np.unique(tokens.rows * BUCKETS + tokens.buckets, return_counts=True)
    row, bucket = key // BUCKETS, key % BUCKETS
    mean, square = np.zeros((n, WIDTH)), np.zeros((n, WIDTH))
    if len(key):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        v = vectors[bucket]
        weighted = v * times[:, None].astype(np.float32)
        mean[row[first]] = np.add.reduceat(weighted, first, axis=0)
        square[row[first]] = np.add.reduceat(weighted * v, first, axis=0)
    count = np.maximum(tokens.counts, 1)[:, None]
    mean, square = mean / count, square / count
    return np.c_[mean, np.sqrt(np.maximum(square - mean * mean, 0)), np.linalg.norm(mean, axis=1), np.linalg.norm(index, axis=1) / count[:, 0], alike / count[:, 0], np.log1p(tokens.counts)]


@dataclass
class Network:
    """Standardised inputs, a hidden layer of tanh, a logit over a temperature; without layers the bias alone."""

    centre: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def constant(width: int, p: float) -> Network:
    return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))


def loss_and_gradient(net: Network, z: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy with a ridge on the weights, and its gradient, over standardised rows."""
    h = np.tanh(z @ net.w1 + net.b1)
    logit = h @ net.w2 + net.b2
    loss = np.mean(np.logaddexp(0, logit) - y * logit) + RIDGE / 2 * ((net.w1**2).sum() + (net.w2**2).sum())
    d = (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - y) / len(y)
    dh = d[:, None] * net.w2 * (1 - h * h)
    return loss, [z.T @ dh + RIDGE * net.w1, dh.sum(axis=0), h.T @ d + RIDGE * net.w2, np.array(d.sum())]


def temperature_of(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden section over its logarithm."""
    loss = lambda t: np.mean(np.logaddexp(0, logits / np.exp(t)) - y * logits / np.exp(t))
    lo, hi, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, seed: int = 0) -> Network:
    """The network of the rows that are not to calibrate by, by Adam over shuffled batches; its temperature is that of the others."""
    if not len(y) or y.min() == y.max():
        return constant(x.shape[1], (y.sum() + 0.5) / (len(y) + 1))
    own = ~calibrate if len(np.unique(y[~calibrate])) == 2 else np.ones(len(y), bool)
    rng, d = np.random.default_rng(seed), x.shape[1]
    net = Network(x[own].mean(axis=0), x[own].std(axis=0) + 1e-6, rng.normal(size=(d, HIDDEN)) / np.sqrt(d), np.zeros(HIDDEN), rng.normal(size=HIDDEN) / np.sqrt(HIDDEN), 0.0)
    z, t = (x[own] - net.centre) / net.spread, y[own]
    m, v, k = [0.0] * 4, [0.0] * 4, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(t))
        for at in range(0, len(t), BATCH):
            k += 1
            _, grad = loss_and_gradient(net, z[order[at : at + BATCH]], t[order[at : at + BATCH]])
            m = [0.9 * a + 0.1 * g for a, g in zip(m, grad)]
            v = [0.999 * a + 0.001 * g * g for a, g in zip(v, grad)]
            rate = RATE * (1 - epoch / EPOCHS)
            w1, b1, w2, b2 = (rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.999**k)) + 1e-8) for a, b in zip(m, v))
            net.w1, net.b1, net.w2, net.b2 = net.w1 - w1, net.b1 - b1, net.w2 - w2, float(net.b2 - b2)
    if len(np.unique(y[calibrate])) == 2:
        net.temperature = temperature_of(net.logits(x[calibrate]), y[calibrate])
    return net


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, max_rows: int) -> Network:
    """The network of (id, text) under labels (id, label) outside of the held-out fold."""
    spark, width = docs.sparkSession, INPUTS
    known = labels.where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id")))
    path = scratch_path(spark, "labels")
    try:
        # at most max_rows ids, those of the least hashes
        picked = written(known.groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_rows), "labels", path)
        shared = spark.sparkContext.broadcast(vectors)

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    x = pooled(Tokens(part.column("text")), shared.value)
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), list_array(x.reshape(-1), np.arange(0, x.size + 1, width), pa.float64())], names=["id", "label", "x"])

        rows = docs.join(F.broadcast(picked), "id").select("id", "label", "text").mapInArrow(run, "id long, label int, x array<double>")
        found = rows.orderBy(F.xxhash64("id"), "id", "x").limit(max_rows).toArrow()
    finally:
        remove(spark, path)
    x = np.array(found.column("x").to_pylist(), dtype=float).reshape(-1, width)
    y = found.column("label").to_numpy().astype(float)
    calibrate = mix64(found.column("id").to_numpy().astype(np.int64).view(np.uint64)) % np.uint64(FOLDS) == 0
    return train(x, y, calibrate)


def quality_scores(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "quality", max_rows: int = SAMPLE_ROWS) -> DataFrame:
    """df with held_out, score and predicted; its text column is scored whole."""
    need(df, id, text)
    need(labels, label_id, label)
    docs = df.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    vectors = word_vectors(corpus_contexts(docs.select("text")))
    net = fit(docs, labels.select(F.col(f"`{label_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("double").alias("label")), vectors, max_rows)
    shared = df.sparkSession.sparkContext.broadcast((vectors, net))
    kept, body, held = others(df, *OUTPUTS), spare(df, "text"), spare(df, "held")
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(body), held_out(F.col(f"`{id}`")).alias(held))
    schema = T.StructType([*df.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, *[T.StructField(k, t) for k, t in OUTPUTS.items()]])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = shared.value
        for batch in batches:
            for part in slices(batch, body):
                score = net.scores(pooled(Tokens(part.column(body)), vectors))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(kept))], part.column(len(kept) + 1), pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=[*kept, *OUTPUTS])

    return source.mapInArrow(run, schema)
