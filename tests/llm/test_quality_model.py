"""The quality classifier: its parts against plain Python and finite differences, held-out accuracy, hard rows."""

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparksieve.llm import quality_model as qm
from sparksieve.llm import queries

from .common import LONG, hard, empty

TEXTS = ["the cat ### sat on THE mat.", None, "", "a", "!!", "Ünï çode—words, and more 123 words", "the cat\n\nthe cat the cat"]


def plain_tokens(text):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff \x09-\x0d]+", (text or "").encode())


def test_tokens_are_words_and_runs_of_signs():
    t = qm.Tokens(pa.array(TEXTS))
    assert t.counts.tolist() == [len(plain_tokens(x)) for x in TEXTS]
    flat = [w for x in TEXTS for w in plain_tokens(x)]
    same = {}
    for w, h in zip(flat, t.hashes.tolist()):
        assert same.setdefault(w, h) == h
    assert len(set(same.values())) == len(same)


def test_context_sums_equal_plain_loops(spark):
    t = qm.Tokens(pa.array(TEXTS))
    places, signs = qm.index_vectors(t.hashes)
    want = np.zeros((qm.BUCKETS, qm.WIDTH + 1), dtype=np.int64)
    for i, b in enumerate(t.buckets):
        want[b, qm.WIDTH] += 1
        for j in range(max(0, i - qm.REACH), min(len(t.hashes), i + qm.REACH + 1)):
            if i != j and t.rows[i] == t.rows[j]:
                for p, s in zip(places[j], signs[j]):
                    want[b, p] += s
    assert (qm.context_sums(t) == want).all()
    rows = spark.createDataFrame([(x,) for x in TEXTS * 7], "text string").repartition(5)
    assert (qm.corpus_contexts(rows) == 7 * want).all()


def test_pooling_equals_plain_means():
    vectors = np.random.default_rng(0).normal(size=(qm.BUCKETS, qm.WIDTH)).astype(np.float32)
    t = qm.Tokens(pa.array(TEXTS))
    x = qm.pooled(t, vectors)
    for r in range(len(TEXTS)):
        v = vectors[t.buckets[t.rows == r]].astype(float)
        mean = v.mean(axis=0) if len(v) else np.zeros(qm.WIDTH)
        spread = v.std(axis=0) if len(v) else np.zeros(qm.WIDTH)
        idx = np.zeros((len(v), qm.WIDTH))
        for i, h in enumerate(t.hashes[t.rows == r]):
            for p, s in zip(*(a[0] for a in qm.index_vectors(np.array([h])))):
                idx[i, p] += s
        length = np.linalg.norm(idx.mean(axis=0)) if len(v) else 0.0
        alike = sum(a @ b for a, b in zip(idx, idx[1:])) / max(1, len(v))
        assert np.allclose(x[r], [*mean, *spread, np.linalg.norm(mean), length, alike, np.log1p(len(v))], atol=1e-3)


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(1)
    z, y = rng.normal(size=(20, 5)), rng.integers(0, 2, 20).astype(float)
    net = qm.Network(np.zeros(5), np.ones(5), rng.normal(size=(5, 4)), rng.normal(size=4), rng.normal(size=4), 0.3)
    _, grad = qm.loss_and_gradient(net, z, y)
    for name, g in zip(("w1", "b1", "w2"), grad):
        flat = getattr(net, name)
        for at in np.ndindex(flat.shape):
            old, d = flat[at], 1e-6
            flat[at] = old + d
            up = qm.loss_and_gradient(net, z, y)[0]
            flat[at] = old - d
            down = qm.loss_and_gradient(net, z, y)[0]
            flat[at] = old
            assert abs((up - down) / (2 * d) - g[at]) < 1e-6


def test_temperature_is_the_best_of_a_grid():
    rng = np.random.default_rng(2)
    truth = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-truth))).astype(float)
    loss = lambda t: np.mean(np.logaddexp(0, 3 * truth / t) - y * 3 * truth / t)
    found = qm.temperature_of(3 * truth, y)
    assert 2.5 < found < 3.6 and loss(found) <= min(loss(t) for t in np.linspace(0.2, 10, 400)) + 1e-9


def test_held_out_accuracy(spark, data):
    d = data.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    rows = queries.op12_quality_classifier(spark, d).join(labels, "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.quality is not None]
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
    assert np.mean([r.predicted for r in held if r.quality == 1]) > 0.95
    assert np.mean([r.predicted for r in held if r.quality == 0]) < 0.4


def test_held_out_labels_change_nothing(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    turned = labels.withColumn("quality", F.when(qm.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in qm.quality_scores(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_hard_rows(spark):
    df = hard(spark).withColumn("score", F.lit("taken")).withColumn("held_out", F.lit(3))
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (4, None), (None, 1), (6, 0), (9, 1), (8, 1)], "doc_id long, quality int")
    for some in (labels, labels.limit(0), labels.where("quality = 1")):
        out = qm.quality_scores(df, some)
        rows = out.collect()
        assert len(rows) == df.count() and out.columns[-3:] == list(qm.OUTPUTS) and out.columns.count("score") == 1
        assert all(0 <= r.score <= 1 for r in rows) and not any(r.held_out for r in rows if r.doc_id is None)
        assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert {r.score for r in qm.quality_scores(df, labels.limit(0)).collect()} == {0.5}
    assert not qm.quality_scores(empty(spark), labels).collect()
    assert len(LONG) > 100_000
