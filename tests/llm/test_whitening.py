"""Whitening against a direct eigendecomposition, and on hard rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparksieve.llm import queries, whitening


def brute(vectors, components=4):
    """(n, deviations, whitened up to sign, explained) by numpy, over rows of usable vectors."""
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for v in vectors], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    a = (n * fit - s) / n
    e, v = np.linalg.eigh(a.T @ a / n)
    e, v = e[::-1], v[:, ::-1]
    k = int((e[:components] > 1e-9 * max(e[0], 1e-300)).sum())
    z = (n * x - s) / n @ v[:, :k] / np.sqrt(e[:k])
    return n, ((n * x - s) ** 2).sum(axis=1), z, e[:k] / e.sum()


def compared(rows, vectors, tolerance=1e-8):
    n, dev, z, explained = brute(vectors)
    assert len(rows) == len(vectors) * len(explained)
    got = np.zeros_like(z)
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == dev[r.vec_id] and abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        assert r.identity_error < 1e-9
    for k in range(z.shape[1]):
        sign = np.sign(got[:, k] @ z[:, k])
        assert np.abs(got[:, k] - sign * z[:, k]).max() < tolerance


def frame(spark, vectors):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")


def test_query_equals_eigendecomposition(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    assert [r.vec_id for r in table] == list(range(len(table)))
    compared(queries.op11_embedding_whitening(spark, data).collect(), [r.embedding for r in table])


@pytest.mark.parametrize("kind", ["copies", "ill", "rank", "narrow", "flat"])
def test_shapes(spark, kind):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 6))
    if kind == "copies":
        v = np.vstack([v, np.repeat(v[:1], 200, axis=0)])
    if kind == "ill":
        v = v * 10.0 ** np.array([4, 4, 3, 3, 0, -1]) @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    if kind == "rank":
        v = np.round(v * 64) / 64
        v[:, 3:] = v[:, :3] + 1
    if kind == "narrow":
        v = v[:, :2]
    if kind == "flat":
        v[:, 1:] = 0.25
    compared(whitening.whiten(frame(spark, v)).collect(), v.tolist(), 1e-6)


def test_factors_reach_orthogonality_of_ill_conditioned_rows():
    """Condition 1e9 or so, whose square no plain Cholesky factor survives: the Gram matrix ends as the identity and R^T R is that of the rows."""
    rng = np.random.default_rng(5)
    a = np.linalg.qr(rng.normal(size=(500, 8)))[0] * 10.0 ** np.arange(0, -9.5, -1.3) @ np.linalg.qr(rng.normal(size=(8, 8)))[0]

    def gram_of(found):
        y = a
        for r in found:
            y = whitening.solved(y, r)
        return y.T @ y

    r, gram = whitening.factors(gram_of, len(a))
    assert np.abs(gram - np.eye(8)).max() < 1e-13
    assert np.abs(np.linalg.svd(r)[1] / np.linalg.svd(a)[1] - 1).max() < 1e-6
    assert np.allclose(r, np.triu(r))


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 7), (1, [1.0, 2.0], 7), (None, [3.0, 1.0], 8), (2, None, 1), (3, [], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0], 1), (8, [-0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int").withColumn("extra", F.lit("e"))
    got = whitening.whiten(df).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((str(i), c) for i in (1, 1, None, 8) for c in (1, 2))
    assert {r.n for r in got} == {3} and {r.extra for r in got} == {"e"}
    for keep in (df.limit(0), df.where("vec_id = 1"), df.where("vec_id = 2")):
        assert whitening.whiten(keep).columns == ["vec_id", "extra", *whitening.OUTPUTS] and not whitening.whiten(keep).collect()


def test_deviation_beyond_a_long_is_null():
    x = np.array([[1 << 40, 0], [3, 4]])
    assert whitening.deviations(x, 1 << 20, np.array([0, 0])).to_pylist() == [None, 25 << 40]
