"""Online search, masks and the Gaussian process against direct computations."""

import math

import numpy as np
from pyspark.sql import functions as F

from sparksieve.operators import grams
from sparksieve.plans import online, surrogate, tuning
from sparksieve.shared import scratch, stored
from test_surrogate import frame, planted


def setting(spark, width=16):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, width))
    y = x[:, [1, 5, 9, 12]] @ [2.0, -1.5, 1.0, 0.8] + 0.5 * rng.normal(size=500)
    g = grams.fold_grams(frame(spark, x, y), "x", F.col("y"), F.pmod("id", F.lit(3)), 3, width)
    return g, spark.range(10), dict(least=4, most=5)


def test_online_search_beats_the_baseline_and_resumes(spark):
    g, seeds, sizes = setting(spark)
    rel = stored(grams.scored_subsets(grams.drawn_subsets(seeds, "id", 16, 4, 5, 30), g), "relation")
    model, _ = surrogate.pretrain(rel, 16, epochs=15, batch=32, rate=0.01)
    options = dict(per=10, keep=20, **sizes)
    found, after = online.online_search(spark, seeds, "id", g, model, scratch(spark, "online"), 4, **options)
    rows = found.orderBy("round", "subset_id").collect()
    assert len(rows) == 80 and len({tuple(r.features) for r in rows}) == 80
    for r in rows[:10]:
        assert abs(r.score - g.scores_of([r.features])[0]) < 1e-12
    # the baseline gets as many real evaluations
    base = online.random_baseline(seeds, "id", g, per=8, salt=3, **sizes).first()
    assert base.n == 80 and max(r.score for r in rows) > base.score
    root = scratch(spark, "online")
    online.online_search(spark, seeds, "id", g, model, root, 2, **options)
    resumed, again = online.online_search(spark, seeds, "id", g, model, root, 4, **options)
    assert [(r.round, r.features) for r in resumed.orderBy("round", "subset_id").collect()] == [(r.round, r.features) for r in rows]
    assert again.step == after.step == model.step + 12
    assert all(np.allclose(again.weights[n], w, atol=1e-12) for n, w in after.weights.items())


def test_neighbours_differ_in_one_place(spark):
    best = spark.createDataFrame([(1, [0, 3, 5]), (2, [2]), (3, []), (4, list(range(8)))], "subset_id long, features array<int>")
    rows = online.varied(best, 8, 6, 11).collect()
    assert len(rows) == 12
    for r in rows:
        assert any(len(set(r.features) & set(b)) == len(b) - 1 and len(set(r.features)) == len(b) for b in ([0, 3, 5], [2]))


def test_masks_are_repaired_by_strength(spark):
    scores = spark.createDataFrame([(f"f{i}", (-1) ** i * i / 10) for i in range(10)], "feature string, r double")
    rows = online.masked_subsets(spark.range(30), "id", scores, "r", 5, 4, 6, per=4).collect()
    assert len(rows) == 120 and {len(r.features) for r in rows} == {4, 5, 6} and len({r.drawn for r in rows}) > 5
    for r in rows:
        assert abs(r.score - np.mean([int(f[1:]) / 10 for f in r.features])) < 1e-12
        if r.drawn == 0:
            assert r.features == ["f6", "f7", "f8", "f9"]
    assert {(tuple(r.features), r.score) for r in online.masked_subsets(spark.range(1), "id", scores.limit(0), "r", 5, 4, 6).collect()} == {((), 0.0)}


def test_process_equals_a_direct_solve():
    rng = np.random.default_rng(0)
    x, y, at = rng.random((7, 2)), rng.normal(size=7), rng.random((5, 2))
    p = tuning.Process(x, y, np.array([0.3, 0.6]), 1.5, 1e-3)
    k = lambda a, b: 1.5 * math.exp(-0.5 * (((a[0] - b[0]) / 0.3) ** 2 + ((a[1] - b[1]) / 0.6) ** 2))
    inverse = np.linalg.inv(np.array([[k(a, b) for b in x] for a in x]) + 1e-3 * np.eye(7))
    mean, variance = p.predict(at)
    for i, a in enumerate(at):
        c = np.array([k(a, b) for b in x])
        m, v = c @ inverse @ y, 1.5 - c @ inverse @ c
        assert abs(mean[i] - m) < 1e-8 and abs(variance[i] - v) < 1e-8
        draws = rng.normal(m, math.sqrt(v), 400_000)
        assert abs(p.improvement(at)[i] - np.maximum(draws - y.max() - 0.01, 0).mean()) < 5e-3
    none = tuning.Process(np.empty((0, 2)), np.empty(0), np.ones(2))
    assert none.improvement(at).tolist() == [1.0] * 5


def test_search_finds_the_peak_of_a_known_function():
    f = lambda s: -((s["a"] - 2) ** 2) - 3 * (s["b"] + 0.5) ** 2
    tried = tuning.tuned(f, {"a": (-5, 5), "b": (-1, 1)}, steps=25)
    assert len(tried) == 30 and max(v for _, v in tried) > -0.1
    assert tried == tuning.tuned(f, {"a": (-5, 5), "b": (-1, 1)}, steps=25)
    assert len(tuning.tuned(lambda s: 0.0, {"a": (0, 1)}, first=2, steps=20, patience=3)) == 5
