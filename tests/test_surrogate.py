"""Subset scores against models of the rows themselves; the surrogate's gradient, epochs, stopping and accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparksieve.operators import grams
from sparksieve.plans import surrogate
from sparksieve.shared import scratch, stored


def planted(n=600, width=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) + 3
    return x, 2 * x[:, 1] - x[:, 4] + 0.5 * x[:, 6] + 0.3 * rng.normal(size=n)


def frame(spark, x, y):
    return spark.createDataFrame([(i, r.tolist(), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, x array<double>, y double").repartition(3)


def alone(x, y, subset, folds=3):
    """Mean held-out R^2 of least squares on the rows themselves."""
    out = []
    for k in range(folds):
        own = np.arange(len(y)) % folds == k
        a = np.c_[np.ones(len(y)), x[:, subset]]
        w = np.linalg.lstsq(a[~own], y[~own], rcond=None)[0]
        out.append(1 - ((y[own] - a[own] @ w) ** 2).sum() / ((y[own] - y[own].mean()) ** 2).sum())
    return np.mean(np.maximum(out, -1)) if subset else 0.0


def test_subset_scores_equal_each_subset_alone(spark):
    x, y = planted()
    x[:, 7] = x[:, 1]  # a copy
    hard = frame(spark, x, y).unionByName(spark.createDataFrame([(1, None, 1.0), (2, [1.0], 1.0), (3, [None] * 8, 2.0), (4, [float("nan")] * 8, 1.0), (5, [1.0] * 8, None)], "id long, x array<double>, y double"))
    g = grams.fold_grams(hard, "x", F.col("y"), F.pmod("id", F.lit(3)), 3, 8)
    subsets = [[1], [4, 6], [0, 1, 2, 3], [1, 4, 6], list(range(7)), [], [1, 7]]
    df = spark.createDataFrame([(i, s, "e") for i, s in enumerate(subsets)], "id int, features array<int>, score string")
    got = {r.id: r.score for r in grams.scored_subsets(df, g).collect()}
    for i, s in enumerate(subsets):
        assert abs(got[i] - alone(x, y, s)) < 1e-6, (s, got[i])


def test_empty_rows_score_nothing(spark):
    g = grams.fold_grams(frame(spark, *planted(5)).limit(0), "x", F.col("y"), F.lit(0), 2, 8)
    assert g.scores_of([[1, 2], []]).tolist() == [0.0, 0.0]


def small():
    return surrogate.new_surrogate(5, hidden=4, heads=2, decoder=3, seed=1)


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(0)
    masks, target = np.array([[1, 0, 1, 1, 0], [0, 0, 0, 0, 0], [1, 1, 1, 1, 1], [0, 1, 0, 0, 0.0]]), rng.normal(size=4)
    model = small()
    for w in model.weights.values():
        w += rng.normal(size=w.shape) * 0.3
    _, g = surrogate.gradient(model.weights, 2, masks, target)
    for name, w in model.weights.items():
        for at in np.ndindex(w.shape):
            old, d = w[at], 1e-6
            losses = []
            for x in (old + d, old - d):
                w[at] = x
                losses.append(surrogate.gradient(model.weights, 2, masks, target)[0])
            w[at] = old
            assert abs((losses[0] - losses[1]) / (2 * d) - g[name][at]) < 1e-6, name


def plain_adam(w, g, rate):
    """The first Adam step: moments from zero."""
    return w - rate * (0.1 * g / 0.1) / (np.sqrt(0.001 * g * g / 0.001) + 1e-8)


def rows_of(spark, n=40):
    rng = np.random.default_rng(2)
    subsets = [sorted(rng.choice(5, size=1 + i % 4, replace=False).tolist()) for i in range(n)]
    return subsets, rng.normal(size=n), lambda s, y: spark.createDataFrame([(i, a, float(b)) for i, (a, b) in enumerate(zip(s, y))], "subset_id long, features array<int>, score double")


def test_one_epoch_of_one_batch_is_one_step_over_all_rows(spark):
    subsets, y, make = rows_of(spark)
    rel = stored(make(subsets, y), "rows")
    model, masks = small(), surrogate.masks_of(subsets, 5)
    _, g = surrogate.gradient(model.weights, 2, masks, y)
    shaped = rel.select(F.lit(0).alias("part"), F.lit(0).alias("shard"), F.col("subset_id").alias("id"), "features", "score").repartition(4)
    for after in (surrogate.epoch(shaped, model, 0.01, 1000, 0)[0], surrogate.updated(model, rel.repartition(4), 0.01)):
        assert after.step == 1
        for name, w in model.weights.items():
            assert np.allclose(after.weights[name], plain_adam(w, g[name], 0.01), atol=1e-7), name


def test_shards_are_averaged_by_their_rows(spark):
    subsets, y, make = rows_of(spark)
    model = small()
    shaped = make(subsets, y).select(F.lit(0).alias("part"), (F.col("subset_id") < 30).cast("int").alias("shard"), F.col("subset_id").alias("id"), "features", "score")
    after, _ = surrogate.epoch(shaped, model, 0.01, 1000, 0)
    masks = surrogate.masks_of(subsets, 5)
    sides = [surrogate.adam(model, surrogate.gradient(model.weights, 2, masks[k], y[k])[1], 0.01) for k in (slice(0, 30), slice(30, 40))]
    for name in model.weights:
        assert np.allclose(after.weights[name], 0.75 * sides[0].weights[name] + 0.25 * sides[1].weights[name], atol=1e-9)


def test_surrogate_learns_scores_of_subsets_it_has_not_seen(spark):
    x, y = planted()
    g = grams.fold_grams(frame(spark, x, y), "x", F.col("y"), F.pmod("id", F.lit(3)), 3, 8)
    seeds = spark.range(60)
    rel = stored(grams.scored_subsets(grams.drawn_subsets(seeds, "id", 8, 1, 5, 10), g), "relation")
    model, losses = surrogate.pretrain(rel, 8, batch=64, rate=0.01)
    assert min(losses) < 0.2 * losses[0] and len(losses) <= 50
    fresh = grams.scored_subsets(grams.drawn_subsets(seeds, "id", 8, 1, 5, 3, salt=77_777), g)
    got = surrogate.accuracy(surrogate.predicted_scores(fresh, model)).first()
    assert got.correlation > 0.9 and got.fit and got.n == 180
    path = scratch(spark, "surrogate")
    surrogate.save(model, spark, path)
    back = surrogate.load(spark, path)
    assert back.step == model.step and all((back.weights[n] == w).all() for n, w in model.weights.items())
    assert (back.predict(np.eye(8)) == model.predict(np.eye(8))).all()


def test_training_stops_when_validation_does_not_improve(spark):
    subsets, y, make = rows_of(spark, 200)
    model, losses = surrogate.pretrain(stored(make(subsets, y), "noise"), 5, rate=0.05, batch=32, patience=2, validation=0.3)
    best = int(np.argmin(losses))
    assert len(losses) == best + 3 < 50
    again, _ = surrogate.pretrain(stored(make(subsets, y), "noise"), 5, rate=0.05, batch=32, patience=2, validation=0.3)
    assert all(np.allclose(again.weights[n], w, atol=1e-9) for n, w in model.weights.items())


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "subset_id long, features array<int>, score double")
    model, losses = surrogate.pretrain(none, 5, epochs=2)
    assert surrogate.updated(model, none) is model and np.isfinite(model.predict(np.eye(5))).all()


def test_heads_must_divide_the_hidden_places():
    with pytest.raises(ValueError):
        surrogate.new_surrogate(4, hidden=10, heads=4)
