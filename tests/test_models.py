"""Model settings, saved models, ensembles, permuted columns and what is measured by them, against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparksieve.operators import sets, voting
from sparksieve.plans import models, search


def rows(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int)
    return spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, y int").repartition(3)


def test_settings_are_checked():
    assert models.ModelConfig("boosted").updated(maxDepth=2).params == {"maxDepth": 2}
    for bad in (lambda: models.ModelConfig("svm"), lambda: models.ModelConfig("forest", params={"numTrees": 0}), lambda: models.ModelConfig("boosted").updated(stepSize=1.5), lambda: models.ModelConfig("linear", "ranking")):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("kind, task", [(k, t) for k in models.KINDS for t in models.KINDS[k]])
def test_a_loaded_model_predicts_the_same(spark, kind, task):
    df = rows(spark)
    f = models.fit(models.ModelConfig(kind, task, {"maxDepth": 3} if kind != "linear" else {"maxIter": 5}), df, ["a", "b", "c"], F.col("y"))
    g = models.round_trip(f, spark)
    assert g.config == f.config and g.names == f.names and g.spread == f.spread and g.importances() == f.importances()
    got = g.predict(df).orderBy("id").collect()
    assert got == f.predict(df).orderBy("id").collect() and len(got) == 400
    if task == "classification":
        assert all(r.confidence == max(r.proba) and r.prediction == np.argmax(r.proba) for r in got)
    else:
        spread = np.sqrt(np.mean([(r.y - r.prediction) ** 2 for r in got]))
        assert all(abs(r.high - r.prediction - 1.959964 * spread) < 1e-5 and abs(r.low + r.high - 2 * r.prediction) < 1e-9 for r in got)
    with pytest.raises(ValueError):
        models.ModelConfig(kind, task, {"wings": 2}).estimator()


def test_ensembles(spark):
    df = rows(spark)
    fitted = [models.fit(models.ModelConfig("linear"), df, [n], F.col("y")) for n in ("a", "b", "c")]
    parts = [{r.id: r for r in f.predict(df).collect()} for f in fitted]
    w = [1.0, 2.5, 1.0]
    soft = {r.id: r.prediction for r in models.ensemble(fitted, df, "soft", w).collect()}
    hard = {r.id: r.prediction for r in models.ensemble(fitted, df, "hard", w).collect()}
    for i in soft:
        p = [sum(x * part[i].proba[c] for x, part in zip(w, parts)) for c in (0, 1)]
        v = [sum(x for x, part in zip(w, parts) if part[i].prediction == c) for c in (0, 1)]
        assert soft[i] == np.argmax(p) and hard[i] == np.argmax(v)
    two = [models.fit(models.ModelConfig("linear", "regression"), df, [n], F.col("y")) for n in ("a", "b")]
    got = {r.id: r.prediction for r in models.ensemble(two, df, weights=[3.0, 1.0]).collect()}
    one = [{r.id: r.prediction for r in f.predict(df).collect()} for f in two]
    assert all(abs(got[i] - (3 * one[0][i] + one[1][i]) / 4) < 1e-9 for i in got)
    with pytest.raises(ValueError):
        models.ensemble([*two, fitted[0]], df)


def test_votes_of_predictions(spark):
    data = [(1, 0, 0.2, 5.0), (1, 1, 0.9, 1.0), (1, 1, 0.8, 1.0), (2, 0, 0.1, 1.0), (2, 1, 0.7, 1.0)]
    df = spark.createDataFrame(data, "sample_id int, label int, proba double, weight double")
    assert {r.sample_id: r.vote for r in voting.voted(df, "hard").collect()} == {1: 1, 2: 0}
    assert {r.sample_id: r.vote for r in voting.voted(df, "weighted_hard").collect()} == {1: 0, 2: 0}
    mean = {r.sample_id: r.prediction for r in voting.weighted_mean(df, value="proba").collect()}
    assert abs(mean[1] - 2.7 / 7) < 1e-12 and abs(mean[2] - 0.4) < 1e-12


def test_permuted_columns_keep_their_values(spark):
    df = rows(spark, 300)
    got = search.permuted(df, ["a", "b"], "id", rounds=2, rows=100).toPandas()
    assert len(got) == 300 and set(got["id"]) == set(range(300))
    want = df.toPandas().set_index("id").loc[got["id"]].reset_index()
    for c in ("a", "b", "c", "y"):
        assert (got[c] == want[c]).all()
    for c in ("a#0", "b#0", "a#1", "b#1"):
        assert sorted(got[c]) == sorted(got[c[0]]) and (got[c] != got[c[0]]).mean() > 0.9
    assert (got["a#0"] != got["a#1"]).mean() > 0.9
    # columns move on their own
    joint = {(x, y) for x, y in zip(got["a"], got["b"])}
    assert np.mean([(x, y) in joint for x, y in zip(got["a#0"], got["b#0"])]) < 0.1


def test_importance_and_gaps_equal_plain_computations(spark, monkeypatch):
    df, names = rows(spark, 500), ["a", "b", "c"]
    held = {}
    keep = search._fitted_and_permuted
    monkeypatch.setattr(search, "_fitted_and_permuted", lambda *a: held.setdefault(a[-1], keep(*a)))
    importance = {r.feature: r for r in search.permutation_importance(df, names, F.col("y"), "id", "forest", 2).collect()}
    gaps = {(r.f1, r.f2): r.strength for r in search.additivity_gaps(df, names, F.col("y"), "id").collect()}
    joint = {(r.f1, r.f2): r.interaction for r in search.joint_degradation(df, names, F.col("y"), "id", "forest").collect()}

    def p(rounds, **change):
        fitted, mixed = held[rounds]
        one = mixed.select("id", "label", *[F.col(f"`{change.get(n, n)}`").alias(n) for n in names])
        return search.predicted(fitted, one).select("id", "label", "p").orderBy("id").toPandas()

    accuracy = lambda t: ((t["p"] >= 0.5) == t["label"]).mean()
    base = p(2)
    for f in names:
        lost = [accuracy(base) - accuracy(p(2, **{f: f"{f}#{r}"})) for r in (0, 1)]
        assert abs(importance[f].importance - np.mean(lost)) < 1e-9
        assert abs(importance[f].half_width - 1.96 * np.std(lost, ddof=1) / np.sqrt(2)) < 1e-9
    whole = p(1)
    for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
        one, two, both = p(1, **{a: f"{a}#0"}), p(1, **{b: f"{b}#0"}), p(1, **{a: f"{a}#0", b: f"{b}#0"})
        assert abs(gaps[a, b] - np.abs(both["p"] - (one["p"] + two["p"] - whole["p"])).mean()) < 1e-9
        lost = [accuracy(whole) - accuracy(t) for t in (both, one, two)]
        assert abs(joint[a, b] - (lost[0] - lost[1] - lost[2])) < 1e-9
    assert gaps["b", "c"] > gaps["a", "b"]


def test_shapley_values_equal_the_orders_gains(spark, monkeypatch):
    df, names = rows(spark, 120), ["a", "b", "c"]
    held = {}
    keep = search.fitted_on
    monkeypatch.setattr(search, "fitted_on", lambda *a: held.setdefault("model", keep(*a)))
    got = {r.feature: r.importance for r in search.shapley_sampled(df, names, F.col("y"), "id", 3, "forest", 5).collect()}
    means = df.toPandas()[names].mean()

    def p(own):
        one = df.select("id", *[F.col(n) if n in own else F.lit(float(means[n])).alias(n) for n in names])
        return search.predicted(held["model"], one).orderBy("id").toPandas()["p"].to_numpy()

    phi = {n: np.zeros(120) for n in names}
    for order in search.sampled_orders(names, 3, 5):
        for k, n in enumerate(order):
            phi[n] += (p(order[: k + 1]) - p(order[:k])) / 3
    assert all(abs(got[n] - np.abs(phi[n]).mean()) < 1e-9 for n in names)
    # the values of a row add up to what it gains over the means
    assert np.allclose(sum(phi.values()), p(names) - p([]))


def test_forward_selection_keeps_one_of_two_copies(spark):
    df = rows(spark).withColumns({"d": F.col("a") * 2 + 1, "fold": F.pmod("id", F.lit(2)).cast("int")})
    pairs = {("a", "d"): 1.0}
    got = [r.feature for r in search.forward_selection(df, ["a", "d", "b", "c"], pairs, F.col("y"), "fold", 2).collect()]
    assert got == ["a", "b", "c"]
    assert "d" in [r.feature for r in search.forward_selection(df, ["a", "d", "b", "c"], {}, F.col("y"), "fold", 2).collect()]


def test_overlap_of_repeated_sets(spark):
    rng = np.random.default_rng(0)
    known = [sorted(rng.choice(6, size=rng.integers(0, 4), replace=False).tolist()) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(known)), "k long, f array<long>")
    jac = [len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0.0 for i, a in enumerate(known) for b in known[i + 1 :]]
    got = sets.overlap_summary(df, "k", "f").first()
    assert abs(got["mean"] - np.mean(jac)) < 1e-9 and got.high == max(jac) and got.low == min(jac)
    assert tuple(sets.overlap_summary(df.limit(0), "k", "f").first()) == (0.0, 0.0, 0.0)
