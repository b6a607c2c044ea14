"""Tree search: selection by hand, damped backup against a replay, resumed forests, planted subsets."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sparksieve.operators import grams
from sparksieve.plans import treesearch as ts
from test_surrogate import frame, planted


def tree(width=4, size=2, c=1.0, prior=None, loss=0.0):
    return ts.Tree(np.arange(width), size, c, np.zeros(width) if prior is None else np.array(prior, dtype=float), loss)


def visits_of(t, values, n, seed=0):
    """The leaves of n walks with immediate backup; values by the leaf's first feature."""
    rng, seen = random.Random(seed), []
    for _ in range(n):
        t.below, t.under_way = {}, {}
        t.open()
        leaf = t.walk(rng)[-1]
        seen.append(leaf)
        t.back_up(leaf, values[leaf[0]], 1.0)
    return seen


def test_zero_prior_is_ucb1():
    """Every choice is the one of the largest mean + c sqrt(ln N / n)."""
    values, t = [0.1, 0.9, 0.5], tree()
    seen = visits_of(t, values, 3)
    assert sorted(x[0] for x in seen) == [0, 1, 2]
    for k in range(3, 40):
        n = {i: sum(x[0] == i for x in seen) for i in range(3)}
        want = max(range(3), key=lambda i: values[i] + np.sqrt(np.log(k) / n[i]))
        seen += visits_of(t, values, 1, seed=k)
        assert seen[-1][0] == want


def test_flat_prior_changes_no_walk():
    a, b = (visits_of(tree(prior=p), [0.2, 0.3, 0.4], 30) for p in (None, [0.0] * 4))
    assert a == b


def test_sharp_prior_gives_the_order_worked_by_hand():
    """Size 1, equal rewards 0, no exploration: first by prior 8, 4, 2; then the largest prior / (1 + n)."""
    t = ts.Tree(np.arange(3), 1, 0.0, np.array([2.0, 8.0, 4.0]), 0.0)
    # after one visit each: 1, 4, 2 -> 1; then 1, 8/3, 2 -> 1; then 1, 2, 2 -> 1 (the first of equals); then 1, 8/5, 2 -> 2
    assert [x[0] for x in visits_of(t, [0.0] * 3, 7)] == [1, 2, 0, 1, 1, 1, 2]


def test_virtual_loss_spreads_a_batch():
    t = tree(width=3, size=1, c=0.1, loss=1.0)
    for i in range(3):
        t.add((i,), 1, 0.5 + 0.01 * i)
    t.add((), 3, 1.5)
    t.open()
    rng = random.Random(0)
    assert sorted(t.walk(rng)[-1][0] for _ in range(3)) == [0, 1, 2]
    calm = tree(width=3, size=1, c=0.0, loss=0.0)
    calm.nodes = {k: list(v) for k, v in t.nodes.items()}
    calm.open()
    # without a loss a visit under way counts as one of value 0 only
    assert calm.walk(rng)[-1] == (2,)


def replay(leaves, damping, least, threshold):
    """Totals, visits, flags by plain loops over the recorded rounds of (path, score)."""
    total, visits, delta = {}, {}, {}
    for round_ in leaves:
        delta = dict.fromkeys(total, 0.0)
        for path, score in round_:
            v = score
            for k in range(len(path), -1, -1):
                node = path[:k]
                n, s = visits.get(node, 0), total.get(node, 0.0)
                old = s / n if n else 0.0
                v = damping * v + (1 - damping) * old
                visits[node], total[node] = n + 1, s + v
                delta[node] = max(delta.get(node, 0.0), abs((s + v) / (n + 1) - old))
    return {n: (visits[n], total[n], visits[n] >= least and delta[n] < threshold) for n in total}


def test_damped_backup_and_flags_equal_a_replay_of_the_paths():
    rng, prior = np.random.default_rng(0), np.zeros(6)
    options = dict(size=3, c=1.0, share=1.0, loss=0.5, damping=0.8, least=5, threshold=0.05, prior=prior)
    state = pd.DataFrame([(7, "node", "", 0, 0.0, 0.0, False, 0, None, 0.0)], columns=["tree_id", "kind", "path", "visits", "total", "delta", "converged", "seq", "subset", "score"])
    played = []
    for k in range(8):
        out = ts.turn(state, k, 6 if k < 7 else 0, **options)
        out["score"] = [0.3 + 0.1 * rng.random() if kind == "leaf" else 0.0 for kind in out["kind"]]
        played.append([(ts.node_of(p), s) for kind, p, s in zip(out["kind"], out["path"], out["score"]) if kind == "leaf"])
        state = out.sample(frac=1, random_state=k)
    want = replay(played[:7], 0.8, 5, 0.05)
    nodes = state[state["kind"] == "node"]
    got = {ts.node_of(p): (v, t, f) for p, v, t, f in zip(nodes["path"], nodes["visits"], nodes["total"], nodes["converged"])}
    assert got.keys() == want.keys() and any(f for _, _, f in want.values())
    for n, (v, t, f) in want.items():
        assert got[n][0] == v and abs(got[n][1] - t) < 1e-12 and got[n][2] == f


def test_forest_finds_the_planted_subset_and_resumes(spark):
    x, y = planted(width=8)
    g = grams.fold_grams(frame(spark, x, y), "x", F.col("y"), F.pmod("id", F.lit(3)), 3, 8)
    seeds, names, order = spark.range(4).select(F.col("id").alias("tree_id")), [f"f{i}" for i in range(7, -1, -1)], list(range(7, -1, -1))
    options = dict(grams=g, order=order, batch=10, size=3, c=0.2, share=1.0, loss=0.1, damping=0.9)
    whole, _ = ts.grown(spark, seeds, rounds=9, **options)
    rows = ts.summary(whole, names).orderBy("tree_id").collect()
    assert all({"f1", "f4"} <= set(r.selected) and r.reward > 0.9 and r.nodes > 20 for r in rows)
    top = max(rows, key=lambda r: r.reward)
    assert sorted(top.selected) == ["f1", "f4", "f6"] and abs(top.reward - g.scores_of([[1, 4, 6]])[0]) < 1e-12
    key = lambda df: sorted(map(str, df.drop("score").collect()))
    part, _ = ts.grown(spark, seeds, rounds=2, finish=False, **options)
    more, _ = ts.grown(spark, seeds, rounds=7, start=part, done=2, **options)
    assert key(more) == key(whole)


def test_fewer_features_than_a_subset_has(spark):
    x = np.random.default_rng(1).normal(size=(50, 2))
    g = grams.fold_grams(frame(spark, x, x[:, 0]), "x", F.col("y"), F.pmod("id", F.lit(2)), 2, 2)
    state, _ = ts.grown(spark, spark.range(1).select(F.col("id").alias("tree_id")), g, [0, 1], rounds=2, batch=3, size=5, share=1.0)
    assert ts.summary(state, ["a", "b"]).first().reward > 0.99
