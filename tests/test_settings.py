"""Configs, metadata, batches, comparisons, thresholds, and selections against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparksieve.operators import evaluation as ev
from sparksieve.operators import selection as sel
from sparksieve.plans.settings_queries import written_text
from sparksieve.shared import scratch
from sparksieve.sources import tables


def test_presets_override_and_nested_values_are_found(spark):
    root = scratch(spark, "config")
    path = written_text(spark, f"{root}/a.json", '{"mode": "x", "s": {"a": 1, "b": [1, 2]}, "presets": {"x": {"s": {"a": 5}}}}')
    c = tables.read_config(spark, path)
    assert tables.lookup(c, ["s", "a"]) == 5 and tables.lookup(c, ["s", "b"]) == [1, 2] and tables.lookup(c, ["s", "z"], 7) == 7
    assert {r.key: r.value for r in tables.config_table(spark, c).collect()}["s.b"] == "[1, 2]"
    pytest.importorskip("yaml")
    assert tables.read_config(spark, written_text(spark, f"{root}/b.yaml", "a:\n  b: 1\n")) == {"a": {"b": 1}}
    with pytest.raises(ValueError):
        tables.read_config(spark, written_text(spark, f"{root}/c.yaml", "- 1\n"))


def test_metadata_is_searched_upwards(spark):
    root = scratch(spark, "folders")
    assert tables.find_metadata(spark, f"{root}/p/q/train.csv") is None
    written_text(spark, f"{root}/z_metadata.json", "{}")
    assert tables.find_metadata(spark, f"{root}/p/q/train.csv").endswith("/z_metadata.json")
    written_text(spark, f"{root}/p/q/metadata.json", "{}")
    assert tables.find_metadata(spark, f"{root}/p/q/train.csv").endswith("/p/q/metadata.json")


def test_faults_of_specs(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "id long, t string, x double")
    good = tables.DatasetSpec("d", "d", "t", ("id",))
    assert tables.spec_faults(good, df) == []
    bad = tables.DatasetSpec("d", "d", "t", ("id", "no"), ("x", "t"))
    assert len(tables.spec_faults(bad, df)) == 3 and tables.spec_faults(tables.DatasetSpec("d", "d", ""), df) == ["no target column is named"]


def test_batches_are_full_and_seeded(spark):
    df = spark.range(1000).repartition(7)
    for shuffled in (False, True):
        rows = tables.batches(df, "id", 64, shuffled, 5).collect()
        sizes = {b: sum(r.batch == b for r in rows) for b in {r.batch for r in rows}}
        assert len(rows) == 1000 and sizes == {b: 64 if b < 15 else 40 for b in range(16)}
        again = tables.batches(df, "id", 64, shuffled, 5).collect()
        assert {(r.id, r.batch) for r in rows} == {(r.id, r.batch) for r in again}
        assert all(r.batch == r.id // 64 for r in rows) != shuffled


def test_comparison_within_tolerance(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, v double")
    ok = tables.compared(a, a.withColumn("v", F.col("v") + 1e-6), ["k"], "v").first()
    assert ok.passed and ok["rows"] == 3 and ok.alone == 0 and abs(ok.max_abs - 1e-6) < 1e-12
    assert not tables.compared(a, a.where("k < 3"), ["k"], "v").first().passed
    assert not tables.compared(a, a.withColumn("v", F.col("v") * 1.01), ["k"], "v").first().passed
    assert tables.compared(a.withColumn("v", F.col("v") * 1e9), a.withColumn("v", F.col("v") * 1e9 + 1), ["k"], "v").first().passed


def test_thresholds_change_one_by_one():
    t = sel.Thresholds().updated(mi=0.5, target=None)
    assert t.mi == 0.5 and t.target == 500 and sel.Thresholds().mi == 0.01
    with pytest.raises(ValueError):
        t.updated(correlation=1.5)


def test_greedy_filter_and_adaptive_threshold_equal_plain_loops(spark):
    rng = np.random.default_rng(0)
    names, score = [f"f{i:02d}" for i in range(30)], np.round(rng.random(30), 2)
    r = {(a, b): float(np.round(rng.uniform(-1, 1), 3)) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.3}
    scores = spark.createDataFrame([(n, float(s)) for n, s in zip(names, score)], "feature string, score double")
    pairs = spark.createDataFrame([(a, b, v) for (a, b), v in r.items()], "f1 string, f2 string, r double")
    kept = []
    for n, _ in sorted(zip(names, score), key=lambda x: (-x[1], x[0])):
        if all(abs(r.get((min(n, k), max(n, k)), 0.0)) <= 0.6 for k in kept):
            kept.append(n)
    assert {x.feature for x in sel.greedy_uncorrelated(scores, pairs, 0.6).collect()} == set(kept) and 5 < len(kept) < 30
    t = sel.adaptive_threshold(scores.withColumnRenamed("score", "mi"), 12)
    passed = int((score >= t).sum())
    assert 0.01 <= t <= 1 and (abs(passed - 12) <= 1 or t in (1.0, 1e-4) or passed in (int((score >= t / 1.5).sum()), passed))


def test_resampling_equals_a_replay_of_its_draws(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(0.3, 1, 50), rng.normal(0, 1, 50)
    df = spark.createDataFrame([("g", i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "g string, id long, a double, b double")
    h = np.array([r.h for r in df.orderBy("id").select(F.xxhash64("id", F.lit(7)).alias("h")).collect()]).view(np.uint64)
    # sign flips: a hash's bits, a round a bit; round 0 is the observed one
    bits = np.unpackbits(ev._hashes(h, 4).view(np.uint8), axis=1)[:, 1:201].astype(float) * 2 - 1
    means = np.abs(((a - b)[:, None] * bits).mean(axis=0))
    want = (1 + (means >= abs((a - b).mean()) - 1e-12).sum()) / 201
    assert abs(ev.permutation_test(df, ["g"], "id", "a", "b", 200).first().p - want) < 1e-12
    # Poisson weights: the number of events of rate 1 that a uniform number gives
    u = (ev._hashes(h, 300) >> np.uint64(11)).astype(float) / 2.0**53
    weight, left, step = np.zeros_like(u), u.copy(), np.exp(-1)
    for k in range(1, 12):
        weight += left >= step
        left, step = left - step, step / k
    m = (a[:, None] * weight).sum(axis=0) / weight.sum(axis=0)
    got = ev.bootstrap(df, ["g"], "id", "a", 300).first()
    assert abs(got.ci_low - np.quantile(m, 0.025)) < 1e-9 and abs(got.ci_high - np.quantile(m, 0.975)) < 1e-9


def test_masks_inherit_and_are_checked(spark):
    from sparksieve.operators import sets

    schema = "mask_id int, feature_id int, selected boolean, rejected boolean, available boolean, locked boolean, priority double"
    t, f = True, False
    child = spark.createDataFrame([(1, 1, t, f, t, f, 4.0), (1, 2, t, f, t, f, 1.0), (1, 3, f, t, t, f, 1.0), (2, 9, t, t, f, t, 2.0)], schema)
    parent = spark.createDataFrame([(0, 1, f, t, t, t, 2.0), (0, 2, f, f, t, t, 3.0), (0, 3, f, f, f, f, 0.0)], schema)
    got = {(r.mask_id, r.feature_id): tuple(r)[2:] for r in sets.inherited(child, parent, 0.5).collect()}
    assert got == {(1, 1): (f, t, f, t, 2.5), (1, 2): (t, f, t, t, 1.25), (1, 3): (f, t, f, f, 0.5), (2, 9): (f, t, f, t, 2.0)}
    assert not any(r.locked for r in sets.inherited(child.where("mask_id = 1"), parent, 0.4).collect())
    faults = {r.mask_id: r.faults for r in sets.mask_faults(child, ["mask_id"], 4, 1).collect()}
    assert faults == {1: ["available and rejected", "too few available", "too many selected"], 2: ["selected and rejected", "selected but not available", "too few available", "locked and rejected"]}


def test_intervals_and_comparisons(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(1, 1, 12), rng.normal(0, 1, 12)
    df = spark.createDataFrame([("g", i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))] + [("one", 0, 1.0, 2.0)], "g string, id long, a double, b double")
    got = {r.g: r for r in ev.confidence_interval(df, ["g"], "id", "a").collect()}
    half = 2.200985160082949 * a.std(ddof=1) / np.sqrt(12)
    assert abs(got["g"].ci_low - a.mean() + half) < 1e-6 and abs(got["g"].ci_high - a.mean() - half) < 1e-6 and got["one"].ci_low is None
    boot = {r.g: r for r in ev.confidence_interval(df, ["g"], "id", "a", "bootstrap", 0.9, 4000).collect()}["g"]
    assert abs(boot.ci_low - a.mean() + 1.645 * a.std() / np.sqrt(12)) < 0.12 and boot.mean == got["g"].mean
    for test in ("paired_t", "wilcoxon"):
        r = ev.compared_models(df.where("g = 'g'"), ["g"], "a", "b", test, "holm").first()
        assert r.significant == (r.holm < 0.05) and r.holm == r.p
    with pytest.raises(ValueError):
        ev.compared_models(df, ["g"], "a", "b", "sign")
