"""Planted structure, edge cases and small brute-force checks of the feature-selection operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sparksieve.functions import scalars as fn
from sparksieve.operators import clean, evaluation, information, selection, sets, stats, voting, windows
from sparksieve.operators.longform import feature_columns, from_wide, numeric_columns
from sparksieve.plans import search
from sparksieve.sources import catalog, tables


@pytest.fixture(scope="module")
def planted(spark):
    """200 rows: f1 drives y, f2 copies f1 with noise, f3 is noise, f4 is constant."""
    rng = random.Random(1)
    rows = []
    for i in range(200):
        a = rng.gauss(0, 1)
        rows.append((i, a, a + rng.gauss(0, 0.05), rng.gauss(0, 1), 5.0, "x" if a > 0 else "y"))
    return spark.createDataFrame(rows, "id long, f1 double, f2 double, f3 double, f4 double, c string")


@pytest.fixture(scope="module")
def long(planted):
    return from_wide(planted, "id", F.col("f1") > 0, ["f1", "f2", "f3", "f4"]).cache()


def test_long_form(planted, long):
    assert long.count() == 800 and numeric_columns(planted, ("id",)) == ["f1", "f2", "f3", "f4"]
    assert feature_columns(planted, ("id",), "c") == ["f1", "f2", "f3", "f4"]
    with pytest.raises(ValueError):
        feature_columns(planted, ("nope",))


def test_relevant_features_outrank_noise(long):
    s = {r.feature: r for r in selection.feature_scores(long).collect()}
    assert min(s["f1"].r, s["f2"].r) > 0.7 > 0.2 > s["f3"].r and s["f4"].r == 0 and s["f4"].mi == 0
    assert min(s["f1"].mi, s["f2"].mi) > 3 * s["f3"].mi
    kept = [r.feature for r in selection.stage1_filter(long, least=0.3, min_keep=1).orderBy("rank").collect()]
    assert set(kept) == {"f1", "f2"}


def test_redundancy(long):
    pairs = stats.correlation_pairs(long)
    assert {(r.f1, r.f2) for r in pairs.where("abs(r) > 0.9").collect()} == {("f1", "f2")}
    s = selection.feature_scores(long)
    left = {r.feature for r in selection.without_redundant(s, pairs.where("abs(r) > 0.9")).collect()}
    assert len(left & {"f1", "f2"}) == 1 and {"f3", "f4"} <= left
    greedy = {r.feature for r in selection.greedy_uncorrelated(selection.universal_score(s), pairs, 0.9).collect()}
    assert len(greedy & {"f1", "f2"}) == 1 and "f3" in greedy


def test_min_keep_fallback(long):
    s = stats.pearson(long).select("feature", F.abs("r").alias("score"))
    assert selection.threshold_or_best(s, 2.0, 3).count() == 3


def test_kendall_and_spearman_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "f", float(rng.randrange(6)), float(rng.randrange(3))) for i in range(60)]
    lf = spark.createDataFrame(rows, "sample_id long, feature string, value double, y double")
    s = sum((x > 0) - (x < 0) for i in range(60) for j in range(i) for x in [(rows[i][2] - rows[j][2]) * (rows[i][3] - rows[j][3])])
    assert stats.kendall(lf).first().tau == pytest.approx(s / (60 * 59 / 2))
    assert -1 <= stats.spearman(lf).first().rho <= 1


def test_mutual_information_of_xor(spark):
    rows = [(i, "f", float(i % 2), float(i % 2)) for i in range(100)] + [(i, "g", float(i // 2 % 2), float(i % 2)) for i in range(100)]
    lf = spark.createDataFrame(rows, "sample_id long, feature string, value double, y double")
    mi = {r.feature: r.mi for r in information.mutual_information(information.with_equal_width(lf)).collect()}
    assert mi["f"] == pytest.approx(math.log(2)) and mi["g"] == pytest.approx(0)


def test_imputation(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, None), (3, 3.0, "a"), (4, 8.0, "b")], "id long, x double, s string")
    got = {r.id: r for r in clean.impute(df, {"x": "median", "s": "mode"}).collect()}
    assert got[2].x == 3.0 and got[2].s == "a"
    assert clean.impute(df, {"x": "skip"}).count() == 3 and clean.impute(df, {"x": "zero"}).where("x = 0").count() == 1
    with pytest.raises(Exception, match="null in x"):
        clean.impute(df, {"x": "error"}).collect()
    with pytest.raises(ValueError):
        clean.impute(df, {"x": "guess"})
    assert clean.impute(df.limit(0), {"x": "mean"}).count() == 0


def test_fills_and_encodings(spark):
    df = spark.createDataFrame([(1, None, "b"), (2, 5, "a"), (3, None, None)], "id long, v int, c string").withColumn("g", F.lit(1))
    assert [r.v for r in clean.filled_forward(df, "v", "id", ["g"]).orderBy("id").collect()] == [None, 5, 5]
    assert [r.v for r in clean.filled_backward(df, "v", "id", ["g"]).orderBy("id").collect()] == [5, 5, None]
    assert {r.id: r.c_code for r in clean.label_encoded(df, "c").collect()} == {1: 1, 2: 0, 3: -1}
    assert clean.one_hot(df, "c").select("c_a", "c_b").orderBy("c_a", "c_b").collect()[0] == (0, 0)


def test_type_inference(spark):
    for values, kind in ((["1", "0"], "Int64"), (["1.5", "2"], "Float64"), (["true", "no"], "Bool"), (["2020-01-01"] * 9 + ["x"], "DateTime"), (["x", None], "String"), ([None], "String")):
        df = spark.createDataFrame([(v,) for v in values], "c string")
        assert clean.inferred_type(df, "c").first().kind == kind


def test_runs_and_smoothing(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 1, 9, 1, 1, 1])], "k int, i long, v double")
    assert [r.run for r in windows.runs(df, F.col("v") < 5, ["k"], ["i"]).orderBy("i").collect()] == [1, 2, 0, 1, 2, 3]
    s = [r.smooth for r in windows.smoothed(df, "v", ["k"], "i").orderBy("i").collect()]
    want = [1.0]
    for v in [1, 9, 1, 1, 1]:
        want.append(0.3 * v + 0.7 * want[-1])
    assert s == pytest.approx(want)


def test_sets_and_masks(spark):
    df = spark.createDataFrame([([1, 2], [2, 3]), ([], [])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(sets.jaccard(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / 3), 0.0]
    s = spark.createDataFrame([(1, [1, 2]), (2, [1, 2]), (3, [9])], "k int, f array<int>")
    r = sets.overlap_summary(s, "k", "f").first()
    assert (r.high, r.low) == (1.0, 0.0) and r["mean"] == pytest.approx(1 / 3)


def test_consensus_rejects_second_votes(spark):
    raw = spark.createDataFrame([(1, 42, 0.8, 5.0, 1), (2, 42, 0.7, 8.0, 2), (1, 100, 0.6, 3.0, 3), (2, 200, 0.9, 7.0, 4), (1, 42, 0.1, 1.0, 5)], "tree_id int, feature_id int, performance double, depth double, seq long")
    v = voting.cast_votes(raw)
    assert v.where("tree_id = 1 and feature_id = 42").first().performance == 0.8 and v.count() == 4
    scores = voting.consensus(v, voting.tree_weights(v, F.lit(0.5), F.lit(0)))
    assert scores.orderBy(F.desc("score")).first().feature_id == 42


def test_folds_cover_rows_once(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    sizes = {r.fold: r["count"] for r in evaluation.contiguous_folds(df, "k", 5).groupBy("fold").count().collect()}
    assert sizes == {0: 20, 1: 20, 2: 20, 3: 20, 4: 23}
    c = evaluation.stratified_folds(df, F.col("k") % 2, [F.col("k")], 5).withColumn("c", F.col("k") % 2)
    assert all(r.valid and r.smallest >= 10 for r in evaluation.fold_check(c, "c").collect())


def test_tails():
    assert evaluation.t_two_sided(2.776445, 4) == pytest.approx(0.05, abs=1e-6)
    assert evaluation.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert evaluation.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert evaluation.chi2_one(3.841459) == pytest.approx(0.05, abs=1e-6)


def test_corrections(spark):
    p = [0.001, 0.01, 0.02, 0.04, 0.06, 0.1, 0.5, 0.8]
    got = {r.p: r for r in evaluation.adjusted(spark.createDataFrame([(x,) for x in p], "p double")).collect()}
    assert got[0.001].bonferroni == pytest.approx(0.008) and got[0.01].holm == pytest.approx(0.07) and got[0.02].benjamini_hochberg == pytest.approx(0.16 / 3)
    assert got[0.8].benjamini_hochberg == pytest.approx(0.8)


def test_auc_bounds(spark):
    df = spark.createDataFrame([(i, i / 10) for i in range(10)], "i int, s double")
    assert evaluation.auc(evaluation.roc_curve(df, F.col("i") >= 5, F.col("s"))).first().auc == pytest.approx(1.0)
    assert evaluation.auc(evaluation.roc_curve(df, F.col("i") < 5, F.col("s"))).first().auc == pytest.approx(0.0)


def test_paired_tests_find_a_shift(spark):
    rng = random.Random(3)
    rows = [("m", rng.gauss(1, 1), rng.gauss(0, 1)) for _ in range(60)]
    df = spark.createDataFrame(rows, "m string, a double, b double")
    assert evaluation.paired_t(df, ["m"], "a", "b").first().p < 0.01
    assert evaluation.wilcoxon(df, ["m"], "a", "b").first().p < 0.01


def test_gramian_stands_missing_values(spark):
    rng = random.Random(4)
    rows = [(i, f, rng.gauss(0, 1) if rng.random() < 0.8 else None, 0.0) for i in range(80) for f in ("a", "b", "c")]
    got = {(r.f1, r.f2): r.r for r in stats.correlation_pairs(spark.createDataFrame(rows, "sample_id long, feature string, value double, y double").repartition(3)).collect()}
    value = {(i, f): v for i, f, v, _ in rows}
    for (x, y), r in got.items():
        both = [(value[i, x], value[i, y]) for i in range(80) if value[i, x] is not None and value[i, y] is not None]
        mx, my = (sum(p[k] for p in both) / len(both) for k in (0, 1))
        sxy, sxx, syy = sum((a - mx) * (b - my) for a, b in both), sum((a - mx) ** 2 for a, _ in both), sum((b - my) ** 2 for _, b in both)
        assert r == pytest.approx(sxy / math.sqrt(sxx * syy))
    assert len(got) == 3 and stats.correlation_pairs(spark.createDataFrame([], "sample_id long, feature string, value double, y double")).count() == 0


def test_positions_and_running_totals(spark):
    from sparksieve.operators.ordered import positioned, ranged, scanned

    rng = random.Random(6)
    rows = [(k, rng.randrange(1000), rng.randrange(9)) for k in (None, "a", "b") for _ in range(70)]
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(5)
    run = scanned(ranged(df, "k", "o", "v"), ["k"], ["o", "v"], {"up": (F.sum, F.col("v"), False), "down": (F.sum, F.col("v"), True), "top": (F.max, F.col("v"), False), "low": (F.min, F.col("v"), True)}).collect()
    for key in (None, "a", "b"):
        mine = sorted((r for r in run if r.k == key), key=lambda r: (r.o, r.v))
        values = [r.v for r in mine]
        # rows that are equal in order and value may stand either way
        assert [r.up for r in mine] == sorted(r.up for r in mine) and sorted(r.up for r in mine) == [sum(values[: i + 1]) for i in range(70)]
        assert sorted(r.down for r in mine) == sorted(sum(values[i:]) for i in range(70))
        assert [r.top for r in mine] == [max(values[: i + 1]) for i in range(70)] and [r.low for r in mine] == [min(values[i:]) for i in range(70)]
    assert sorted(r.position for r in positioned(df.where("k = 'a'"), ["k"], ["o"]).collect()) == list(range(1, 71))


def test_smoothing_starts_anew_after_a_gap(spark):
    df = spark.createDataFrame([(k, i, v) for k in (1, 2) for i, v in enumerate([4.0, 8.0, None, 2.0, 6.0])], "k int, i long, v double")
    got = [r.smooth for r in windows.smoothed(df, "v", ["k"], "i").where("k = 2").orderBy("i").collect()]
    assert got == pytest.approx([4.0, 5.2, 0.0, 2.0, 3.2])


def test_p_values_match_known_tables(spark):
    same = spark.createDataFrame([("m", 1.0, 1.0)] * 5, "m string, a double, b double")
    r = evaluation.paired_t(same, ["m"], "a", "b").first()
    assert (r.t, r.p) == (0.0, 1.0)
    one = evaluation.paired_t(same.withColumn("a", F.lit(2.0)), ["m"], "a", "b").first()
    assert one.t == float("inf") and one.p == 0.0
    df = spark.createDataFrame([("m", x, 0.0) for x in (1.0, 2.0, 3.0, 4.0, 5.0)], "m string, a double, b double")
    two = evaluation.paired_t(df, ["m"], "a", "b").first()
    assert two.t == pytest.approx(4.242641) and two.p == pytest.approx(0.013236, abs=1e-5)
    assert evaluation.paired_t(df, ["m"], "a", "b", "greater").first().p == pytest.approx(0.006618, abs=1e-5)
    assert evaluation.paired_t(df, ["m"], "a", "b", "less").first().p == pytest.approx(0.993382, abs=1e-5)
    m = evaluation.mcnemar(spark.createDataFrame([(True, False)] * 30 + [(False, True)] * 10, "a boolean, b boolean"), [], F.col("a"), F.col("b")).first()
    assert m.chi2 == pytest.approx(10.0) and m.p == pytest.approx(0.001565, abs=1e-5)


def test_importance_and_interactions_find_what_is_planted(spark):
    rng = random.Random(9)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1), i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, fold int")
    strong = {r.feature: r.importance for r in search.shapley_sampled(df, ["a", "b", "c"], F.col("a") + 0.3 * F.col("b") > 0, "id").collect()}
    assert strong["a"] > strong["b"] > strong["c"]
    steps = search.forward_selection(df, ["a", "b", "c"], {("a", "b"): 0.99}, F.col("a") > 0, "fold", 3).collect()
    assert [s.feature for s in steps] == ["a", "c"] and steps[0].kept and steps[0].accuracy > 0.9
    pairs = {(r.f1, r.f2): r for r in search.pair_interactions(df, ["a", "b", "c"], F.col("a") * F.col("b") > 0, grid=8).collect()}
    assert pairs["a", "b"].strength == max(p.strength for p in pairs.values()) and all(0 <= p.h <= 1 + 1e-9 for p in pairs.values())


def test_scalars(spark):
    df = spark.createDataFrame([(5, 12345.0, 3725, " ", "a_b&c", '["x","y"]')], "m int, n double, s int, t string, l string, j string")
    r = df.select(fn.mask_indices(F.col("m"), 4), fn.short_number(F.col("n")), fn.duration_text(F.col("s")), fn.optional_string(F.col("t")), fn.latex_escaped(F.col("l")), fn.json_strings(F.col("j")), fn.byte_text(F.lit(2048))).first()
    assert tuple(r) == ([1, 3], "12.3K", "1h 2m", None, r"a\_b\&c", ["x", "y"], "2.0 KB")


def test_specs_and_catalogue(spark, tmp_path):
    spec = tables.spec_from_config({"name": "d", "feature_tables": {"train_features": "tf"}, "tables": {"train": "t"}, "target_column": "y", "settings": {"folds": 7}}).with_preset("fast")
    assert spec.table == "tf" and spec.settings["folds"] == 7 and spec.settings["trees"] == 4
    assert tables.lookup({"a": {"b": 1}}, ["a", "c"], 9) == 9 and tables.chunk_size(500, 100_000, 8) == 100_000
    rows = catalog.config_rows("r", {"b": True, "i": 1, "f": 0.5, "s": "x", "n": None, "j": [1]}, spark)
    assert {r.key: r.kind for r in rows.collect()} == {"b": "bool", "i": "int", "f": "float", "s": "string", "n": "null", "j": "json"}
    catalog.append(rows, str(tmp_path), "ensemble_config")
    catalog.append(rows, str(tmp_path), "ensemble_config")
    assert catalog.load(spark, str(tmp_path), "ensemble_config").count() == 12


def test_search_finds_the_best_features(spark):
    scores = spark.createDataFrame([(f"f{i}", 0.9 if i < 3 else 0.05) for i in range(12)], "feature string, score double")
    t = search.forest(scores, spark.range(6).withColumnRenamed("id", "tree_id"), "score", iterations=300, size=3, share=1.0)
    best = t.orderBy(F.desc("reward")).first()
    assert best.selected == ["f0", "f1", "f2"]
    assert t.collect() == search.forest(scores, spark.range(6).withColumnRenamed("id", "tree_id"), "score", iterations=300, size=3, share=1.0).collect(), "trees are seeded"
    few = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "feature string, score double")
    assert search.candidates(few, 10, 2) == [["b"], ["a"], ["b", "a"]]


def test_models_predict_in_a_session_that_observes(spark, data):
    """An Observation puts an object into the session that can't go to tasks; fitted models must not take the session along."""
    from pyspark.sql import Observation

    from sparksieve.plans import search
    from sparksieve.plans.search_queries import NAMES, label, line_items

    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 3
    rows = line_items(spark, data)
    for kind in ("logistic", "forest", "boosted"):
        assert {r.feature for r in search.ablation_importance(rows, NAMES, label(), kind).collect()} == set(NAMES)


@pytest.mark.parametrize("block", [3, 256])
def test_vector_pairs_equal_plain_correlations(spark, monkeypatch, block):
    """Blocks of any size, nulls and NaN by pairs of places, a constant place, rows of another length, names in any order."""
    import numpy as np

    monkeypatch.setattr(stats, "PAIR_BLOCK", block)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 7)) + 100
    x[:, 3] += 5 * x[:, 1]
    x[:, 6] = 2.0
    x[rng.random((200, 7)) < 0.05] = np.nan
    rows = [(i, [None if np.isnan(v) and i % 2 else float(v) for v in r]) for i, r in enumerate(x)] + [(900, [1.0]), (901, None)]
    names = list("gfedcba")
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    got = {(r.f1, r.f2): r.r for r in stats.vector_pairs(df, "v", names).collect()}
    assert len(got) == 21
    for (a, b), r in got.items():
        p, q = x[:, names.index(a)], x[:, names.index(b)]
        both = ~np.isnan(p) & ~np.isnan(q)
        want = 0.0 if p[both].std() < 1e-9 or q[both].std() < 1e-9 else np.corrcoef(p[both], q[both])[0, 1]
        assert a < b and abs(r - want) < 1e-9
    assert {(r.f1, r.f2) for r in stats.vector_pairs(df, "v", names, 0.9).collect()} == {("d", "f")}
    assert stats.vector_pairs(df.limit(0), "v", names).count() == 0 and stats.vector_pairs(df, "v", []).count() == 0
