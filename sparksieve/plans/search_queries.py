"""Queries of the subset search, model evaluation and importance; their results are seeded, not SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import sets, stats, voting
from ..operators import selection as sel
from ..operators.longform import from_wide
from ..registry import query, r6, table
from ..shared import stored
from . import models, search, treesearch
from .stage1_queries import features
from .surrogate_queries import embedding_grams


def scores(spark, d):
    return sel.universal_score(sel.feature_scores(features(spark, d))).select("feature", "score")


def grown(spark, d, prior=False, **options):
    """A tree for each supplier over the embeddings' places in the order of their scores, of the reference's 1,000 walks."""
    ranked = [(r["feature"], float(r["score"])) for r in scores(spark, d).orderBy(F.desc("score"), "feature").collect()]
    top = max((s for _, s in ranked), default=0.0) or 1.0
    seeds = search.seeds_of(spark, table(spark, d, "supplier"), "s_suppkey")
    weights = [max(s, 0.0) / top for _, s in ranked] if prior else None
    forest = treesearch.searched(spark, seeds, embedding_grams(spark, d), [int(f[1:]) - 1 for f, _ in ranked], [f for f, _ in ranked], rounds=20, batch=50, prior=weights, **options)
    # a row a tree; what reads it twice must not search twice
    return stored(forest, "forest")


def trees(spark, d):
    return grown(spark, d).drop("converged")


@query()
def ucb_forest(spark, d):
    return r6("reward", of=trees(spark, d))


@query()
def prior_forest(spark, d):
    """Walks that favour features by their scores, damped backup, and the share of nodes whose value has settled."""
    return r6("reward", "converged", of=grown(spark, d, prior=True, c=0.5, damping=0.9, loss=0.5))


@query()
def forest_consensus(spark, d):
    t = trees(spark, d)
    votes = t.select("tree_id", F.explode("selected").alias("feature_id"))
    return r6("frequency", of=voting.stability(votes, "tree_id", "feature_id", 0.5))


@query()
def forest_best_set(spark, d):
    t = trees(spark, d)
    return r6("reward", of=t.orderBy(F.desc("reward"), "tree_id").limit(5)).select("tree_id", "reward", sets.merged(F.col("selected"), F.array().cast("array<string>"), "union").alias("selected"))


def line_items(spark, d):
    """All line items, with an id and a fold by hash."""
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.pmod(F.xxhash64("l_orderkey"), F.lit(3)).cast("int").alias("fold"))



def label():
    return F.col("l_extendedprice") / F.col("l_quantity") > 1400


NAMES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query()
def cross_validated_models(spark, d):
    grid = search.cross_validated(line_items(spark, d), [["l_quantity", "l_extendedprice"], ["l_discount", "l_tax"]], ["logistic", "forest"], label(), "fold", 3)
    return r6("mean", "std", of=grid.groupBy("subset", "model").agg(F.avg("accuracy").alias("mean"), F.stddev_samp("accuracy").alias("std")))


@query()
def permutation_importance(spark, d):
    return r6("importance", "half_width", of=search.permutation_importance(line_items(spark, d), NAMES, label(), "id"))


@query()
def ablation_importance(spark, d):
    return r6("importance", of=search.ablation_importance(line_items(spark, d), NAMES, label()))


@query()
def pair_interactions(spark, d):
    return r6("strength", "h", of=search.pair_interactions(line_items(spark, d), NAMES, label()))


@query()
def additivity_gaps(spark, d):
    return r6("strength", of=search.additivity_gaps(line_items(spark, d), NAMES, label(), "id"))


@query()
def joint_degradation(spark, d):
    return r6("interaction", of=search.joint_degradation(line_items(spark, d), NAMES, label(), "id"))


@query()
def combined_interactions(spark, d):
    li = line_items(spark, d)
    return r6("score", of=search.combined_interactions([(search.pair_interactions(li, NAMES, label()), "h"), (search.joint_degradation(li, NAMES, label(), "id"), "interaction")]))


@query()
def shapley_importance(spark, d):
    return r6("importance", of=search.shapley_sampled(line_items(spark, d), NAMES, label(), "id"))


@query()
def forward_selection(spark, d):
    """Features in the order of |r|; the net price is all but a copy of the price, and the constraint keeps one of them."""
    li = line_items(spark, d).withColumn("l_net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    names = [*NAMES, "l_net"]
    lf = from_wide(li, "id", label(), names)
    ranked = [r["feature"] for r in stats.pearson(lf).orderBy(F.desc(F.abs("r")), "feature").collect()]
    pairs = {(r["f1"], r["f2"]): r["r"] for r in stats.correlation_pairs(lf, 0.5).collect()}  # a row a pair of columns
    return r6("accuracy", of=search.forward_selection(li, ranked, pairs, label(), "fold", 3))


def prices(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice", F.pmod(F.xxhash64("l_orderkey"), F.lit(4)).alias("fold"))


@query()
def stored_model_predictions(spark, d):
    """A forest and a linear model, saved, loaded and asked: by fold, how sure they are and how often the interval holds."""
    li = prices(spark, d)
    names = ["l_quantity", "l_discount", "l_tax"]
    flag = models.round_trip(models.fit(models.ModelConfig("forest", params={"numTrees": 5}), li.where("fold > 0"), names, F.col("l_quantity") > 25), spark).predict(li)
    sure = flag.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"), F.avg((F.col("prediction") == (F.col("l_quantity") > 25).cast("double")).cast("double")).alias("accuracy"))
    price = models.round_trip(models.fit(models.ModelConfig("linear", "regression"), li.where("fold > 0"), names, F.col("l_extendedprice")), spark).predict(li)
    held = price.groupBy("fold").agg(F.avg(F.col("l_extendedprice").between(F.col("low"), F.col("high")).cast("double")).alias("covered"))
    return r6("confidence", "accuracy", "covered", of=sure.join(held, "fold"))


@query()
def model_ensembles(spark, d):
    """Soft and hard votes of three kinds of models, each of other columns: accuracy by fold."""
    li = prices(spark, d)
    y = F.col("l_extendedprice") * (1 - F.col("l_discount")) > 35_000
    of = [("forest", ["l_extendedprice"]), ("boosted", ["l_extendedprice", "l_discount"]), ("linear", ["l_extendedprice", "l_quantity"])]
    fitted = [models.fit(models.ModelConfig(k), li.where("fold > 0"), names, y) for k, names in of]
    out = None
    for voting_rule in ("soft", "hard"):
        e = models.ensemble(fitted, li, voting_rule, [1.0, 2.0, 1.0])
        one = e.groupBy("fold").agg(F.avg((F.col("prediction") == y.cast("double")).cast("double")).alias(voting_rule))
        out = one if out is None else out.join(one, "fold")
    return r6("soft", "hard", of=out)


@query()
def boosted_and_regression_models(spark, d):
    li = line_items(spark, d)
    boosted = search.cross_validated(li, [["l_quantity", "l_extendedprice"]], ["boosted"], label(), "fold", 3).agg(F.avg("accuracy").alias("score")).select(F.lit("boosted").alias("model"), "score")
    data = search.assembled(li, ["l_quantity", "l_discount", "l_tax"], F.col("l_extendedprice")).select("features", "label", "fold")
    for kind in ("linear", "forest_regressor", "boosted_regressor"):
        p = search.fitted_on(search.model(kind), data.where("fold <> 0")).transform(data.where("fold = 0"))
        boosted = boosted.union(p.agg(*ev.regression_metrics(F.col("label"), F.col("prediction"))).select(F.lit(kind), "r2"))
    return r6("score", of=boosted)
