"""Queries of the learned surrogate: subsets drawn by hash for each supplier, scored out of sums of products of the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, grams, stats
from ..registry import query, r6, table
from ..shared import scratch, stored
from . import online, search, surrogate, tuning
from .stage1_queries import CORR, LF, features

WIDTH, FOLDS, LEAST, MOST = 64, 3, 4, 12


def embedding_grams(spark, d):
    return grams.fold_grams(table(spark, d, "embeddings"), "embedding", F.col("label") < 5, F.pmod("vec_id", F.lit(FOLDS)), FOLDS, WIDTH)


def subsets(spark, d, per=20, seeds="supplier", key="s_suppkey", salt=0):
    return grams.drawn_subsets(table(spark, d, seeds), key, WIDTH, LEAST, MOST, per, salt)


def relation(spark, d):
    """(subset_id, features, score): the surrogate's training relation, written."""
    return stored(grams.scored_subsets(subsets(spark, d), embedding_grams(spark, d)), "relation")


def mixed(a, b):
    """SQL of grams.mixed_uniform."""
    k = f"(({a}) * 1009 + ({b})) % 1000003"
    k = f"(({k}) * ({k}) + 12345 * ({k})) % 1000003"
    return f"((({k}) * ({k}) + 7 * ({b}) + ({a})) % 1000003 + 0.5) / 1000003"


@query(f"""WITH s AS (SELECT s_suppkey * 20 + i AS subset_id, (s_suppkey * 20 + i) % 1000003 AS base FROM supplier, range(20) t(i)),
k AS (SELECT subset_id, f, {LEAST} + floor({mixed("base", WIDTH)} * {MOST - LEAST + 1}) AS size, row_number() OVER (PARTITION BY subset_id ORDER BY {mixed("base", "f")}, f) AS r FROM s, range({WIDTH}) g(f))
SELECT subset_id, list_sort(list(f::INT)) AS features FROM k WHERE r <= size GROUP BY 1""")
def subset_draws(spark, d):
    return subsets(spark, d)


@query(f"""WITH {LF}, z AS (SELECT feature, sample_id % {FOLDS} AS k, value, y FROM lf), f AS (SELECT DISTINCT k FROM z),
m AS (SELECT feature, f.k, regr_slope(y, value) AS b, regr_intercept(y, value) AS a FROM z JOIN f ON z.k <> f.k GROUP BY ALL),
s AS (SELECT z.feature, z.k, 1 - sum((y - a - b * value) * (y - a - b * value)) / (var_pop(y) * count(*)) AS r2 FROM z JOIN m ON m.feature = z.feature AND m.k = z.k GROUP BY ALL)
SELECT feature, round(avg(greatest(r2, -1)), 6) AS score FROM s GROUP BY 1""")
def single_feature_scores(spark, d):
    """The scores of all subsets of one feature, which SQL can say too."""
    one = spark.range(WIDTH).select(F.concat(F.lit("e"), F.lpad((F.col("id") + 1).cast("string"), 2, "0")).alias("feature"), F.array(F.col("id").cast("int")).alias("features"))
    return r6("score", of=grams.scored_subsets(one, embedding_grams(spark, d)).drop("features"))


@query()
def surrogate_relation(spark, d):
    return r6("score", of=relation(spark, d))


@query()
def surrogate_training(spark, d):
    """Validation loss of every epoch, up to the early stop."""
    _, losses = surrogate.pretrain(relation(spark, d), WIDTH)
    return r6("loss", of=spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(losses)], "epoch int, loss double"))


@query()
def surrogate_accuracy(spark, d):
    """The trained surrogate against real scores of subsets that it has not seen, those of the customers' keys."""
    model, _ = surrogate.pretrain(relation(spark, d), WIDTH)
    fresh = grams.scored_subsets(subsets(spark, d, 2, "customer", "c_custkey", 500_009), embedding_grams(spark, d))
    return r6("correlation", "mae", of=surrogate.accuracy(surrogate.predicted_scores(fresh, model)))


@query()
def online_learning_search(spark, d):
    """Five rounds after a short training: each round's best real score, and how well it was foretold."""
    model, _ = surrogate.pretrain(relation(spark, d), WIDTH, epochs=10)
    found, _ = online.online_search(spark, table(spark, d, "supplier"), "s_suppkey", embedding_grams(spark, d), model, scratch(spark, "online"), 5, least=LEAST, most=MOST)
    per = found.groupBy("round").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"), F.avg(F.abs(F.col("predicted") - F.col("score"))).alias("mae"))
    return r6("best", "mae", of=per)


@query()
def random_search(spark, d):
    return r6("score", of=online.random_baseline(table(spark, d, "supplier"), "s_suppkey", embedding_grams(spark, d), least=LEAST, most=MOST))


_MASKS = f"""WITH {LF}, {CORR}, f AS (SELECT feature, r, row_number() OVER (ORDER BY feature) - 1 AS place, count(*) OVER () AS n FROM r),
m AS (SELECT s_suppkey * 20 + i AS mask_id, (s_suppkey * 20 + i) % 1000003 AS base FROM supplier, range(20) t(i)),
c AS (SELECT mask_id, feature, r, {mixed("base", "place")} < 10 / n AS drawn FROM m, f),
k AS (SELECT *, row_number() OVER (PARTITION BY mask_id ORDER BY drawn DESC, r DESC, feature) AS rank, count(*) FILTER (WHERE drawn) OVER (PARTITION BY mask_id) AS d FROM c)"""
_REPAIRED = "SELECT mask_id, d AS drawn, list_sort(list(feature)) AS features, round(avg(r), 6) AS score FROM k WHERE rank <= greatest(8, least(12, d)) GROUP BY ALL"


def repaired_masks(spark, d):
    """20 Bernoulli masks for each supplier, of 10 features on average, repaired to 8 to 12."""
    return r6("score", of=online.masked_subsets(table(spark, d, "supplier"), "s_suppkey", stats.pearson(features(spark, d)), "r", 10, 8, 12))


@query(f"{_MASKS} {_REPAIRED}")
def mask_search(spark, d):
    return repaired_masks(spark, d)


@query(f"{_MASKS}, m2 AS ({_REPAIRED}) SELECT mask_id // 20 AS tree_id, mask_id, features, score FROM m2 QUALIFY row_number() OVER (PARTITION BY mask_id // 20 ORDER BY score DESC, mask_id) = 1")
def best_masks(spark, d):
    """A tree for each supplier: the best of its masks."""
    best = F.max(F.struct("score", (-F.col("mask_id")).alias("id"), "features")).alias("b")
    per = repaired_masks(spark, d).groupBy(F.floor(F.col("mask_id") / 20).alias("tree_id")).agg(best)
    return per.select("tree_id", (-F.col("b.id")).alias("mask_id"), "b.features", "b.score")


@query()
def candidate_subset_scores(spark, d):
    """The candidate subsets of the final stage (random, best and random, windows, strides) and their held-out scores."""
    ranked = stats.pearson(features(spark, d)).select("feature", F.abs("r").alias("score"))
    rows = [(i, c, [int(f[1:]) - 1 for f in c]) for i, c in enumerate(search.candidates(ranked, 100, 8))]
    df = spark.createDataFrame(rows, "candidate int, names array<string>, features array<int>")
    return r6("score", of=grams.scored_subsets(df, embedding_grams(spark, d)).drop("features"))


@query()
def tuned_regression(spark, d):
    """Regularisation of a linear model of the price, by a Gaussian process over held-out R^2: the settings tried."""
    li = table(spark, d, "lineitem").select("l_extendedprice", "l_quantity", "l_discount", "l_tax", F.pmod(F.xxhash64("l_orderkey"), F.lit(3)).alias("fold"))
    data = stored(search.assembled(li, ["l_quantity", "l_discount", "l_tax"], F.col("l_extendedprice")).select("features", "label", "fold"), "tuning")

    def evaluate(s):
        fitted = search.fitted_on(search.model("linear", regParam=10 ** s["log_penalty"], elasticNetParam=s["mix"]), data.where("fold <> 0"))
        return fitted.transform(data.where("fold = 0")).agg(*evaluation.regression_metrics(F.col("label"), F.col("prediction"))).first()["r2"]

    tried = tuning.tuned(evaluate, {"log_penalty": (-3.0, 5.0), "mix": (0.0, 1.0)}, first=4, steps=6)
    return r6("log_penalty", "mix", "r2", of=spark.createDataFrame([(i + 1, s["log_penalty"], s["mix"], v) for i, (s, v) in enumerate(tried)], "trial int, log_penalty double, mix double, r2 double"))
