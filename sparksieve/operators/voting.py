"""Ensembles of trees: votes, consensus, convergence, diversity, aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import min_max_over


def cast_votes(raw: DataFrame) -> DataFrame:
    """One vote of each (tree, feature), the first by order; later ones are rejected."""
    return raw.groupBy("tree_id", "feature_id").agg(F.min_by(F.struct("performance", "depth"), "seq").alias("v"), F.count(F.lit(1)).alias("cast")).select("tree_id", "feature_id", "v.performance", "v.depth", (F.col("cast") - 1).alias("rejected"))


def tree_weights(votes: DataFrame, stability: Column, rounds: Column) -> DataFrame:
    """(tree_id, weight): 0.4 performance + 0.3 exploration + 0.2 diversity + 0.1 stability, decayed."""
    per = votes.groupBy("tree_id").agg(F.avg("performance").alias("p"), F.avg("depth").alias("d"), F.count(F.lit(1)).alias("k"))
    used = votes.groupBy("feature_id").agg(F.count(F.lit(1)).alias("u"))
    rare = votes.join(used, "feature_id").groupBy("tree_id").agg(F.avg(1 / F.col("u")).alias("rare"))
    w = 0.4 / (1 + F.exp(-5 * (F.col("p") - 0.5))) + 0.3 * F.least(F.lit(2.0), 1 + F.ln(F.greatest(F.lit(1.0), F.col("d"))) / 10) + 0.2 * F.col("rare") + 0.1 * stability
    return per.join(rare, "tree_id").select("tree_id", (w * F.pow(F.lit(0.95), rounds)).alias("weight"))


def consensus(votes: DataFrame, weights: DataFrame) -> DataFrame:
    """(feature_id, votes, score): summed weights over the number of trees."""
    n = F.broadcast(weights.agg(F.count(F.lit(1)).alias("trees")))
    scored = votes.join(weights, "tree_id").groupBy("feature_id").agg(F.count(F.lit(1)).alias("votes"), F.sum("weight").alias("w"), F.avg("performance").alias("performance"), F.avg("depth").alias("exploration"), F.min("seq" if "seq" in votes.columns else "feature_id").alias("first"))
    return scored.crossJoin(n).withColumn("score", F.col("w") / F.col("trees")).drop("w", "trees")


def consensus_threshold(scores: DataFrame, kind: str, base: float = 0.5, stability: float = 0.0, progress: float = 0.0) -> Column:
    """absolute base; relative 0.8 of the best; dynamic base (1 - 0.3 stability), at least 0.5 base; progressive up to 1.5 base."""
    top = F.max("score").over(Window.partitionBy(F.lit(1)))
    return {"absolute": F.lit(base), "relative": 0.8 * top, "dynamic": F.lit(max(0.5 * base, base * (1 - 0.3 * stability))), "progressive": F.lit(base * (1 + 0.5 * min(1.0, progress)))}[kind]


def build_consensus(scores: DataFrame, threshold: Column, target: int, least: int, ties: str = "performance") -> DataFrame:
    """The best ``target`` features at the threshold or above, filled up to ``least`` from below it."""
    tie = {"performance": F.desc(F.round("performance", 9)), "exploration": F.desc(F.round("exploration", 9)), "timestamp": F.asc("first"), "hash": F.asc(F.col("feature_id") * 2654435761 % 1000003)}[ties]
    rows = scores.withColumn("passed", F.col("score") >= threshold).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), tie, "feature_id")).cast("long"))
    return rows.where((F.col("passed") & (F.col("rank") <= target)) | (F.col("rank") <= least))


def selection_entropy(votes: DataFrame, feature: str = "feature_id") -> DataFrame:
    """One row: entropy of the selections over log2 of the number of features."""
    c = votes.groupBy(feature).agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy(F.lit(1)))
    h = c.select((-p * F.log2(p)).alias("h")).agg(F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))
    return h.select(F.when(F.col("n") > 1, F.col("h") / F.log2("n")).otherwise(0.0).alias("entropy"))


def agreement(sizes: Column) -> Column:
    """Aggregate 1 / (1 + coefficient of variation) of set sizes."""
    return 1 / (1 + F.coalesce(F.stddev_samp(sizes) / F.nullif(F.avg(sizes), F.lit(0.0)), F.lit(0.0)))


def aggregate_results(results: DataFrame) -> DataFrame:
    """(feature_id, n, avg, frequency, score, rank) of (tree_id, feature_id, score, confidence, selected).

    The average weighs scores by confidence, unselected features counting half;
    the final score is 0.7 average + 0.3 share of trees that select it.
    """
    trees = F.broadcast(results.agg(F.countDistinct("tree_id").alias("trees")))
    w = F.col("confidence") * F.when(F.col("selected"), 1.0).otherwise(0.5)
    per = results.groupBy("feature_id").agg(F.count_if("selected").alias("n"), (F.sum(F.col("score") * w) / F.sum("confidence")).alias("avg")).crossJoin(trees)
    out = per.withColumn("frequency", F.col("n") / F.col("trees")).withColumn("score", 0.7 * F.col("avg") + 0.3 * F.col("frequency")).drop("trees")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "feature_id")).cast("long"))


def stability(selected: DataFrame, run: str, feature: str, share: float = 0.7) -> DataFrame:
    """(feature, frequency, stable): share of the runs that select it."""
    runs = F.broadcast(selected.agg(F.countDistinct(run).alias("runs")))
    per = selected.groupBy(feature).agg(F.countDistinct(run).alias("k")).crossJoin(runs)
    return per.select(feature, (F.col("k") / F.col("runs")).alias("frequency"), (F.col("k") / F.col("runs") >= share).alias("stable"))


def rankings_combined(scores: DataFrame, method: str, by: str = "model", item: str = "feature_id", score: str = "score", k: int = 10) -> DataFrame:
    """(item, total) over the models: borda points, average rank, or votes for the k best."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), item))
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    r = scores.select(by, item, rank.alias("r"), n.alias("n")).groupBy(item)
    return {"borda": lambda: r.agg(F.sum(F.col("n") - F.col("r") + 1).cast("double").alias("total")), "average_rank": lambda: r.agg(F.avg("r").alias("total")), "majority": lambda: r.agg(F.sum((F.col("r") <= k).cast("int")).cast("double").alias("total"))}[method]()


def weighted_scores(scores: DataFrame, weights: dict[str, float], by: str = "method", item: str = "feature_id", score: str = "score") -> DataFrame:
    """Weighted mean of the methods' min-max normalised scores."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col(by)]
    norm = scores.withColumn("s", min_max_over(F.col(score), [by]))
    return norm.groupBy(item).agg((F.sum(F.col("s") * w) / F.sum(w)).alias("score"))


def voted(predictions: DataFrame, how: str, sample: str = "sample_id", label: str = "label", proba: str = "proba", weight: str = "weight", order: list[str] | None = None) -> DataFrame:
    """Hard, weighted hard, soft or weighted (soft) vote of the models on every sample; equal votes go to the smallest label.

    Sums of doubles depend on the order of their terms, and a mean of one half on such a sum: with ``order`` a sample's terms are added in
    the order of these columns, however the rows are spread.
    """
    if how in ("hard", "weighted_hard"):
        counts = predictions.groupBy(sample, label).agg((F.count(F.lit(1)) if how == "hard" else F.round(F.sum(weight), 9)).alias("c"))
        return counts.groupBy(sample).agg(F.max_by(label, F.struct("c", -F.col(label))).alias("vote"))
    over, under = (F.col(proba), F.when(F.col(proba).isNotNull(), 1.0)) if how == "soft" else (F.col(proba) * F.col(weight), F.col(weight))
    if order:
        upto = Window.partitionBy(sample).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        run = predictions.select(sample, F.struct(*order).alias("at"), F.sum(over).over(upto).alias("a"), F.sum(under).over(upto).alias("b"))
        sums = run.groupBy(sample).agg(F.max_by(F.struct("a", "b"), "at").alias("s")).select(sample, "s.a", "s.b")
    else:
        sums = predictions.groupBy(sample).agg(F.sum(over).alias("a"), F.sum(under).alias("b"))
    return sums.select(sample, (F.col("a") / F.nullif("b", F.lit(0.0)) >= 0.5).cast("long").alias("vote"))


def weighted_mean(predictions: DataFrame, sample: str = "sample_id", value: str = "prediction", weight: str = "weight") -> DataFrame:
    """(sample, prediction): the models' predictions weighed by normalised weights; null where the weights add up to 0."""
    return predictions.groupBy(sample).agg((F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0.0))).alias("prediction"))


def pareto(candidates: DataFrame, score: str = "score", size: str = "size", most: int | None = None) -> DataFrame:
    """Candidates by score over the square root of their size; the ``most`` best of them."""
    valued = candidates.withColumn("value", F.col(score) / F.sqrt(F.greatest(F.col(size), F.lit(1))))
    if most is not None:  # a top-k, so that the ranking window has few rows
        valued = valued.orderBy(F.desc("value"), size).limit(most)
    return valued.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"), size)).cast("long"))
