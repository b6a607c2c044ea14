"""Small relations of a selection run: constraints, groups, comparisons, states.

Their rows are features, trees, models or subsets; they are joined and
aggregated like any table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clean import codes

# ---- projections and constraints ------------------------------------------


def projected(lf: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of the chosen features; chosen has a row a feature."""
    return lf.join(chosen.select("feature").distinct(), "feature", "left_semi")


def mixed_columns(df: DataFrame, numeric: list[str], categorical: list[str], keep: list[str]) -> DataFrame:
    """keep, the numeric columns as doubles and the categorical ones as codes (-1: missing)."""
    out = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in numeric], *categorical)
    for c in categorical:
        code = codes(df, c).select(F.col("value").alias(f"__{c}"), F.col("code").cast("double").alias(f"{c}_code"))
        out = out.join(code, F.col(c) == F.col(f"__{c}"), "left").withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(-1.0))).drop(c, f"__{c}")
    return out


def constrained(scores: DataFrame, score: str, top: int, exclude: list[str], must: list[str]) -> DataFrame:
    """The ``top`` features that are not excluded, those that must be in coming first."""
    forced = F.col("feature").isin(must)
    rows = scores.where(~F.col("feature").isin(exclude)).withColumn("forced", forced)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("forced"), F.desc(score), "feature")).cast("long")).where(F.col("rank") <= top)


def index_map(selected: DataFrame, order: list[Column], original: Column) -> DataFrame:
    """(feature, original_id, stage_index): both directions between a table's places and a selection's."""
    return selected.select("feature", original.alias("original_id"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("stage_index"))


def correlation_groups(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """(feature, group): the first in name order of a feature and its correlated partners."""
    both = pairs.select(F.col("f1").alias("feature"), F.col("f2").alias("other")).union(pairs.select("f2", "f1"))
    low = both.groupBy("feature").agg(F.min("other").alias("low"))
    return features.select("feature").join(low, "feature", "left").select("feature", F.least("feature", F.coalesce("low", F.col("feature"))).alias("group"))


# ---- trees and subsets -----------------------------------------------------


def ensemble_confidence(trees: DataFrame, votes: DataFrame) -> DataFrame:
    """One row: 0.4 mean confidence + 0.4 agreement on the ten commonest features + 0.2 balance of the workers.

    trees is (tree_id, worker, confidence), votes (tree_id, feature_id).
    """
    base = trees.agg(F.count(F.lit(1)).alias("trees"), F.avg("confidence").alias("confidence"))
    best = votes.groupBy("feature_id").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "feature_id").limit(10)
    top = best.agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("c"))
    load = trees.groupBy("worker").agg(F.count(F.lit(1)).alias("w")).agg(F.count(F.lit(1)).alias("workers"), ((F.max("w") - F.min("w")) / F.avg("w")).alias("uneven"))
    one = base.crossJoin(top).crossJoin(load)  # one row each
    balance = F.when(F.col("workers") < 2, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("uneven"))))
    agreement = F.col("c") / (F.col("k") * F.col("trees"))
    return one.select("confidence", agreement.alias("agreement"), balance.alias("balance"), (0.4 * F.col("confidence") + 0.4 * agreement + 0.2 * balance).alias("score"))


def exploration_constant(kind: str, place: Column, n: Column, u: Column, low: float = 0.5, high: float = 2.0) -> Column:
    """A tree's exploration constant: uniform by the draw u, or adaptive by its 0-based place among n."""
    return {"uniform": low + (high - low) * u, "adaptive": low + (high - low) * place / F.greatest(n - 1, F.lit(1))}[kind]


def diversity_action(diversity: Column, rate: Column, overlap: Column, low: float = 0.3, high: float = 0.7, step: float = 0.1) -> dict[str, Column]:
    """The next subsampling rate and overlap threshold: more diversity under ``low``, less above ``high``."""
    up, down = diversity < low, diversity > high
    return {
        "next_rate": F.when(up, F.greatest(F.lit(0.5), rate - step)).when(down, F.least(F.lit(1.0), rate + step)).otherwise(rate),
        "next_overlap": F.when(up, F.greatest(F.lit(0.3), overlap - 0.1)).when(down, F.least(F.lit(1.0), overlap + 0.1)).otherwise(overlap),
    }


def linear_surrogate(sets: DataFrame, weights: DataFrame) -> DataFrame:
    """(tree_id, predicted): sigmoid of the mean weight of a set's features; sets is (tree_id, feature)."""
    return sets.join(weights, "feature").groupBy("tree_id").agg(F.avg("weight").alias("w")).select("tree_id", (1 / (1 + F.exp(-F.col("w")))).alias("predicted"))


def augmented(sets: DataFrame, id: str, features: str, pool: Column, pick: Column) -> DataFrame:
    """(id, action, features) of each set without, with, and with one exchanged for a feature of the pool, all at the place ``pick``."""
    s = F.array_sort(F.col(features))
    gone = F.get(s, pick % F.size(s))
    fresh = F.array_sort(F.array_except(pool, s))
    added = F.get(fresh, pick % F.size(fresh))
    kinds = {"remove": F.array_remove(s, gone), "add": F.array_sort(F.array_append(s, added)), "swap": F.array_sort(F.array_append(F.array_remove(s, gone), added))}
    rows = F.array(*[F.struct(F.lit(k).alias("action"), v.alias("features")) for k, v in kinds.items()])
    return sets.select(id, F.explode(rows).alias("r")).select(id, "r.action", "r.features")


def prediction_confidence(size: Column, dimension: int, predicted: Column) -> Column:
    """(1 - 0.3 size / dimension) (1 - 0.2 |p - 0.5|), within [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - size / dimension * 0.3) * (1 - F.abs(predicted - 0.5) * 0.2)))


def confidence_level(c: Column) -> Column:
    return F.when(c >= 0.85, "high").when(c >= 0.7, "medium").otherwise("low")


# ---- models ----------------------------------------------------------------


def model_results(results: DataFrame, by: str = "model", value: str = "value") -> DataFrame:
    """count, errors (rows without a value), mean, std, low, high of every model."""
    v = F.col(value)
    return results.groupBy(by).agg(F.count(F.lit(1)).alias("runs"), F.count_if(v.isNull()).alias("errors"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"))


def top_models(means: DataFrame, k: int, by: str = "model", value: str = "mean") -> DataFrame:
    """The k best models and their weights in an ensemble, in proportion to the score."""
    best = means.orderBy(F.desc(value), by).limit(k)
    return best.select(by, value, (F.col(value) / F.sum(value).over(Window.partitionBy(F.lit(1)))).alias("weight"))


def compared_sets(means: DataFrame, by: str = "model", value: str = "mean") -> DataFrame:
    """(a, b, delta, winner) of every two feature sets' scores, a before b."""
    a = means.select(F.col(by).alias("a"), F.col(value).alias("x"))
    b = means.select(F.col(by).alias("b"), F.col(value).alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", (F.col("y") - F.col("x")).alias("delta"), F.when(F.col("y") > F.col("x"), F.col("b")).otherwise(F.col("a")).alias("winner"))


def combined_importance(scores: DataFrame, first: str, second: str, share: float = 0.5) -> DataFrame:
    """Two importances, each over its largest, mixed."""
    w = Window.partitionBy(F.lit(1))  # a row a feature
    part = lambda c: F.coalesce(F.try_divide(F.col(c), F.max(c).over(w)), F.lit(0.0))
    return scores.withColumn("importance", share * part(first) + (1 - share) * part(second))


def trend(slope: Column, dead: float = 0.001) -> Column:
    """1, 0 or -1 by a slope's sign outside of a dead band."""
    return F.when(F.abs(slope) < dead, 0).when(slope > 0, 1).when(slope < 0, -1)


# ---- user functions --------------------------------------------------------


def mapped_chunks(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """A user's function of pandas frames over the table, chunk by chunk as Spark's Arrow batches come."""
    return df.mapInPandas(lambda chunks: (function(c) for c in chunks), schema)


def scored_groups(df: DataFrame, by: list[str], score: Callable, truth: str, predicted: str) -> DataFrame:
    """A user's scoring function of (truths, predictions) on every group of (fold, model and the like), whose rows are in one task."""
    import pandas as pd

    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*by).dtypes) + ", score double"
    return df.select(*by, truth, predicted).groupBy(*by).applyInPandas(lambda key, rows: pd.DataFrame([(*key, float(score(rows[truth], rows[predicted])))], columns=[*by, "score"]), schema)
