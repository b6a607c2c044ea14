"""Scores, ranks and redundancy rules that choose features (Stage 1)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import information, stats


def ranked(scores: DataFrame, score: str = "score", tie: str = "feature") -> DataFrame:
    """scores with a 1-based ``rank``, best first; ranks of features, so the window is small."""
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), tie)).cast("long"))


def threshold_or_best(scores: DataFrame, least: float, min_keep: int, score: str = "score") -> DataFrame:
    """Rows above the threshold, or the best ``min_keep`` where fewer pass."""
    passed = F.sum((F.col(score) > least).cast("long")).over(Window.partitionBy(F.lit(1)))
    r = ranked(scores, score).withColumn("__passed", passed)
    return r.where(F.when(F.col("__passed") >= min_keep, F.col(score) > least).otherwise(F.col("rank") <= min_keep)).drop("__passed")


def stage1_filter(lf: DataFrame, min_variance: float = 1e-6, least: float = 0.05, min_keep: int = 10) -> DataFrame:
    """Features of enough variance by |correlation| with the target, with the min-keep fallback."""
    score = stats.pearson(lf).select("feature", F.abs("r").alias("score"))
    var = stats.moments(lf).select("feature", F.col("var_samp").alias("variance")).where(F.col("variance") > min_variance)
    return threshold_or_best(score.join(var, "feature"), least, min_keep)


def feature_scores(lf: DataFrame, bins: int = 10) -> DataFrame:
    """(feature, r, mi, variance) of every feature."""
    r = stats.pearson(lf).select("feature", F.abs("r").alias("r"))
    mi = information.mutual_information(information.with_equal_width(lf, bins))
    var = stats.moments(lf).select("feature", F.coalesce("var_samp", F.lit(0.0)).alias("variance"))
    return r.join(mi, "feature").join(var, "feature")


def composite(scores: DataFrame, mi_weight: float = 1.0, var_weight: float = 0.1, min_variance: float = 1e-6) -> DataFrame:
    """mi_weight * MI + var_weight * ln(variance + 1e-10); minus infinity at low variance."""
    s = mi_weight * F.col("mi") + var_weight * F.ln(F.col("variance") + 1e-10)
    return scores.withColumn("score", F.when(F.col("variance") <= min_variance, F.lit(float("-inf"))).otherwise(s))


def losers(scores: DataFrame, pairs: DataFrame, score: str = "score", tie: str = "first") -> DataFrame:
    """(feature, hits): how often a feature is the worse one of a correlated pair; ties lose the first or the second."""
    a = scores.select(F.col("feature").alias("f1"), F.col(score).alias("s1"))
    b = scores.select(F.col("feature").alias("f2"), F.col(score).alias("s2"))
    both = pairs.join(a, "f1").join(b, "f2")
    first = F.col("s1") <= F.col("s2") if tie == "first" else F.col("s1") < F.col("s2")
    return both.select(F.when(first, F.col("f1")).otherwise(F.col("f2")).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("hits"))


def penalised(scores: DataFrame, pairs: DataFrame, penalty: float = 0.5) -> DataFrame:
    """score * (1 - penalty) ** hits, or removal at a penalty of 1 or more."""
    j = scores.join(losers(scores, pairs), "feature", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    if penalty >= 1:
        return j.where("hits = 0")
    return j.withColumn("score", F.col("score") * F.pow(F.lit(1.0 - penalty), F.col("hits")))


def without_redundant(scores: DataFrame, pairs: DataFrame, score: str = "mi") -> DataFrame:
    """scores without each pair's worse feature; a tie removes the second."""
    return scores.join(losers(scores, pairs, score, "second"), "feature", "left_anti")


def greedy_uncorrelated(scores: DataFrame, pairs: DataFrame, most: float = 0.95, score: str = "score") -> DataFrame:
    """Features in rank order, each kept unless correlated above ``most`` with one kept before.

    The scan depends on its own earlier choices, so it runs over the rows of
    features on the driver: as many rows as the table has columns.
    """
    order = [r["feature"] for r in scores.orderBy(F.desc(score), "feature").select("feature").toLocalIterator()]
    bad: dict[str, set[str]] = {}
    for r in pairs.where(F.abs("r") > most).toLocalIterator():
        bad.setdefault(r["f1"], set()).add(r["f2"])
        bad.setdefault(r["f2"], set()).add(r["f1"])
    kept: list[str] = []
    for f in order:
        if not bad.get(f, set()) & set(kept):
            kept.append(f)
    return scores.join(F.broadcast(scores.sparkSession.createDataFrame([(f,) for f in kept], "feature string")), "feature", "left_semi")


def universal_score(scores: DataFrame) -> DataFrame:
    """0.4 |r| + 0.4 MI + 0.2 variance / max variance."""
    top = F.max("variance").over(Window.partitionBy(F.lit(1)))
    return scores.withColumn("score", 0.4 * F.col("r") + 0.4 * F.col("mi") + 0.2 * F.when(top > 0, F.col("variance") / top).otherwise(0.0))


def adaptive_threshold(scores: DataFrame, target: int, start: float = 0.01, score: str = "mi", rounds: int = 20) -> float:
    """A threshold that lets about ``target`` features pass, moved by ratio within [1e-4, 1]; the scores, a row a column of the table, are read once."""
    values = [r[0] for r in scores.select(score).collect() if r[0] is not None]
    t = start
    for _ in range(rounds):
        n = sum(v >= t for v in values)
        if abs(n - target) <= max(1, target // 10):
            break
        t = min(1.0, max(1e-4, t * (1.5 if n > target else 0.6)))
    return t


@dataclass(frozen=True)
class Thresholds:
    """What a feature must have to pass; values out of range are errors."""

    mi: float = 0.01
    correlation: float = 0.95
    variance: float = 1e-6
    target: int = 500
    rate: float = 0.1

    def __post_init__(self):
        if not (self.mi >= 0 and 0 < self.correlation <= 1 and self.variance >= 0 and self.target >= 1 and 0 < self.rate <= 1):
            raise ValueError(f"thresholds out of range: {self}")

    def updated(self, **changes: float | None) -> Thresholds:
        """These with the given ones changed; None changes nothing."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None})


def passing(scores: DataFrame, t: Thresholds) -> DataFrame:
    """scores (feature, mi, variance) at the thresholds or above, the ``target`` best by MI."""
    return scores.where((F.col("mi") >= t.mi) & (F.col("variance") >= t.variance)).orderBy(F.desc("mi"), "feature").limit(t.target)


def validated(selected: DataFrame, known: DataFrame) -> DataFrame:
    """(check, failures): ranks without gaps, unique names, names known, scores not null."""
    ranks = selected.agg(F.max("rank").alias("m"), F.count(F.lit(1)).alias("n"), F.countDistinct("feature").alias("d"), F.sum(F.col("score").isNull().cast("long")).alias("z")).withColumn("k", F.lit(1))
    unknown = selected.join(known.select("feature").distinct(), "feature", "left_anti").agg(F.count(F.lit(1)).alias("u")).withColumn("k", F.lit(1))
    row = ranks.join(unknown, "k")
    failures = {"rank_gaps": F.coalesce("m", F.lit(0)) - F.col("n"), "duplicates": F.col("n") - F.col("d"), "null_scores": F.coalesce("z", F.lit(0)), "unknown": F.col("u")}
    parts = F.array(*[F.struct(F.lit(k).alias("check"), v.cast("long").alias("failures")) for k, v in failures.items()])
    return row.select(F.explode(parts).alias("c")).select("c.*")
