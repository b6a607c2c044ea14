"""Folds, metrics, curves and statistical tests.

Counting and summing is left to Spark's aggregates; the tail probabilities of
one row of sums are small helpers on the driver or in a pandas UDF.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import positioned, ranged, scanned
from .quantiles import exact_quantiles

# ---- folds -----------------------------------------------------------------


def contiguous_folds(df: DataFrame, order: str, k: int) -> DataFrame:
    """df with ``fold`` 0..k-1: equal blocks in order, the last takes the rest."""
    n = df.count()
    numbered = positioned(df, [], [order])
    size = max(1, n // k)
    return numbered.withColumn("fold", F.least(F.floor((F.col("position") - 1) / size), F.lit(k - 1)).cast("long")).drop("position")


def stratified_folds(df: DataFrame, cls: Column, order: list[Column], k: int) -> DataFrame:
    """df with ``fold``: rows of each class dealt in turn, in the given order."""
    keys = {f"__o{i}": c for i, c in enumerate(order)}
    dealt = positioned(df.withColumn("__cls", cls).withColumns(keys), ["__cls"], list(keys), "__at")
    return dealt.withColumn("fold", ((F.col("__at") - 1) % k).cast("long")).select(*df.columns, "fold")


def fold_check(df: DataFrame, cls: str, least: int = 1) -> DataFrame:
    """(fold, classes, smallest, valid): rows of the rarest class in every fold."""
    per = df.groupBy("fold", F.col(cls).alias("__cls")).agg(F.count(F.lit(1)).alias("__c"))
    return per.groupBy("fold").agg(F.count(F.lit(1)).alias("classes"), F.min("__c").alias("smallest"), (F.min("__c") >= least).alias("valid"))


# ---- metrics ---------------------------------------------------------------


def regression_metrics(truth: Column, predicted: Column) -> list[Column]:
    """Aggregates mae, mse, rmse, r2, mape (over non-zero truths)."""
    e = truth - predicted
    mse, var = F.avg(e * e), F.var_pop(truth)
    return [F.avg(F.abs(e)).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.when(var > 0, 1 - mse / var).otherwise(0.0).alias("r2"), F.avg(F.when(truth != 0, F.abs(e / truth))).alias("mape")]


def confusion(df: DataFrame, truth: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn and the scores made of them; 0 where a denominator is 0."""
    t, p = truth.cast("boolean"), predicted.cast("boolean")
    c = df.groupBy(*(by or [])).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    out = c.withColumns({"accuracy": share(tp + tn, tp + fp + tn + fn), "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "specificity": share(tn, tn + fp)})
    return out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("macro_f1", (F.col("f1") + share(2 * tn, 2 * tn + fp + fn)) / 2)


def roc_curve(df: DataFrame, truth: Column, score: Column) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, and the origin (null threshold).

    The rows are counted by score first, and the running sums go over ranges of
    the distinct scores.
    """
    c = df.groupBy(score.alias("threshold")).agg(F.count_if(truth.cast("boolean")).alias("p"), F.count_if(~truth.cast("boolean")).alias("n"))
    total = F.broadcast(c.agg(F.sum("p").alias("tp_all"), F.sum("n").alias("fp_all")))
    run = scanned(ranged(c, "threshold"), [], ["threshold"], {"tp": (F.sum, F.col("p"), True), "fp": (F.sum, F.col("n"), True)}).crossJoin(total)
    points = run.select("threshold", F.when(F.col("fp_all") > 0, F.col("fp") / F.col("fp_all")).otherwise(0.0).alias("fpr"), F.when(F.col("tp_all") > 0, F.col("tp") / F.col("tp_all")).otherwise(0.0).alias("tpr"))
    return points.unionByName(total.select(F.lit(None).cast(dict(c.dtypes)["threshold"]).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))


def auc(curve: DataFrame) -> DataFrame:
    """Area by trapezoids."""
    w = Window.orderBy("fpr", "tpr")
    step = (F.col("fpr") - F.lag("fpr").over(w)) * (F.col("tpr") + F.lag("tpr").over(w)) / 2
    return curve.select(step.alias("a")).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("auc"))


def fold_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """mean, std, min, max, n, stability 1 / (1 + cv) and the 95 % band of every group."""
    v = F.col(value)
    sd, m, n = F.coalesce(F.stddev_samp(v), F.lit(0.0)), F.avg(v), F.count(v)
    return df.groupBy(*by).agg(n.alias("n"), m.alias("mean"), sd.alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), (1 / (1 + sd / F.nullif(F.abs(m), F.lit(0.0)))).alias("stability"), (1.96 * sd / F.sqrt(n)).alias("half_width"))


def robust_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median and 1.4826 * median absolute deviation of every group."""
    med = exact_quantiles(df, by, value, [0.5], "median").withColumn("median", F.col("median")[0])
    away = df.join(med, by).select(*by, F.abs(F.col(value) - F.col("median")).alias("away"))
    spread = exact_quantiles(away, by, "away", [0.5], "spread")
    return med.join(spread, by).select(*by, "median", (1.4826 * F.col("spread")[0]).alias("spread"))


# ---- tail probabilities ----------------------------------------------------


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's rule."""
    tiny, front = 1e-300, 1.0
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    front = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            c = 1.0 + top / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            front *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= t) of Student's t."""
    return 1.0 if df <= 0 or math.isnan(t) else incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """The t with P(T <= t) = p > 1/2, by bisection."""
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_two_sided(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_one(x: float) -> float:
    """P(X >= x) of chi-square with one degree of freedom."""
    return math.erfc(math.sqrt(max(0.0, x) / 2))


# ---- tests -----------------------------------------------------------------


def tail(name: str) -> object:
    """A tail probability as a pandas UDF of (statistic, degrees)."""
    from pyspark.sql.functions import pandas_udf

    one = {"t": t_two_sided, "normal": lambda z, _: normal_two_sided(z), "chi2": lambda x, _: chi2_one(x), "t_quantile": t_quantile}[name]

    @pandas_udf("double")
    def run(s, df):
        import pandas as pd

        return pd.Series([float("nan") if pd.isna(a) else one(float(a), float(b)) for a, b in zip(s, df)])

    return run


def one_sided(p: Column, statistic: Column, alternative: str) -> Column:
    """The p of an alternative (two_sided, greater, less) out of the two-sided one of a symmetric statistic."""
    if alternative == "two_sided":
        return p
    toward = statistic > 0 if alternative == "greater" else statistic < 0
    return F.when(toward, p / 2).otherwise(1 - p / 2)


def paired_t(pairs: DataFrame, by: list[str], a: str, b: str, alternative: str = "two_sided") -> DataFrame:
    """n, mean difference, t, p, confidence interval and Cohen's d of paired values; equal differences of 0 have t = 0, p = 1."""
    diff = F.col(a) - F.col(b)
    s = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(diff).alias("mean_diff"), F.stddev_samp(diff).alias("sd"), F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2).alias("pooled"))
    # equal differences: no evidence if they are 0, else as strong as can be
    t = F.when(F.col("sd") > 0, F.col("mean_diff") / (F.col("sd") / F.sqrt("n"))).when((F.col("n") > 1) & (F.col("mean_diff") == 0), 0.0).when(F.col("n") > 1, F.signum("mean_diff") * float("inf"))
    r = s.withColumn("t", t).withColumn("df", F.col("n") - 1).withColumn("p", one_sided(tail("t")("t", "df"), F.col("t"), alternative)).withColumn("q", tail("t_quantile")(F.lit(0.975), "df"))
    half = F.col("q") * F.col("sd") / F.sqrt("n")
    return r.select(*by, "n", "mean_diff", "t", "df", "p", (F.col("mean_diff") - half).alias("ci_low"), (F.col("mean_diff") + half).alias("ci_high"), F.try_divide("mean_diff", "pooled").alias("cohen_d"))


def wilcoxon(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """W+, tie-corrected z, p and rank-biserial of paired values; zero differences are left out."""
    d = pairs.select(*by, (F.col(a) - F.col(b)).alias("__d")).where("__d <> 0").withColumn("__m", F.round(F.abs("__d"), 9))
    c = d.groupBy(*by, "__m").agg(F.count(F.lit(1)).alias("__c"), F.count_if(F.col("__d") > 0).alias("__plus"))
    run = F.sum("__c").over(Window.partitionBy(*by).orderBy("__m").rowsBetween(Window.unboundedPreceding, 0))
    ranked = c.withColumn("__rank", run - F.col("__c") + (F.col("__c") + 1) / 2)
    s = ranked.groupBy(*by).agg(F.sum("__c").alias("n"), F.sum(F.col("__plus") * F.col("__rank")).alias("w_plus"), F.sum(F.pow("__c", F.lit(3)) - F.col("__c")).alias("ties"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = F.when(var > 0, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(var)).otherwise(0.0)
    total = n * (n + 1) / 2
    return s.withColumn("z", z).withColumn("p", tail("normal")("z", F.lit(0.0))).select(*by, "n", "w_plus", "z", "p", ((2 * F.col("w_plus") - total) / total).alias("rank_biserial"))


def mcnemar(df: DataFrame, by: list[str], a: Column, b: Column) -> DataFrame:
    """Discordant counts of two correctness flags, chi-square (continuity-corrected under 25), p, odds ratio."""
    c = df.groupBy(*by).agg(F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"))
    x, y = F.col("b"), F.col("c")
    gap = F.abs(x - y) - F.when(x + y < 25, 1).otherwise(0)
    stat = F.when(x + y > 0, F.pow(F.greatest(gap, F.lit(0)), F.lit(2)) / (x + y)).otherwise(0.0)
    return c.withColumn("chi2", stat).withColumn("p", tail("chi2")("chi2", F.lit(1.0))).withColumn("odds_ratio", F.try_divide(x.cast("double"), y.cast("double")))


def effect_sizes(df: DataFrame, by: list[str], value: str, first: Column) -> DataFrame:
    """Cohen's d, Glass's delta and Hedges's g between the rows where ``first`` holds and the others."""
    x, y = F.when(first, F.col(value)), F.when(~first, F.col(value))
    s = df.groupBy(*by).agg(F.count(x).alias("n1"), F.count(y).alias("n2"), F.avg(x).alias("m1"), F.avg(y).alias("m2"), F.var_samp(x).alias("v1"), F.var_samp(y).alias("v2"))
    n = F.col("n1") + F.col("n2")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (n - 2))
    gap = F.col("m1") - F.col("m2")
    d = F.try_divide(gap, pooled)
    return s.select(*by, d.alias("cohen_d"), F.try_divide(gap, F.sqrt("v2")).alias("glass_delta"), (d * (1 - 3 / (4 * n - 9))).alias("hedges_g"))


def adjusted(tests: DataFrame, p: str = "p", by: list[str] | None = None) -> DataFrame:
    """tests with bonferroni, holm and benjamini_hochberg; ranks and running extremes go over ranges of p."""
    by, one = by or [], F.lit(1.0)
    up = scanned(ranged(tests, *by, p), by, [p], {"__r": (F.sum, F.lit(1).cast("long"), False), "__left": (F.sum, F.lit(1).cast("long"), True)})
    m = F.col("__r") + F.col("__left") - 1
    ends = scanned(up.withColumn("__m", m), by, [p, "__r"], {"__holm": (F.max, F.col(p) * F.col("__left"), False), "__bh": (F.min, F.col(p) * F.col("__m") / F.col("__r"), True)})
    return ends.select(*tests.columns, F.least(one, F.col(p) * F.col("__m")).alias("bonferroni"), F.least(one, "__holm").alias("holm"), F.least(one, "__bh").alias("benjamini_hochberg"))


#: Rows whose draws are in memory at a time, groups whose sums are, and rounds that one 64-bit hash draws signs for.
DRAW_ROWS, DRAW_GROUPS, SIGNS = 256, 64, 64


def _round_sums(df: DataFrame, by: list[str], id: str, value: Column, rounds: int, seed: int, draw: Callable) -> DataFrame:
    """(by..., round, s, w) of every round 0..rounds-1: sums that ``draw`` makes of hashes and values, added up inside tasks.

    ``draw(hashes, values, rounds)`` gives two vectors of sums; a task holds and sends one pair for each
    group that it meets, however many rows there are.
    """
    rows = df.select(*by, F.xxhash64(F.col(id), F.lit(seed)).alias("__h"), value.cast("double").alias("__v"))
    schema = T.StructType([*rows.schema.fields[: len(by)], T.StructField("s", T.ArrayType(T.DoubleType())), T.StructField("w", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[np.ndarray]] = {}

        def out() -> pa.RecordBatch:
            keys = list(sums)
            columns = [pa.array([k[i] for k in keys], type=kinds[i]) for i in range(len(by))]
            columns += [pa.array([sums[k][j].tolist() for k in keys], type=pa.list_(pa.float64())) for j in (0, 1)]
            sums.clear()
            return pa.RecordBatch.from_arrays(columns, names=[*by, "s", "w"])

        kinds = []
        for batch in batches:
            kinds = [batch.column(i).type for i in range(len(by))]
            groups: dict[tuple, list[int]] = {}
            for n, k in enumerate(zip(*(batch.column(i).to_pylist() for i in range(len(by)))) if by else [()] * batch.num_rows):
                groups.setdefault(k, []).append(n)
            h = batch.column(len(by)).to_numpy().view(np.uint64)
            v = batch.column(len(by) + 1).to_numpy(zero_copy_only=False).astype(np.float64)
            for k, at in groups.items():
                mine = sums.setdefault(k, [np.zeros(rounds), np.zeros(rounds)])
                for i in range(0, len(at), DRAW_ROWS):
                    some = at[i : i + DRAW_ROWS]
                    for total, part in zip(mine, draw(h[some], v[some], rounds)):
                        total += part
                if len(sums) >= DRAW_GROUPS:
                    yield out()
        if sums:
            yield out()

    both = rows.mapInArrow(run, schema).select(*by, F.posexplode(F.arrays_zip("s", "w")).alias("round", "e"))
    return both.groupBy(*by, "round").agg(F.sum("e.s").alias("s"), F.sum("e.w").alias("w"))


def _hashes(h: np.ndarray, n: int) -> np.ndarray:
    """n hashes of each hash."""
    with np.errstate(over="ignore"):
        x = h[:, None] + np.arange(1, n + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _poisson(h: np.ndarray, v: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of weighted values and of weights; a missing value adds its weight only."""
    u = _hashes(h, rounds) >> np.uint64(11)
    cuts = np.array([sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2.0**53 for k in range(16)]).astype(np.uint64)
    w = np.searchsorted(cuts, u, side="right").astype(np.float64)
    return np.nan_to_num(v) @ w, w.sum(axis=0)


def _signs(h: np.ndarray, v: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values with drawn signs and counts of values; round 0 is as observed."""
    known = ~np.isnan(v)
    h, v = h[known], v[known]
    bits = np.unpackbits(_hashes(h, -(-rounds // SIGNS)).view(np.uint8), axis=1)[:, :rounds].astype(np.float64)
    bits[:, 0] = 1
    return 2 * (v @ bits) - v.sum(), np.full(rounds, float(len(v)))


def bootstrap(df: DataFrame, by: list[str], id: str, value: str, rounds: int = 200, seed: int = 7, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean by Poisson resampling: a row's weight in a round is a hash draw."""
    means = _round_sums(df, by, id, F.col(value), rounds, seed, _poisson).select(*by, (F.col("s") / F.nullif("w", F.lit(0.0))).alias("m"))
    return means.groupBy(*by).agg(F.percentile("m", F.lit((1 - level) / 2)).alias("ci_low"), F.percentile("m", F.lit((1 + level) / 2)).alias("ci_high"), F.count("m").alias("rounds"))


def permutation_test(pairs: DataFrame, by: list[str], id: str, a: str, b: str, rounds: int = 200, seed: int = 7) -> DataFrame:
    """Two-sided p of the mean paired difference under sign flips drawn by hash."""
    sums = _round_sums(pairs, by, id, F.col(a) - F.col(b), rounds + 1, seed, _signs)
    means = sums.select(*by, "round", F.abs(F.col("s") / F.nullif("w", F.lit(0.0))).alias("m"))
    seen = means.groupBy(*by).agg(F.max(F.when(F.col("round") == 0, F.col("m"))).alias("seen"), F.array_agg(F.when(F.col("round") > 0, F.col("m"))).alias("drawn"))
    least = F.col("seen") - 1e-12 * F.greatest(F.lit(1.0), "seen")
    hits = F.size(F.filter("drawn", lambda m: m >= least))
    return seen.select(*by, ((hits + 1) / (rounds + 1)).alias("p"), F.col("seen").alias("mean_diff"))


def confidence_interval(df: DataFrame, by: list[str], id: str, value: str, method: str = "analytical", level: float = 0.95, rounds: int = 10_000) -> DataFrame:
    """(by..., mean, ci_low, ci_high): mean +- t s / sqrt(n), or the percentiles of bootstrap means; null bounds under two values."""
    if method == "bootstrap":
        return bootstrap(df, by, id, value, rounds, level=level).join(df.groupBy(*by).agg(F.avg(value).alias("mean")), by).select(*by, "mean", "ci_low", "ci_high")
    if method != "analytical":
        raise ValueError(f"no such method: {method}")
    s = df.groupBy(*by).agg(F.count(value).alias("__n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("__e"))
    # a quantile for each number of values: groups of equal size share it
    sizes = s.select("__n").where("__n > 1").distinct()
    quantile = F.udf(lambda n: t_quantile((1 + level) / 2, n - 1), "double")
    known = sizes.select(F.col("__n").alias("__m"), quantile("__n").alias("__q"))
    half = F.col("__q") * F.col("__e")
    return s.join(known, F.col("__n") == F.col("__m"), "left").select(*by, "mean", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"))


def compared_models(pairs: DataFrame, by: list[str], a: str, b: str, test: str = "paired_t", correction: str = "bonferroni", alpha: float = 0.05) -> DataFrame:
    """The test of every pair of models with its corrected p-values, and whether it is significant after the named one."""
    if test not in ("paired_t", "wilcoxon"):
        raise ValueError(f"no such test: {test}")
    tested = (paired_t if test == "paired_t" else wilcoxon)(pairs, by, a, b)
    return adjusted(tested).withColumn("significant", F.col(correction) < alpha)


#: Values of a group that one task may hold for a statistic of any kind.
STATISTIC_ROWS = 1_000_000


def custom_permutation_test(df: DataFrame, by: list[str], id: str, value: str, first: Column, statistic: Callable[[np.ndarray, np.ndarray], float], rounds: int = 10_000, alternative: str = "two_sided", seed: int = 7, parts: int = 16) -> DataFrame:
    """(by..., statistic, p): of a callable of two samples, against it of samples dealt anew from both together.

    A group's values (scores of models, not data: more than STATISTIC_ROWS of
    them are an error) go to ``parts`` tasks, each of which shuffles them for its own
    share of the rounds by a seeded generator, in the order of their ids.  p counts the observed
    deal as one round; a group with an empty sample has no p.
    """
    if alternative not in ("two_sided", "greater", "less"):
        raise ValueError(f"no such alternative: {alternative}")
    rows = df.where(F.col(value).isNotNull() & first.isNotNull()).select(*by, F.col(id).alias("__id"), F.col(value).cast("double").alias("__v"), first.alias("__first"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("__part"))
    schema = T.StructType([*rows.schema.fields[: len(by)], T.StructField("__seen", T.DoubleType()), T.StructField("__hits", T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > STATISTIC_ROWS:
            raise ValueError(f"a group has {len(pdf)} values; a custom statistic takes {STATISTIC_ROWS} at most")
        pdf = pdf.sort_values(["__id", "__v"])
        v, one, part = pdf["__v"].to_numpy(), pdf["__first"].to_numpy().astype(bool), int(pdf["__part"].iloc[0])
        n, hits, seen = int(one.sum()), 0, np.nan
        if 0 < n < len(v):
            seen, rng = float(statistic(v[one], v[~one])), np.random.default_rng([seed, part])
            for _ in range(part, rounds, parts):
                dealt = rng.permutation(v)
                x = float(statistic(dealt[:n], dealt[n:]))
                slack = 1e-12 * max(1.0, abs(seen))
                hits += {"two_sided": abs(x) >= abs(seen) - slack, "greater": x >= seen - slack, "less": x <= seen + slack}[alternative]
        return pd.DataFrame({**{b: [pdf[b].iloc[0]] for b in by}, "__seen": [seen], "__hits": [hits]})

    found = rows.groupBy(*by, "__part").applyInPandas(run, schema)
    # a group without a statistic has a null here
    seen = F.max(F.nanvl("__seen", F.lit(None).cast("double")))
    return found.groupBy(*by).agg(seen.alias("statistic"), F.when(seen.isNotNull(), (F.sum("__hits") + 1) / (rounds + 1)).alias("p"))
