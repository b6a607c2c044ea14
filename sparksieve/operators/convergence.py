"""Convergence, early stopping, diversity and cross-tree rules of an ensemble."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored
from .windows import runs


@dataclass(frozen=True)
class Detector:
    """When an ensemble has converged."""

    # fixed values: the defaults of the configuration
    stability: float = 0.95
    consensus: float = 0.9
    entropy: float = 0.1
    agreement: float = 0.85
    window: int = 100
    least_rounds: int = 1000
    most_rounds: int = 50_000
    patience: int = 10
    stable_windows: int = 5
    tolerance: float = 0.02
    initial: float = 0.95
    decay: float = 0.99
    minimum: float = 0.8
    interval: int = 500
    test_window: int = 200
    sensitivity: float = 0.01
    variance: float = 0.1


MODES = ("static", "linear", "exponential", "problem", "performance")


def with_thresholds(rounds: DataFrame, by: list[str], order: str, mode: str, c: Detector = Detector()) -> DataFrame:
    """rounds with ``round`` (from 1), ``threshold`` as it is when the round's window is looked at, and ``adapted``, as it is after the round.

    Every ``interval`` rounds the stability threshold moves: linearly or
    exponentially down towards the minimum, with the trend of the stabilities before the
    round (1 % up or down), or 2 % down under a consensus above 0.9; within [minimum,
    initial], and only by more than 0.01.  The steps of a run (rounds / interval of them) are folded in one row.
    """
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    w = Window.partitionBy(*by).orderBy(order)
    past = w.rowsBetween(-c.window, -1)
    x, y = F.col("round").cast("double"), F.col("stability")
    n, sx, sy = F.count(y).over(past), F.sum(x).over(past), F.sum(y).over(past)
    slope = (n * F.sum(x * y).over(past) - sx * sy) / (n * F.sum(x * x).over(past) - sx * sx)
    numbered = rounds.withColumn("round", F.row_number().over(w).cast("long")).withColumn("slope", F.when(n >= 10, slope))
    steps = numbered.where(F.col("round") % c.interval == 0).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("round", "slope", "consensus"))).alias("steps"))

    def moved(now: Column, e: Column) -> Column:
        aim = {
            "static": now,
            "linear": c.initial - e["round"] / F.lit(c.most_rounds) * (c.initial - c.minimum),
            "exponential": c.initial * F.pow(F.lit(c.decay), e["round"] / F.lit(c.interval)),
            "problem": now * F.when(e["slope"] > 0.001, 1.01).when(e["slope"] < -0.001, 0.99).otherwise(1.0),
            "performance": now * F.when(e["consensus"] > 0.9, 0.98).otherwise(1.0),
        }[mode]
        aim = F.greatest(F.lit(c.minimum), F.least(F.lit(c.initial), aim))
        return F.when(F.abs(aim - now) > 0.01, aim).otherwise(now)

    folded = F.aggregate("steps", F.array(F.lit(c.stability)), lambda a, e: F.array_append(a, moved(F.element_at(a, -1), e)))
    known = steps.select(*[F.col(k).alias(f"__{k}") for k in by], folded.alias("__t"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by]
    # a row a run
    joined = numbered.join(known, same, "left") if by else numbered.crossJoin(F.broadcast(known))
    at = lambda k: F.coalesce(F.element_at("__t", (F.floor(k / c.interval) + 1).cast("int")), F.lit(c.stability))
    return joined.select(*rounds.columns, "round", at(F.col("round") - 1).alias("threshold"), at(F.col("round")).alias("adapted"))


def convergence(rounds: DataFrame, by: list[str], order: str, mode: str = "problem", c: Detector = Detector()) -> DataFrame:
    """Rounds (stability, consensus, entropy, agreement) with what the five strategies and the five stopping criteria say after each.

    A round is stable when the last ``stable_windows`` stabilities are at the
    threshold less the tolerance; ``run`` counts the stable rounds in a row.  Under ``least_rounds``
    nothing has converged, from ``most_rounds`` on everything.
    """
    rows = with_thresholds(rounds, by, order, mode, c)
    w = Window.partitionBy(*by).orderBy(order)
    last = lambda n: w.rowsBetween(-(n - 1), 0)
    s = F.col("stability")
    stable = (F.count(s).over(last(c.stable_windows)) == c.stable_windows) & (F.min(s).over(last(c.stable_windows)) >= F.col("threshold") - c.tolerance)
    # slope of the last five over places 1 to 5; rounded, so that a trend of just the limit is not under it
    trend = F.when(F.count(s).over(last(5)) == 5, F.round(sum((k * F.lag(s, 2 - k).over(w) for k in range(-2, 3)), F.lit(0.0)) / 10, 12)).otherwise(0.0)
    rows = runs(rows.withColumns({"stable": stable, "trend": trend, "spread": F.when(F.count(s).over(last(c.test_window)) == c.test_window, F.var_samp(s).over(last(c.test_window)))}), F.col("stable"), by, [order])
    r, run = F.col("round"), F.col("run")
    a, b, d = (s >= F.col("adapted")) & (run >= c.stable_windows), F.col("consensus") >= c.consensus, F.col("entropy") <= c.entropy
    count = lambda *flags: sum((f.cast("int") for f in flags), F.lit(0))
    decide = lambda found: F.when(r < c.least_rounds, False).when(r >= c.most_rounds, True).otherwise(found)
    flat = lambda limit: F.abs("trend") < limit
    return rows.select(
        *rounds.columns, "round", "adapted", "run",
        decide(a).alias("by_stability"), decide(b).alias("by_consensus"), decide(d).alias("by_entropy"), decide(count(a, b, d) / 3 >= 0.6).alias("by_majority"),
        decide((s > 0.95) & (F.col("consensus") > 0.9) | (F.col("entropy") < 0.1) & (run >= 3)).alias("by_state"),
        (run >= c.patience).alias("stop_fixed"), F.coalesce(F.col("spread") < c.variance, F.lit(False)).alias("stop_variance"), ((r >= 20) & flat(c.sensitivity)).alias("stop_plateau"), (F.col("agreement") >= c.agreement).alias("stop_agreement"),
        (count(run >= 3, F.col("consensus") >= 0.85, F.col("entropy") <= 0.2, flat(0.01)) >= 3).alias("stop_adaptive"),
    )


def diversity(overlap: Column, entropy: Column, variance: Column, spread: Column, unique_share: Column) -> Column:
    """0.4 (1 - overlap) + 0.3 entropy + 0.2 variance / (range^2 / 12), at most 1, + 0.1 share of unique sets."""
    uniform = F.when(spread > 0, F.least(F.lit(1.0), variance / (spread * spread / 12))).otherwise(0.0)
    return 0.4 * (1 - overlap) + 0.3 * entropy + 0.2 * uniform + 0.1 * unique_share


def weighted_draw(df: DataFrame, weight: Column, u: Column, by: list[str], k: int, tie: str) -> DataFrame:
    """k rows of each group drawn without replacement in proportion to weight: the smallest -ln(u) / weight."""
    key = -F.ln(u) / weight
    r = F.row_number().over(Window.partitionBy(*by).orderBy(F.round(key, 12), tie))
    return df.withColumn("__r", r).where(F.col("__r") <= k).drop("__r")


def hash_uniform(c: Column, modulus: int = 1000003) -> Column:
    """A number in (0, 1) by multiplicative hashing, the same in any SQL engine."""
    return ((c * 2654435761) % modulus + 0.5) / modulus


def shared_learning(local: DataFrame, rate: float, by: str = "feature_id", value: str = "score") -> DataFrame:
    """local values drawn towards the mean over all trees."""
    return local.withColumn("shared", (1 - rate) * F.col(value) + rate * F.avg(value).over(Window.partitionBy(by)))


def replay_weights(df: DataFrame, error: Column, alpha: float = 0.6, beta: float = 0.4, epsilon: float = 1e-6) -> DataFrame:
    """df with sampling probability (|error| + eps)^alpha / sum, and importance weight (n p)^-beta over its largest."""
    total = F.broadcast(df.agg(F.sum(F.pow(F.abs(error) + epsilon, F.lit(alpha))).alias("__t"), F.count(F.lit(1)).alias("__n"), F.min(F.pow(F.abs(error) + epsilon, F.lit(alpha))).alias("__low")))
    p = F.pow(F.abs(error) + epsilon, F.lit(alpha)) / F.col("__t")
    # the largest weight belongs to the smallest probability
    w = F.pow(F.col("__n") * p, F.lit(-beta)) / F.pow(F.col("__n") * F.col("__low") / F.col("__t"), F.lit(-beta))
    return df.crossJoin(total).withColumn("probability", p).withColumn("importance", w).drop("__t", "__n", "__low")


def jittered_minority(df: DataFrame, cls: Column, value: str, id: str, scale: float = 0.1, copies: int = 1) -> DataFrame:
    """df and ``copies`` of each minority row with its value moved by up to ``scale`` of itself, drawn by hash."""
    marked = df.withColumn("__m", cls.cast("int"))
    n = F.broadcast(marked.agg((F.avg("__m") <= 0.5).alias("__ones")))
    minority = marked.crossJoin(n).where((F.col("__m") == 1) == F.col("__ones"))
    moved = minority.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn(value, F.col(value) * (1 + scale * (2 * hash_uniform(F.col(id) * 31 + F.col("copy")) - 1)))
    return marked.withColumn("copy", F.lit(0)).drop("__m").unionByName(moved.drop("__m", "__ones"))


def logistic_by_gradient(df: DataFrame, names: list[str], label: Column, steps: int = 10, rate: float = 0.1, decay: float = 0.999) -> list[float]:
    """Weights (the last is the bias) by full-batch steps, each one aggregate over the few columns that are written first."""
    df = stored(df.select(*names, label.cast("double").alias("__y")), "gradient").where("__y is not null")
    m = df.agg(*[F.avg(c).alias(f"{c}#m") for c in names], *[F.stddev_samp(c).alias(f"{c}#s") for c in names]).first()
    x = [(F.col(c) - float(m[f"{c}#m"])) / float(m[f"{c}#s"] or 1.0) for c in names] + [F.lit(1.0)]
    w = [0.0] * len(x)
    for _ in range(steps):
        p = 1 / (1 + F.exp(-sum((a * b for a, b in zip(w, x)), F.lit(0.0))))
        g = df.agg(*[F.avg((F.col("__y") - p) * c).alias(f"g{i}") for i, c in enumerate(x)]).first()
        w = [decay * a + rate * float(d) for a, d in zip(w, g)]
    return w
