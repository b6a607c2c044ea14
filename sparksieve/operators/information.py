"""Binning, histograms, entropies and mutual information over the long relation.

Bin edges come from one aggregate a feature, joined back on the feature name
(features are columns: a broadcast of one row each); counts are partial
aggregates of (feature, bin, class), so the result is bounded by
features * bins * classes whatever the number of samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """1-based bin of floor((v - low) / width) + 1, the maximum in the last; a constant has bin 1."""
    width = (high - low) / bins
    return F.when(high <= low, F.lit(1)).otherwise(F.greatest(F.lit(1), F.least(F.floor((value - low) / width) + 1, F.lit(bins)))).cast("long")


def value_ranges(lf: DataFrame) -> DataFrame:
    """(feature, low, high)."""
    return lf.groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def with_equal_width(lf: DataFrame, bins: int = 10, edges: DataFrame | None = None) -> DataFrame:
    """lf with ``bin``, by the ranges of its own values or given ones (beyond which values fall into the first or last bin)."""
    edges = value_ranges(lf) if edges is None else edges
    return lf.join(F.broadcast(edges), "feature").withColumn("bin", equal_width_bin(F.col("value"), F.col("low"), F.col("high"), bins)).drop("low", "high")


def with_quantile_bins(lf: DataFrame, bins: int = 10) -> DataFrame:
    """lf with ``bin``: one more than the number of inner quantile edges below the value."""
    edges = exact_quantiles(lf, ["feature"], "value", [i / bins for i in range(1, bins)], "edges", small=True).withColumn("edges", F.array_distinct("edges"))
    return lf.join(F.broadcast(edges), "feature").withColumn("bin", (F.size(F.filter("edges", lambda e: e < F.col("value"))) + 1).cast("long")).drop("edges")


def with_z_bins(lf: DataFrame, bins: int = 10) -> DataFrame:
    """lf with ``bin``: the z-score in ``bins`` equal parts of [-3, 3], clamped."""
    edges = lf.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    z = F.when(F.col("s") > 0, (F.col("value") - F.col("m")) / F.col("s")).otherwise(0.0)
    return lf.join(F.broadcast(edges), "feature").withColumn("bin", F.greatest(F.lit(1), F.least(F.lit(bins), F.floor((z + 3) / 6 * bins) + 1)).cast("long")).drop("m", "s")


def with_edge_bins(lf: DataFrame, bins: int = 256, margin: float = 0.001) -> DataFrame:
    """lf with ``bin``: right-closed equal-width bins over the range widened by ``margin``."""
    edges = lf.groupBy("feature").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    span = F.when(F.col("b") > F.col("a"), F.col("b") - F.col("a")).otherwise(1.0)
    low, width = F.col("a") - margin * span, span * (1 + 2 * margin) / bins
    return lf.join(F.broadcast(edges), "feature").withColumn("bin", F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((F.col("value") - low) / width))).cast("long")).drop("a", "b")


def with_class_numbers(lf: DataFrame, cls: str = "y") -> DataFrame:
    """lf with its classes as numbers from 1, in their order; classes are few, so their numbers are broadcast."""
    known = lf.select(F.col(cls).alias("__c")).distinct().where("__c is not null")
    numbers = known.withColumn("__k", F.row_number().over(Window.orderBy("__c")))
    return lf.join(F.broadcast(numbers), F.col(cls) == F.col("__c")).withColumn(cls, F.col("__k").cast("long")).drop("__c", "__k")


def joint_counts(binned: DataFrame, cls: str = "y") -> DataFrame:
    """(feature, bin, cls, c)."""
    return binned.groupBy("feature", "bin", F.col(cls).alias("cls")).agg(F.count(F.lit(1)).alias("c"))


def mutual_information(binned: DataFrame, base: float | None = None, cls: str = "y") -> DataFrame:
    """Sum of p(x,y) ln(p(x,y) / p(x)p(y)) of every feature, at least 0; ``base`` divides by its logarithm."""
    return counted_information(joint_counts(binned, cls), base)


def counted_information(counts: DataFrame, base: float | None = None) -> DataFrame:
    """The same out of joint counts (feature, bin, cls, c)."""
    f = Window.partitionBy("feature")
    n, nx, ny = F.sum("c").over(f), F.sum("c").over(Window.partitionBy("feature", "bin")), F.sum("c").over(Window.partitionBy("feature", "cls"))
    parts = counts.select("feature", (F.col("c") / n * F.ln(F.col("c") * n / (nx * ny))).alias("part"))
    unit = F.lit(1.0) if base is None else F.ln(F.lit(float(base)))
    return parts.groupBy("feature").agg(F.greatest(F.lit(0.0), F.sum("part") / unit).alias("mi"))


def entropy(counted: DataFrame, by: str = "feature", count: str = "c", base: float | None = None) -> DataFrame:
    """Shannon entropy of the counts of every group."""
    p = F.col(count) / F.sum(count).over(Window.partitionBy(by))
    unit = F.lit(1.0) if base is None else F.ln(F.lit(float(base)))
    return counted.where(F.col(count) > 0).select(by, (-p * F.ln(p)).alias("part")).groupBy(by).agg((F.sum("part") / unit).alias("entropy"))


def smoothed_entropy(counted: DataFrame, bins: int, epsilon: float = 1e-10, by: str = "feature", count: str = "c") -> DataFrame:
    """Entropy in bits of (n + eps) / (N + eps * bins), the empty bins included."""
    total = counted.groupBy(by).agg(F.sum(count).alias("total"), F.count(F.lit(1)).alias("full"))
    rows = counted.join(total, by)
    p = (F.col(count) + epsilon) / (F.col("total") + epsilon * bins)
    empty = F.lit(epsilon) / (F.first("total") + epsilon * bins)
    return rows.groupBy(by).agg((F.sum(-p * F.log2(p)) - (bins - F.first("full")) * empty * F.log2(empty)).alias("entropy"))


def discrete_mi(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: MI, both entropies and the normalised MI of two discrete columns."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    n, na, nb = (F.sum("c").over(w) for w in (Window.partitionBy(F.lit(1)), Window.partitionBy("a"), Window.partitionBy("b")))
    p = c.select((F.col("c") / n).alias("p"), (na / n).alias("pa"), (nb / n).alias("pb"))
    s = p.agg(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("pa") * F.col("pb")))).alias("mi"), F.sum(-F.col("p") * F.ln("pa")).alias("ha"), F.sum(-F.col("p") * F.ln("pb")).alias("hb"))
    return s.select(F.greatest("mi", F.lit(0.0)).alias("mi"), "ha", "hb", (2 * F.col("mi") / (F.col("ha") + F.col("hb") + 1e-10)).alias("nmi"))
