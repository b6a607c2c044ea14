"""Cleaning, imputation, encoding and checks of wide tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import positioned
from .quantiles import exact_quantiles

#: Fixed value: the multiplier of multiplicative hashing.
HASH_MULTIPLIER = 2654435761


def finite(c: Column) -> Column:
    """Null, NaN and infinities become 0."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def z_scores(df: DataFrame, names: list[str], least: float = 1e-10) -> DataFrame:
    """(x - mean) / sample deviation where the variance is above ``least``; one pass for the moments."""
    m = df.agg(*[F.avg(c).alias(f"{c}#m") for c in names], *[F.stddev_samp(c).alias(f"{c}#s") for c in names])
    j = df.crossJoin(F.broadcast(m))  # one row of moments
    out = {c: F.when(F.col(f"`{c}#s`") * F.col(f"`{c}#s`") > least, (F.col(c) - F.col(f"`{c}#m`")) / F.col(f"`{c}#s`")).otherwise(F.col(c)) for c in names}
    return j.select(*[out.get(c, F.col(c)).alias(c) for c in df.columns])


def impute(df: DataFrame, strategies: dict[str, str]) -> DataFrame:
    """Fill nulls by column: zero, mean, median, mode, skip (drop the row) or error."""
    aggs = {"mean": F.avg, "mode": lambda c: F.mode(c, True)}
    unknown = set(strategies.values()) - {*aggs, "median", "zero", "skip", "error"}
    if unknown:
        raise ValueError(f"unknown strategies: {sorted(unknown)}")
    need = {c: s for c, s in strategies.items() if s in aggs}
    if need:
        one = df.agg(*[aggs[s](F.col(c)).alias(f"{c}#f") for c, s in need.items()])
        df = df.crossJoin(F.broadcast(one))
    for c in [c for c, s in strategies.items() if s == "median"]:
        one = exact_quantiles(df, [], c, [0.5], "q").select(F.col("q")[0].alias(f"{c}#f"))
        df = df.crossJoin(F.broadcast(one))  # one row
    out = {}
    for c, s in strategies.items():
        if s in aggs or s == "median":
            out[c] = F.coalesce(F.col(c), F.col(f"`{c}#f`"))
        elif s == "zero":
            out[c] = F.coalesce(F.col(c), F.lit(0))
        elif s == "error":
            out[c] = F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null in {c}"))).otherwise(F.col(c))
        else:
            df = df.where(F.col(c).isNotNull())
    return df.select(*[out.get(c, F.col(c)).alias(c) for c in df.columns if not c.endswith("#f")])


def filled_forward(df: DataFrame, column: str, order: str, by: list[str]) -> DataFrame:
    """Nulls take the last value before them in their group."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def filled_backward(df: DataFrame, column: str, order: str, by: list[str]) -> DataFrame:
    """Nulls take the next value after them in their group."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(column, F.first(column, ignorenulls=True).over(w))


def without_constants(df: DataFrame, names: list[str], least: float = 1e-8) -> DataFrame:
    """df without the named columns whose deviation is at most ``least``."""
    s = df.agg(*[F.coalesce(F.stddev_samp(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in names]).first()
    return df.drop(*[c for c in names if s[c] <= least])


def codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): 0-based codes of the distinct non-null values in label order."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return positioned(values, [], ["value"], "code").withColumn("code", F.col("code") - 1)


def label_encoded(df: DataFrame, column: str) -> DataFrame:
    """df with ``<column>_code``; a missing value is -1."""
    c = codes(df, column)  # a written table: Spark broadcasts it while its files are small
    return df.join(c, df[column] == c["value"], "left").drop("value").withColumn("code", F.coalesce("code", F.lit(-1))).withColumnRenamed("code", f"{column}_code")


def one_hot(df: DataFrame, column: str, most: int = 1000) -> DataFrame:
    """df with a 0/1 column for each of at most ``most`` categories; more raise an error, since each is a column."""
    values = [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} categories")
    return df.select("*", *[F.coalesce((F.col(column) == v).cast("long"), F.lit(0)).alias(f"{column}_{v}") for v in values])


def ordinal(df: DataFrame, column: str) -> DataFrame:
    """df with ``<column>_ordinal``: code / (categories - 1)."""
    c = codes(df, column)
    last = F.broadcast(c.agg(F.greatest(F.lit(1), F.count(F.lit(1)) - 1).alias("last")))  # one row
    scaled = c.crossJoin(last).select("value", (F.col("code") / F.col("last")).alias(f"{column}_ordinal"))
    return df.join(scaled, df[column] == scaled["value"], "left").drop("value")


def hash_bucket(c: Column, dim: int) -> Column:
    """1-based bucket of multiplicative hashing."""
    return (c.cast("long") * HASH_MULTIPLIER) % dim + 1


def category_counts(df: DataFrame, names: list[str], most: int = 50) -> DataFrame:
    """(column, categorical, categories): whole non-negative numbers below ``most`` count max + 1 categories."""
    aggs = []
    for c in names:
        v = F.col(c).cast("double")
        aggs += [F.max(v).alias(f"{c}#h"), F.min(v).alias(f"{c}#l"), F.bool_and(v == F.floor(v)).alias(f"{c}#w")]
    parts = [F.struct(F.lit(c).alias("column"), (F.col(f"`{c}#w`") & (F.col(f"`{c}#l`") >= 0) & (F.col(f"`{c}#h`") < most)).alias("categorical"), (F.col(f"`{c}#h`") + 1).alias("h")) for c in names]
    one = df.agg(*aggs).select(F.explode(F.array(*parts)).alias("p")).select("p.*")
    return one.select("column", "categorical", F.when(F.col("categorical"), F.col("h").cast("long")).otherwise(0).alias("categories"))


def numeric_checks(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, nulls, non_finite, non_positive, constant)."""
    aggs = []
    for c in names:
        v = F.col(c).cast("double")
        aggs += [F.count_if(v.isNull()).alias(f"{c}#n"), F.count_if(F.isnan(v) | (F.abs(v) == float("inf"))).alias(f"{c}#i"), F.count_if(v <= 0).alias(f"{c}#p"), (F.coalesce(F.var_samp(v), F.lit(0.0)) <= 1e-16).alias(f"{c}#c")]
    parts = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}#n`").alias("nulls"), F.col(f"`{c}#i`").alias("non_finite"), F.col(f"`{c}#p`").alias("non_positive"), F.col(f"`{c}#c`").alias("constant")) for c in names]
    return df.agg(*aggs).select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def quality_gate(df: DataFrame, names: list[str], target: Column) -> DataFrame:
    """One row: bad values, constant columns, target deviation, class balance, passed."""
    checks = numeric_checks(df, names).agg(F.sum(F.col("nulls") + F.col("non_finite")).alias("bad_values"), F.count_if("constant").alias("constant_columns"))
    y = df.agg(F.coalesce(F.stddev_samp(target), F.lit(0.0)).alias("target_std"), F.avg(target).alias("balance"))
    both = checks.crossJoin(y)  # one row each
    return both.withColumn("passed", (F.col("bad_values") == 0) & (F.col("constant_columns") == 0) & (F.col("target_std") > 0) & F.col("balance").between(0.1, 0.9))


def inferred_type(df: DataFrame, column: str) -> DataFrame:
    """One row: the narrowest of Int, Float, Bool, DateTime (over 80 %), String that a text column's values have."""
    v = F.col(column)
    yes = lambda e: F.count_if(e.isNotNull())
    n = F.count(v)
    kind = (
        F.when(n == 0, "String")
        .when(yes(v.try_cast("bigint")) == n, "Int64")
        .when(yes(v.try_cast("double")) == n, "Float64")
        .when(F.count_if(F.lower(v).isin("true", "false", "t", "f", "yes", "no")) == n, "Bool")
        .when(yes(v.try_cast("timestamp")) > 0.8 * n, "DateTime")
        .otherwise("String")
    )
    return df.agg(F.lit(column).alias("column"), n.alias("present"), kind.alias("kind"))
