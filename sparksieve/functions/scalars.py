"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def performance_weight(p: Column) -> Column:
    return sigmoid(5 * (p - 0.5))


def exploration_weight(depth: Column) -> Column:
    return F.least(F.lit(2.0), 1 + F.ln(F.greatest(F.lit(1), depth)) / 10)


def adaptive_weight(performance: Column, exploration: Column, diversity: Column, stability: Column) -> Column:
    return 0.4 * performance + 0.3 * exploration + 0.2 * diversity + 0.1 * stability


def decayed(weight: Column, rounds: Column, rate: float = 0.95) -> Column:
    return weight * F.pow(F.lit(rate), rounds)


def min_max(df: DataFrame, column: str, output: str) -> DataFrame:
    """(x - min) / (max - min) over the table, 1 where all are equal."""
    m = F.broadcast(df.agg(F.min(column).alias("__a"), F.max(column).alias("__b")))
    c, a, b = F.col(column), F.col("__a"), F.col("__b")
    return df.crossJoin(m).withColumn(output, F.when(b > a, (c - a) / (b - a)).otherwise(1.0)).drop("__a", "__b")


def min_max_over(c: Column, by: list[str]) -> Column:
    """The same within groups."""
    w = Window.partitionBy(*by)
    a, b = F.min(c).over(w), F.max(c).over(w)
    return F.when(b > a, (c - a) / (b - a)).otherwise(1.0)


def optional_string(c: Column) -> Column:
    """Blank text is null."""
    return F.nullif(F.trim(c), F.lit(""))


def json_strings(c: Column) -> Column:
    """A JSON array text as an array of strings."""
    return F.from_json(c, "array<string>")


def short_number(c: Column) -> Column:
    """12.3K, 4.5M, or one decimal."""
    one = lambda x: F.round(x, 1).cast("string")
    return F.when(c >= 1e6, F.concat(one(c / 1e6), F.lit("M"))).when(c >= 1e3, F.concat(one(c / 1e3), F.lit("K"))).otherwise(one(c))


def duration_text(seconds: Column) -> Column:
    """1h 2m, 3m 4s or 5s."""
    s = seconds.cast("long")
    part = lambda x, u: F.concat(F.floor(x).cast("string"), F.lit(u))
    return F.when(s >= 3600, F.concat(part(s / 3600, "h "), part((s % 3600) / 60, "m"))).when(s >= 60, F.concat(part(s / 60, "m "), part(s % 60, "s"))).otherwise(part(s, "s"))


def byte_text(n: Column) -> Column:
    """Bytes in B, KB, MB or GB with one decimal."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in ((1 << 10, "KB"), (1 << 20, "MB"), (1 << 30, "GB")):
        out = F.when(n >= k, F.concat(F.round(n / k, 1).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def latex_escaped(c: Column) -> Column:
    """Characters that LaTeX reserves, escaped."""
    return F.regexp_replace(F.regexp_replace(c, r"([&%$#_{}])", r"\\$1"), "~", r"\\textasciitilde{}")


def packed_index(i: Column, j: Column, n: int) -> Column:
    """1-based place of the pair i < j (0-based) in a packed upper triangle of n columns."""
    return F.floor(i * (2 * n - 1 - i) / 2) + (j - i - 1) + 1


def mask_indices(mask: Column, bits: int) -> Column:
    """1-based places of the set bits."""
    return F.filter(F.array(*[F.when(F.expr("true") & (F.shiftright(mask, b).bitwiseAND(F.lit(1)) == 1), F.lit(b + 1).cast("long")) for b in range(bits)]), lambda x: x.isNotNull())


def set_key(features: Column) -> Column:
    """Text key of a feature set: sorted distinct members."""
    return F.array_join(F.array_sort(F.array_distinct(features)), ",")


def sql_kind(declared: Column) -> Column:
    """A declared SQL type's kind by the words in its name."""
    d = F.upper(declared)
    has = lambda *w: F.greatest(*[d.contains(x).cast("int") for x in [*w, "\x00"]]) == 1
    return F.when(has("INT"), "Int64").when(has("REAL", "FLOAT", "DOUBLE", "NUMERIC", "DECIMAL"), "Float64").when(has("BLOB"), "Bytes").when(has("BOOL"), "Bool").otherwise("String")
