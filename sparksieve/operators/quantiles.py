"""Exact quantiles of groups of any size, without a buffer of a group's values.

A mergeable sketch gives each quantile a bracket that surely holds it; a second
pass counts what lies below the brackets; a third keeps the brackets' values only, as
distinct values with counts, whose running totals lie in ranges (operators.ordered).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import ranged, scanned

#: The sketch's rank error is at most a share of 1 / ACCURACY.
ACCURACY = 1000
#: A group of so few values is its own bracket: there a rank is more than the bracket's slack.
FEW = 4 * ACCURACY


def exact_quantiles(df: DataFrame, by: list[str], value: str, at: list[float], output: str = "quantiles", small: bool = False) -> DataFrame:
    """(by..., output): the quantiles at the given shares, interpolated between neighbours; null values don't count, groups without values have nulls.

    ``small`` says that the groups are few (columns of a table), so that their brackets may be broadcast.
    """
    keys = [f"__g{i}" for i in range(len(by))]
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.col(value).cast("double").alias("__v"))
    error = 2 / ACCURACY
    shares = F.array(*[F.lit(max(0.0, p - error)) for p in at], *[F.lit(min(1.0, p + error)) for p in at])
    seen = rows.groupBy(*keys).agg(F.count("__v").alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), F.percentile_approx("__v", shares, ACCURACY).alias("__s"))
    edge = lambda i, p, end: F.when((F.col("__n") <= FEW) | F.lit(p <= error if end == "__min" else p >= 1 - error), F.col(end)).otherwise(F.col("__s")[i])
    brackets = seen.select(*keys, "__n", F.array(*[F.struct(F.lit(i).alias("k"), edge(i, p, "__min").alias("lo"), edge(len(at) + i, p, "__max").alias("hi")) for i, p in enumerate(at)]).alias("__b"))
    mark = F.broadcast if small else (lambda x: x)
    same = lambda a, b: [F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}")) for k in keys]
    aside = brackets.select(*[F.col(k).alias(f"b{k}") for k in keys], "__b")
    both = rows.where("__v is not null").join(mark(aside), same("", "b")) if keys else rows.where("__v is not null").crossJoin(F.broadcast(aside))
    below = both.groupBy(*keys).agg(*[F.count_if(F.col("__v") < F.col("__b")[i]["lo"]).alias(f"__below{i}") for i in range(len(at))])
    inside = both.select(*keys, "__v", F.explode(F.filter("__b", lambda b: (F.col("__v") >= b["lo"]) & (F.col("__v") <= b["hi"]))).alias("__x")).groupBy(*keys, F.col("__x.k").alias("__k"), "__v").agg(F.count(F.lit(1)).alias("__c"))
    run = scanned(ranged(inside, *keys, "__k", "__v"), [*keys, "__k"], ["__v"], {"__upto": (F.sum, F.col("__c"), False)})
    rank = seen.select(*[F.col(k).alias(f"n{k}") for k in keys], "__n").join(below.select(*[F.col(k).alias(f"w{k}") for k in keys], *[f"__below{i}" for i in range(len(at))]), [F.col(f"n{k}").eqNullSafe(F.col(f"w{k}")) for k in keys] or None)
    many = run.join(mark(rank), same("", "n") or None)
    before = F.element_at(F.array(*[F.col(f"__below{i}") for i in range(len(at))]), F.col("__k") + 1)
    place = (F.col("__n") - 1) * F.element_at(F.lit([float(p) for p in at]), F.col("__k") + 1)
    first, last = before + F.col("__upto") - F.col("__c"), before + F.col("__upto") - 1
    hit = lambda r: F.max(F.when((first <= r) & (last >= r), F.col("__v")))
    low = many.groupBy(*keys, "__k").agg(hit(F.floor(place)).alias("a"), hit(F.ceil(place)).alias("b"), F.first(place).alias("p"))
    each = low.select(*keys, "__k", (F.col("a") + (F.col("p") - F.floor("p")) * (F.col("b") - F.col("a"))).alias("q"))
    found = each.groupBy(*[F.col(k).alias(f"f{k}") for k in keys]).agg(F.map_from_entries(F.collect_list(F.struct("__k", "q"))).alias("__m"))
    out = seen.join(found, [F.col(k).eqNullSafe(F.col(f"f{k}")) for k in keys] or F.lit(True), "left")
    return out.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], F.array(*[F.col("__m")[F.lit(i)] for i in range(len(at))]).alias(output))
