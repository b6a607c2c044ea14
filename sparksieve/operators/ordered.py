"""Positions and running totals over orders as long as the data, without one-task windows.

The rows are dealt into consecutive ranges of the order and written, so a
range stays what it is; windows run within a range, and what the ranges before
(or after) it add up to is one row a range and key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored

RANGE = "__range"


def ranged(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with ``__range``: the number of the range of the order that a row is in."""
    return stored(df.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id()), "ranged")


def scanned(rows: DataFrame, by: list[str], order: list[str | Column], outputs: dict[str, tuple[Callable, Column, bool]]) -> DataFrame:
    """rows of ``ranged(df, *by, *order)`` with running aggregates up to each row: name -> (F.sum, F.max or F.min, of, from the end).

    What runs from the end runs over the numbered rows backwards: a frame that ends at the last row is added up anew for each row, in quadratic time.
    """
    unbounded = (Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = Window.partitionBy(RANGE, *by).orderBy(*order)
    keys = [f"__k{i}" for i in range(len(by))]
    totals = rows.groupBy(F.col(RANGE).alias("__of_range"), *[F.col(b).alias(k) for b, k in zip(by, keys)]).agg(*[f(c).alias(f"__t_{n}") for n, (f, c, _) in outputs.items()])
    ranges = Window.partitionBy(*keys).orderBy("__of_range")
    outside = {n: f(f"__t_{n}").over(ranges.rowsBetween(1, unbounded[1]) if back else ranges.rowsBetween(unbounded[0], -1)) for n, (f, _, back) in outputs.items()}
    offsets = totals.select("__of_range", *keys, *[c.alias(f"__o_{n}") for n, c in outside.items()])
    backwards = Window.partitionBy(RANGE, *by).orderBy(F.desc("__n"))
    inside = [{f"__i_{n}": f(c).over((backwards if back else ahead).rowsBetween(unbounded[0], 0)) for n, (f, c, back) in outputs.items() if back == turn} for turn in (False, True)]
    numbered = rows.withColumns(inside[0] | ({"__n": F.row_number().over(ahead)} if inside[1] else {}))
    same = F.col(RANGE) == F.col("__of_range")
    for b, k in zip(by, keys):
        same &= F.col(b).eqNullSafe(F.col(k))
    both = numbered.withColumns(inside[1]).join(offsets, same)

    def merged(n: str, f: Callable) -> Column:
        a, b = F.col(f"__i_{n}"), F.col(f"__o_{n}")
        return a + F.coalesce(b, F.lit(0)) if f is F.sum else (F.greatest(a, b) if f is F.max else F.least(a, b))

    return both.select(*rows.columns, *[merged(n, f).alias(n) for n, (f, _, _) in outputs.items()])


def positioned(df: DataFrame, by: list[str], order: list[str | Column], output: str = "position") -> DataFrame:
    """df with the 1-based position of each row in its key's order; ties are numbered in any order."""
    rows = scanned(ranged(df, *by, *order), by, order, {output: (F.sum, F.lit(1).cast("long"), False)})
    return rows.drop(RANGE)
