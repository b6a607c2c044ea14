"""Rolling and ordered computations over series.

Every series has keys (``by``): a window runs within a key, so a long table
spreads over its keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import positioned


def last_rows(by: list[str], order: list[str], n: int) -> WindowSpec:
    """The row and the n - 1 before it."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), 0)


def slopes(y: pa.Array, x: pa.Array) -> pa.Array:
    """Least-squares slopes of lists of y over lists of x, null under two values or equal x.

    Means and sums of products are carried from value to value, so a long series loses no digits to the size of its x;
    the sum of products takes each product unrounded, as DuckDB's regr_slope does, so that a
    slope on a threshold falls to the same side.
    """
    bounds, n = x.offsets.to_numpy(), np.diff(x.offsets.to_numpy())
    ys, xs = y.values.to_numpy(zero_copy_only=False)[y.offsets.to_numpy()[0] :], x.values.to_numpy(zero_copy_only=False)[bounds[0] :]
    first = bounds[:-1] - bounds[0]
    mean_x, mean_y, products, squares = (np.zeros(len(n)) for _ in range(4))
    for k in range(int(n.max(initial=0))):
        at = np.flatnonzero(n > k)
        u, v = xs[first[at] + k], ys[first[at] + k]
        d = u - mean_x[at]
        new_x, new_y = mean_x[at] + d / (k + 1), mean_y[at] + (v - mean_y[at]) / (k + 1)
        products[at] = fused(d, v - new_y, products[at])
        squares[at] += (u - new_x) * d
        mean_x[at], mean_y[at] = new_x, new_y
    known = (n > 1) & (squares > 0)
    return pa.array(np.divide(products / np.maximum(n, 1), squares / np.maximum(n, 1), out=np.zeros(len(n)), where=known), mask=~known)


def fused(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """a b + c with the product's rounding error made good."""

    def halves(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = 134217729.0 * v
        high = t - (t - v)
        return high, v - high

    p, (ah, al), (bh, bl) = a * b, halves(a), halves(b)
    low = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    s = c + p
    z = s - c
    return s + (((c - (s - z)) + (p - z)) + low)


def slope(y: Column, x: Column, w: WindowSpec) -> Column:
    """Least-squares slope over a window of few rows, null under two rows or equal x."""
    both = x.isNotNull() & y.isNotNull()
    lists = [F.collect_list(F.when(both, c.cast("double"))).over(w) for c in (y, x)]
    return F.arrow_udf(slopes, "double")(*lists)


def rolling_correlation(a: Column, b: Column, w: WindowSpec) -> Column:
    """Pearson correlation over a window, null where a side is constant."""
    va, vb = F.var_pop(a).over(w), F.var_pop(b).over(w)
    return F.when((va > 1e-12) & (vb > 1e-12), F.covar_pop(a, b).over(w) / F.sqrt(va * vb))


def runs(df: DataFrame, flag: Column, by: list[str], order: list[str]) -> DataFrame:
    """df with ``run``: the number of consecutive rows, up to this one, where the flag holds."""
    w = Window.partitionBy(*by).orderBy(*order)
    broken = F.sum(F.when(flag, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__b", broken).withColumn("run", F.when(flag, F.row_number().over(Window.partitionBy(*by, "__b").orderBy(*order)) - F.when(F.col("__b") > 0, 1).otherwise(0)).otherwise(0).cast("long")).drop("__b")


def rolling_anomaly(c: Column, by: list[str], order: list[str], n: int = 50, least: int = 10, limit: float = 2.0) -> Column:
    """|c - mean| / deviation of the n rows before is above the limit, given enough of them."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-n, -1)
    s = F.stddev_samp(c).over(w)
    return F.coalesce((F.count(c).over(w) >= least) & (s > 0) & (F.abs(c - F.avg(c).over(w)) > limit * s), F.lit(False))


def smoothed(df: DataFrame, column: str, by: list[str], order: str, alpha: float = 0.3, output: str = "smooth") -> DataFrame:
    """Exponential smoothing s = alpha x + (1 - alpha) s within a key, from the first value; a missing value gives 0 and starts anew.

    The rows stream past in order, the last value of a key being carried from
    batch to batch, so a long series needs no more memory than a short one.
    """
    rows = df.select(*by, order, F.col(column).cast("double").alias("__x")).repartition(*by).sortWithinPartitions(*by, order)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(output, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for b in batches:
            if not len(b):
                continue
            keys = list(zip(*(b[c].tolist() for c in by)))
            x = b["__x"].to_numpy(dtype=float)
            fresh = np.array([k != p for k, p in zip(keys, [key, *keys[:-1]])])
            starts = np.flatnonzero(fresh | np.isnan(x) | np.r_[last is None, np.isnan(x[:-1])] | (np.arange(len(x)) == 0))
            out = np.zeros(len(x))
            for lo, hi in zip(starts, [*starts[1:], len(x)]):
                carried = lo == 0 and not fresh[0] and last is not None and not np.isnan(x[0])
                part = np.r_[last, x[lo:hi]] if carried else x[lo:hi]
                if not np.isnan(part[0]):
                    out[lo:hi] = pd.Series(part).ewm(alpha=alpha, adjust=False).mean().to_numpy()[int(carried) :]
            key, last = keys[-1], None if np.isnan(x[-1]) else out[-1]
            yield b[[*by, order]].assign(**{output: out})

    return rows.mapInPandas(run, schema)


def interpolated(df: DataFrame, column: str, x: str, by: list[str]) -> Column:
    """Linear interpolation of nulls between their neighbours; ends take the nearest value."""
    before = Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*by).orderBy(x).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(column).isNotNull(), F.struct(F.col(x).cast("double").alias("x"), F.col(column).cast("double").alias("v")))
    a, b = F.last(at, True).over(before), F.first(at, True).over(after)
    between = a["v"] + (b["v"] - a["v"]) * (F.col(x) - a["x"]) / (b["x"] - a["x"])
    return F.coalesce(F.col(column).cast("double"), between, a["v"], b["v"])


def borda(rank: Column, by: list[str]) -> Column:
    """n - rank + 1 within the group."""
    return F.count(F.lit(1)).over(Window.partitionBy(*by)) - rank + 1


def mean_ranks(v: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties at their mean."""
    _, place, times = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(times) - (times - 1) / 2)[place]


def spearman_of(x: np.ndarray, y: np.ndarray) -> float:
    """Correlation of the mean ranks; 0 for a constant side or under two values."""
    if len(x) < 2:
        return 0.0
    a, b = mean_ranks(x), mean_ranks(y)
    a, b = a - a.mean(), b - b.mean()
    s = float(np.sqrt((a * a).sum() * (b * b).sum()))
    return float((a * b).sum()) / s if s > 0 else 0.0


def concordance(x: np.ndarray, y: np.ndarray, at: int, lo: int, hi: int) -> int:
    """Concordant minus discordant pairs of the value at a place with those from lo to before hi."""
    return int((np.sign(x[at] - x[lo:hi]) * np.sign(y[at] - y[lo:hi])).sum())


def rolling_ranks(df: DataFrame, by: list[str], order: list[str], a: str, b: str, n: int = 1000, every: int = 10, least: int = 10, chunk: int = 8192) -> DataFrame:
    """(by..., order..., position, n, spearman, kendall) of the last n rows of a key, at every ``every``-th from the ``least``-th on; Kendall's is tau-a.

    Rows get their positions in their key without a one-task window; a chunk
    of consecutive positions and the n - 1 rows before it are one group, so a long
    series spreads over tasks.  In a chunk the window slides: a row that
    comes or goes adds or takes away its concordances with those that stay.
    Rows without a or b don't count.
    """
    size = max(chunk, n)
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, *order, F.col(a).cast("double").alias("__a"), F.col(b).cast("double").alias("__b"))
    placed = positioned(rows, by, order)
    own = F.floor((F.col("position") - 1) / size)
    ahead = F.pmod(F.col("position") - 1, F.lit(size)) >= size - (n - 1)
    dealt = placed.withColumn("__c", F.explode(F.when(ahead, F.array(own, own + 1)).otherwise(F.array(own))))
    schema = T.StructType([*rows.schema.fields[:-2], *(T.StructField(k, t) for k, t in (("position", T.LongType()), ("n", T.LongType()), ("spearman", T.DoubleType()), ("kendall", T.DoubleType())))])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        x, y, at = (pdf[c].to_numpy() for c in ("__a", "__b", "position"))
        start, lo, score, out = int(pdf["__c"].iloc[0]) * size, 0, 0, []
        for i in range(len(x)):
            if i - lo >= n:
                score -= concordance(x, y, lo, lo + 1, i)
                lo += 1
            score += concordance(x, y, i, lo, i)
            m = i - lo + 1
            if at[i] > start and at[i] % every == 0 and m >= least:
                out.append((i, m, spearman_of(x[lo : i + 1], y[lo : i + 1]), 2 * score / (m * (m - 1)) if m > 1 else 0.0))
        picked, m, rho, tau = (np.array(v) for v in zip(*out)) if out else (np.empty(0, np.int64), [], [], [])
        return pdf.iloc[picked.astype(np.int64)][[*by, *order, "position"]].assign(n=m, spearman=rho, kendall=tau)

    return dealt.groupBy(*by, "__c").applyInPandas(run, schema)
