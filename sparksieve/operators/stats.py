"""Univariate and bivariate feature statistics over the long relation.

Everything is a partial aggregate by feature, so a feature with all the rows is
no hot key.  Ranks are taken over distinct values, after counting them, range by range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import ranged, scanned
from ..shared import stored
from .quantiles import exact_quantiles

#: Sum of squares up to which a series counts as constant.
TINY = 1e-10


def moments(lf: DataFrame) -> DataFrame:
    """n, mean, sample and population variance and extremes of every feature."""
    v = F.col("value")
    return lf.groupBy("feature").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var_samp"), F.var_pop(v).alias("var_pop"), F.min(v).alias("low"), F.max(v).alias("high")
    )


def variance_scores(lf: DataFrame, least: float = 1e-6) -> DataFrame:
    """Sample variance, zeroed at or under the threshold, and the low-variance mark."""
    m = moments(lf)
    return m.select("feature", F.when(F.col("var_samp") > least, F.col("var_samp")).otherwise(0.0).alias("variance"), (F.col("var_samp") <= least).alias("low_variance"))


def _centred(lf: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Centred sums of x and y by group; covar and var aggregates are merged pairwise, so they stay accurate."""
    a, b = F.col(x), F.col(y)
    n = F.count(F.when(a.isNotNull() & b.isNotNull(), 1))
    return lf.where(a.isNotNull() & b.isNotNull()).groupBy(*by).agg(n.alias("n"), (F.covar_pop(a, b) * n).alias("sxy"), (F.var_pop(a) * n).alias("sxx"), (F.var_pop(b) * n).alias("syy"))


def guarded_correlation() -> Column:
    """sxy / sqrt(sxx * syy), 0 where either side is constant."""
    return F.when((F.col("sxx") > TINY) & (F.col("syy") > TINY), F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy"))).otherwise(0.0)


def pearson(lf: DataFrame, epsilon: float | None = None) -> DataFrame:
    """Correlation of every feature with y; epsilon gives the smoothed population form instead of the guard."""
    sums = _centred(lf, ["feature"], "value", "y")
    n = F.col("n")
    r = guarded_correlation() if epsilon is None else (F.col("sxy") / n) / F.sqrt((F.col("sxx") / n) * (F.col("syy") / n) + epsilon)
    return sums.select("feature", "n", r.alias("r"))


def correlation_pairs(lf: DataFrame, least: float = 0.0) -> DataFrame:
    """(f1, f2, r) of all pairs f1 < f2 with |r| >= least, over the samples that have both.

    One Gramian pass: a sample's values meet in one vector, a task adds up the
    products of its samples, centred at the features' means, and sends one row
    a pair, however many samples it has.
    """
    # a row a column of the table
    known = [(r["feature"], r["m"] or 0.0) for r in lf.groupBy("feature").agg(F.avg("value").alias("m")).orderBy("feature").collect()]
    names, means = [k for k, _ in known], np.array([m for _, m in known])
    places = lf.sparkSession.createDataFrame([(f, i) for i, f in enumerate(names)], "feature string, place int")
    vectors = lf.where("value is not null").join(F.broadcast(places), "feature").groupBy("sample_id").agg(F.collect_list("place").alias("places"), F.collect_list(F.col("value").cast("double")).alias("values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(names)
        n, s, q, p = (np.zeros((k, k)) for _ in range(4))
        for batch in batches:
            at, values = batch.column("places"), batch.column("values")
            row = np.repeat(np.arange(batch.num_rows), np.diff(at.offsets.to_numpy()))
            place = at.flatten().to_numpy()
            has, x = np.zeros((batch.num_rows, k)), np.zeros((batch.num_rows, k))
            has[row, place] = 1.0
            x[row, place] = values.flatten().to_numpy() - means[place]
            n, s, q, p = n + has.T @ has, s + x.T @ has, q + (x * x).T @ has, p + x.T @ x
        i, j = np.triu_indices(k, 1)
        label = pa.array(names, type=pa.string())
        sums = [pa.array(v) for v in (n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j])]
        yield pa.RecordBatch.from_arrays([label.take(pa.array(i)), label.take(pa.array(j)), *sums], names=["f1", "f2", "n", "sx", "sy", "qx", "qy", "p"])

    columns = ("n", "sx", "sy", "qx", "qy", "p")
    parts = vectors.select("places", "values").mapInArrow(run, "f1 string, f2 string, " + ", ".join(f"{c} double" for c in columns))
    sums = parts.groupBy("f1", "f2").agg(*[F.sum(c).alias(c) for c in columns]).where("n > 0")
    centred = sums.select("f1", "f2", (F.col("p") - F.col("sx") * F.col("sy") / F.col("n")).alias("sxy"), (F.col("qx") - F.col("sx") * F.col("sx") / F.col("n")).alias("sxx"), (F.col("qy") - F.col("sy") * F.col("sy") / F.col("n")).alias("syy"))
    return centred.select("f1", "f2", guarded_correlation().alias("r")).where(F.abs("r") >= least)


#: Features of a block of the matrix of pair sums.
PAIR_BLOCK = 256


def vector_pairs(df: DataFrame, vector: str, names: list[str], least: float = 0.0) -> DataFrame:
    """(f1, f2, r) of all pairs f1 < f2 of an array column's places with |r| >= least, over the rows that have both.

    The rows stay where they are.  A task holds one matrix of products, of
    values less the places' means, and three more only once it meets a row with a null or NaN; it
    sends the upper triangle in square blocks, which are added up block by block and
    turned into pairs where they are, a slice at a time.  Rows of another length don't count.
    """
    order = sorted(range(len(names)), key=lambda i: names[i])
    k, labels, place = len(names), pa.array([names[i] for i in order], type=pa.string()), np.array(order, dtype=np.int64)
    rows = df.select(F.transform(F.col(vector).cast("array<double>"), lambda x: F.coalesce(x, F.lit(float("nan")))).alias("x")).where(F.size("x") == k)

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, k)[:, place]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(k), np.zeros(k)
        for batch in batches:
            x = matrix(batch)
            n, s = n + (~np.isnan(x)).sum(axis=0), s + np.nansum(x, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(n), pa.array(s)], names=["i", "n", "s"])

    if not k:
        return df.sparkSession.createDataFrame([], "f1 string, f2 string, r double")
    # a row a place
    first = rows.mapInArrow(sums, "i long, n double, s double").groupBy("i").agg(F.coalesce(F.try_divide(F.sum("s"), F.sum("n")), F.lit(0.0)).alias("m")).orderBy("i").toArrow()
    means = first.column("m").to_numpy() if first.num_rows else np.zeros(k)
    cuts = [*range(0, k, PAIR_BLOCK), k]
    pairs = [(a, b) for a in range(len(cuts) - 1) for b in range(a, len(cuts) - 1)]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, whole, holes = np.zeros((k, k)), np.zeros(1 + 2 * k), None
        for batch in batches:
            x = matrix(batch) - means
            has = ~np.isnan(x)
            full = has.all(axis=1)
            y = x[full]
            p += y.T @ y
            whole += np.r_[len(y), y.sum(axis=0), (y * y).sum(axis=0)]
            if not full.all():
                h, z = has[~full].astype(float), np.where(has[~full], x[~full], 0.0)
                p += z.T @ z
                part = np.stack([h.T @ h, z.T @ h, (z * z).T @ h])
                holes = part if holes is None else holes + part
        out = [(-1, -1, whole.tobytes(), None)]
        for a, b in pairs:
            i, j = slice(cuts[a], cuts[a + 1]), slice(cuts[b], cuts[b + 1])
            more = None if holes is None else np.stack([holes[0][i, j], holes[1][i, j], holes[1][j, i].T, holes[2][i, j], holes[2][j, i].T]).tobytes()
            out.append((a, b, p[i, j].tobytes(), more))
        for row in out:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["a", "b", "p", "more"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, list] = {}
        for batch in batches:
            for a, b, *parts in zip(*(c.to_pylist() for c in batch.columns)):
                now = totals.setdefault((a, b), [None, None])
                for i, x in enumerate(parts):
                    if x is not None:
                        v = np.frombuffer(x)
                        now[i] = v if now[i] is None else now[i] + v
        for (a, b), (p, more) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((a, b, p.tobytes(), None if more is None else more.tobytes()), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["a", "b", "p", "more"])

    schema = "a int, b int, p binary, more binary"
    blocks = stored(rows.mapInArrow(products, schema).repartition("a", "b").mapInArrow(added, schema), "pair-blocks")
    head = blocks.where("a = -1").select("p").collect()  # a number a place
    whole = np.frombuffer(head[0]["p"]) if head else np.zeros(1 + 2 * k)
    n, s, q = whole[0], whole[1 : k + 1], whole[k + 1 :]

    def correlated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, p, more in zip(*(c.to_pylist() for c in batch.columns)):
                i, j = np.arange(cuts[a], cuts[a + 1]), np.arange(cuts[b], cuts[b + 1])
                shape = (len(i), len(j))
                extra = np.zeros((5, *shape)) if more is None else np.frombuffer(more).reshape(5, *shape)
                m = n + extra[0]
                safe = np.maximum(m, 1)
                sx, sy = s[i][:, None] + extra[1], s[j] + extra[2]
                sxy = np.frombuffer(p).reshape(shape) - sx * sy / safe
                sxx, syy = q[i][:, None] + extra[3] - sx * sx / safe, q[j] + extra[4] - sy * sy / safe
                good = (sxx > TINY) & (syy > TINY)
                r = np.where(good, sxy / np.sqrt(np.where(good, sxx * syy, 1.0)), 0.0)
                x, y = np.nonzero((i[:, None] < j) & (m > 0) & (np.abs(r) >= least))
                for lo in range(0, len(x), 1 << 16):
                    u, v = x[lo : lo + (1 << 16)], y[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([labels.take(pa.array(i[u])), labels.take(pa.array(j[v])), pa.array(r[u, v])], names=["f1", "f2", "r"])

    return blocks.where("a >= 0").mapInArrow(correlated, "f1 string, f2 string, r double")


def correlation_matrix(df: DataFrame, vector: str, names: list[str], method: str = "pearson") -> DataFrame:
    """(f1, f2, r) of an array column by MLlib's one-pass Gramian; the matrix is features x features."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Correlation

    spark = df.sparkSession
    matrix = Correlation.corr(df.select(array_to_vector(F.col(vector)).alias("v")), "v", method).first()[0].toArray()
    rows = [(names[i], names[j], float(matrix[i, j])) for i in range(len(names)) for j in range(i + 1, len(names))]
    return spark.createDataFrame(rows, "f1 string, f2 string, r double")


def mid_ranks(lf: DataFrame, column: str, by: str = "feature") -> DataFrame:
    """(by, column, rank): average rank of every distinct value."""
    counts = lf.groupBy(by, column).agg(F.count(F.lit(1)).alias("c"))
    run = scanned(ranged(counts, by, column), [by], [column], {"before": (F.sum, F.col("c"), False)})
    return run.select(by, column, (F.col("before") - F.col("c") + (F.col("c") + 1) / 2).alias("rank"))


def spearman(lf: DataFrame) -> DataFrame:
    """Rank correlation of every feature with y, ties at their average rank."""
    rx = mid_ranks(lf, "value").withColumnRenamed("rank", "rx")
    ry = mid_ranks(lf, "y").withColumnRenamed("rank", "ry")
    ranked = lf.join(rx, ["feature", "value"]).join(ry, ["feature", "y"])
    return _centred(ranked, ["feature"], "rx", "ry").select("feature", guarded_correlation().alias("rho"))


def kendall(lf: DataFrame) -> DataFrame:
    """Kendall tau-a of every feature with a y of few levels.

    Pairs are counted level by level out of running sums over the distinct
    values, never formed.
    """
    counts = lf.groupBy("feature", "value", "y").agg(F.count(F.lit(1)).alias("c"))
    levels = lf.select("feature", F.col("y").alias("upper")).distinct()
    grid = counts.join(levels, "feature").where("y < upper")
    below = grid.groupBy("feature", "upper", "value").agg(F.sum("c").alias("low"))
    above = counts.select("feature", "value", F.col("y").alias("upper"), F.col("c").alias("high"))
    both = below.join(above, ["feature", "upper", "value"], "full").na.fill(0, ["low", "high"])
    run = scanned(ranged(both, "feature", "upper", "value"), ["feature", "upper"], ["value"], {"less": (F.sum, F.col("low"), False), "more": (F.sum, F.col("low"), True)})
    # both running sums have the row's own count in them
    score = run.groupBy("feature").agg(F.sum(F.col("high") * (F.col("less") - F.col("more"))).alias("s"))
    n = lf.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    return score.join(n, "feature").select("feature", (F.col("s") / (F.col("n") * (F.col("n") - 1) / 2)).alias("tau"))


def fisher_width(r: Column, n: Column) -> Column:
    """Width of the 95 % confidence interval of a correlation."""
    z, half = F.atanh(r), 1.96 / F.sqrt(n - 3)
    return F.tanh(z + half) - F.tanh(z - half)


def profile(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row a column: type, rows, non-nulls, missing share, distinct values, extremes as text, mean."""
    names = names or df.columns
    numeric = set(numeric_names(df))
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in names:
        col = F.col(c)
        aggs += [F.count(col).alias(f"{c}#n"), F.countDistinct(col).alias(f"{c}#d"), F.avg(col.cast("double")).alias(f"{c}#m") if c in numeric else F.lit(None).cast("double").alias(f"{c}#m"), F.min(col).cast("string").alias(f"{c}#a"), F.max(col).cast("string").alias(f"{c}#z")]
    types = dict(df.dtypes)
    parts = [F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.col("rows"), F.col(f"`{c}#n`").alias("present"), F.col(f"`{c}#d`").alias("uniques"), F.col(f"`{c}#a`").alias("low"), F.col(f"`{c}#z`").alias("high"), F.col(f"`{c}#m`").alias("mean")) for c in names]
    one = df.agg(*aggs).select(F.explode(F.array(*parts)).alias("p")).select("p.*")
    return one.withColumn("missing_ratio", F.when(F.col("rows") > 0, 1 - F.col("present") / F.col("rows")).otherwise(0.0)).withColumn("high_cardinality", F.col("uniques") > 1000)


def numeric_names(df: DataFrame) -> list[str]:
    from .longform import numeric_columns

    return numeric_columns(df)


def mode(df: DataFrame, column: str) -> DataFrame:
    """The commonest value and its count, the smallest on ties."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("c"))
    return counts.orderBy(F.desc("c"), column).limit(1)


def percentiles(df: DataFrame, column: str, at: tuple[float, ...] = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """(q, value) by linear interpolation.

    The values are written first: where they come out of sums of doubles, each evaluation has other last digits, and a value
    would fall out of the brackets that another evaluation gave.
    """
    got = exact_quantiles(stored(df.select(column), "percentiles"), [], column, list(at), "p")
    return got.select(F.posexplode("p").alias("i", "value")).select(F.element_at(F.array(*[F.lit(float(q)) for q in at]), F.col("i") + 1).alias("q"), "value")


def correlation_buckets(scores: DataFrame, column: str = "score") -> DataFrame:
    """Number of positive scores in each fixed range, and their share."""
    # fixed values: the upper bounds of the ranges
    bounds = [0.05, 0.1, 0.15, 0.2, 0.3, 0.5]
    c = F.col(column)
    bucket = F.coalesce(*[F.when(c <= b, F.lit(i + 1)) for i, b in enumerate(bounds)], F.lit(len(bounds) + 1))
    return scores.where(c > 0).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
