"""Embedding whitening by shifted CholeskyQR (operator 11).

Each entry c becomes the whole number floor(scale * c), so that sums are exact and
equal vectors are found by comparison.  The model is fitted on every distinct
vector once.  Its centred rows A = QR are orthogonalised by passes over the
written fit list: a task takes its rows through the triangular solves of all
factors so far, one after the other, and emits its share of the Gram matrix;
Spark adds the shares entry by entry, and the driver factors the d x d sum.
The first passes add a shift to the Gram matrix, which keeps the Cholesky
factor real for ill-conditioned rows; the passes end when the Gram matrix is the
identity to rounding.  R is the product of the factors, and the SVD of R gives
the directions and variances of the covariance without ever squaring the
condition number of the data.  Where the rows have no full rank, Q never gets
orthonormal in the missing directions; there the last factor is the symmetric
root of the last Gram matrix, and directions without variance are no components.

What the driver and a task hold is d x d; every pass maps rows without moving
them, and shuffles d(d+1)/2 numbers a task.

Defined results: rows whose vector is null, empty or holds null or non-finite
entries are dropped, and so are vectors of another length than the commonest
(of equally common lengths the larger); rows with equal vectors get equal
results, and ties of variance are numbered as the SVD gives them; repeated rows
and null ids are returned each; an empty table, one distinct vector or vectors
without variance have no component and so no rows; of fewer components with
variance than asked for, those are returned; a deviation beyond a long is null;
columns other than the id and the vector are kept unless they are named like an
output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .durable import remove, scratch_path, written
from .rows import need, others
from .textkit import tidy

#: Passes of the orthogonalisation, at most; three do for any rows of full rank.
PASSES = 6
#: Rows of a vector column that a task works on at once.
BLOCK = 4096
#: A direction with less than this share of the largest variance is rounding, not data.
LEAST_VARIANCE = 1e-18
OUTPUTS = {"component": T.IntegerType(), "n": T.LongType(), "deviation": T.LongType(), "whitened": T.DoubleType(), "explained": T.DoubleType(), "variance": T.DoubleType(), "identity_error": T.DoubleType()}


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of ``width`` whole numbers a row as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, matrix(part.column("x"), width)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """(n x - S) / n, exact up to the division where a long holds n x, else to a double's precision."""
    if np.abs(x).max(initial=0) < (1 << 62) // max(n, 1):
        return (n * x - sums) / n
    return x - sums / n


def solved(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Y of Y R = A for an upper triangular R, column by column over all rows at once."""
    y = np.empty_like(a)
    for j in range(a.shape[1]):
        y[:, j] = (a[:, j] - y[:, :j] @ r[:j, j]) / r[j, j]
    return y


def upper(gram: np.ndarray) -> np.ndarray:
    return gram[np.triu_indices(len(gram))]


def squared(values: np.ndarray, width: int) -> np.ndarray:
    """The symmetric matrix with the given upper triangle."""
    out = np.zeros((width, width))
    out[np.triu_indices(width)] = values
    return out + np.triu(out, 1).T


def summed(rows: DataFrame, width: int, share: Callable[[np.ndarray], np.ndarray], exact: bool = False) -> np.ndarray:
    """The sum over all rows' blocks of ``share``, entry by entry: a row an entry and task is shuffled."""
    kind = "long" if exact else "double"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in blocks(batches, width):
            one = share(x)
            total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

    found = rows.select("x").mapInArrow(run, f"i long, v {kind}").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toArrow()
    return found.column("v").to_numpy()


@dataclass
class Whitening:
    """n distinct vectors of ``width`` entries with their sums; unit directions (columns), variances, the total variance."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    total: float
    error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.directions / np.sqrt(self.variances)


def factors(gram_of: Callable[[list[np.ndarray]], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(R, last Gram matrix): R is the product of the passes' triangular factors, the Gram matrix is that of the rows solved through all of them."""
    found: list[np.ndarray] = []
    product = None
    gram = gram_of(found)
    unit = np.finfo(float).eps / 2
    for k in range(PASSES):
        d = len(gram)
        if k and np.abs(gram - np.eye(d)).max() < 64 * d * unit:
            break
        scale = np.linalg.norm(gram, 2)
        if not scale > 0:
            break
        # the shift of shifted CholeskyQR; later passes need it only where a factor fails
        shift = 11 * (d * n + d * (d + 1)) * unit * scale if not k else 0.0
        while True:
            try:
                r = np.linalg.cholesky(gram + shift * np.eye(d)).T
                break
            except np.linalg.LinAlgError:
                shift = max(4 * shift, 11 * d * (d + 1) * unit * scale)
        found.append(r)
        product = r if product is None else r @ product
        gram = gram_of(found)
    return (np.eye(len(gram)) if product is None else product), gram


def fit(rows: DataFrame, width: int, components: int) -> Whitening | None:
    """The whitening of a written table of distinct vectors x of ``width`` whole numbers; None where nothing varies."""
    sums = summed(rows, width, lambda x: np.r_[len(x), x.sum(axis=0)].astype(np.int64), exact=True)
    n, s = int(sums[0]), sums[1:]

    def gram_of(found: list[np.ndarray]) -> np.ndarray:
        def share(x: np.ndarray) -> np.ndarray:
            a = centred(x, n, s)
            for r in found:
                a = solved(a, r)
            return upper(a.T @ a)

        return squared(summed(rows, width, share), width)

    product, gram = factors(gram_of, n)
    # the last factor, near the identity: the Gram matrix's symmetric root
    values, vectors = np.linalg.eigh(gram)
    root = np.sqrt(np.maximum(values, 0))[:, None] * vectors.T
    _, sizes, directions = np.linalg.svd(root @ product)
    variances = sizes**2 / n
    real = np.flatnonzero(variances > LEAST_VARIANCE * max(variances.max(initial=0), 1e-300) * max(width, n))[:components]
    if not len(real):
        return None
    model = Whitening(n, s, directions[real].T, variances[real], float(variances.sum()))
    model.error = identity_error(rows, width, model)
    return model


def identity_error(rows: DataFrame, width: int, model: Whitening) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity; its mean is taken off before multiplying."""
    k = len(model.variances)
    mean = summed(rows, width, lambda x: model.project(x).sum(axis=0)) / model.n

    def share(x: np.ndarray) -> np.ndarray:
        z = model.project(x) - mean
        return upper(z.T @ z)

    return float(np.abs(squared(summed(rows, width, share), k) / model.n - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """The sum over the entries of (n x - S)^2 of every row, in whole numbers; null beyond a long."""
    bound = n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0))
    if bound * bound * max(1, x.shape[1]) < 1 << 63:
        d = n * x - sums
        return pa.array((d * d).sum(axis=1), pa.int64())
    s = [int(v) for v in sums]
    exact = [sum((n * int(v) - t) ** 2 for v, t in zip(row, s)) for row in x]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def whiten(df: DataFrame, vector: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """A row for each usable row of df and component: df's other columns, and OUTPUTS."""
    need(df, vector)
    spark, kept = df.sparkSession, [c for c in others(df, *OUTPUTS, "x") if c != vector]
    entries = F.col(f"`{vector}`").cast("array<double>")
    whole = F.transform(entries, lambda c: F.floor(c * scale))
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = df.select(*[F.col(f"`{c}`") for c in kept], F.when(F.coalesce(finite, F.lit(False)) & (F.size(entries) > 0), whole).alias("x")).where("x is not null")
    widths = usable.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    schema = T.StructType([*df.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, *[T.StructField(k, t) for k, t in OUTPUTS.items()]])
    width = widths["width"] if widths else 0
    usable = usable.where(F.size("x") == width)
    model = None
    if width:
        path = scratch_path(spark, "vectors")
        try:
            # rows of copies are one row a task before the shuffle
            model = fit(written(usable.select("x").distinct(), "vectors", path), width, components)
        finally:
            remove(spark, path)
    if model is None:
        return spark.createDataFrame([], schema)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.variances)
        for part, x in blocks(batches, width):
            z, d, m = model.project(x), deviations(x, model.n, model.sums), len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            one = lambda v: pa.array(np.tile(v, m))
            columns = [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), d.take(each), pa.array(z.reshape(-1)), one(model.variances / model.total), one(model.variances), pa.array(np.full(m * k, model.error))]
            yield pa.RecordBatch.from_arrays([*[part.column(i).take(each) for i in range(len(kept))], *columns], names=[*kept, *OUTPUTS])

    return usable.select(*kept, "x").mapInArrow(run, schema)
