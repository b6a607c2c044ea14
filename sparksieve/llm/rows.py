"""Checks that operators make on their input's columns, and the size of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of an Arrow batch: with Spark's default of 10,000, documents would fill hundreds of MB.
BATCH_ROWS = 512
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def need(df: DataFrame, *names: str) -> None:
    """Raise a ValueError that names the columns which df lacks; hold the session's Arrow batches to BATCH_ROWS."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"input lacks the columns {missing}; it has {df.columns}")
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_SETTING)) <= BATCH_ROWS:
        conf.set(_SETTING, str(BATCH_ROWS))


def spare(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    found = f"__{name}"
    while found.lower() in taken:
        found += "_"
    return found


def others(df: DataFrame, *outputs: str) -> list[str]:
    """df's columns without those named like an output, in any case."""
    taken = {o.lower() for o in outputs}
    return [c for c in df.columns if c.lower() not in taken]


def aside(df: DataFrame, *outputs: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with its columns that are named like an output under spare names, and what gives a result df's own columns back."""
    keep = set(others(df, *outputs))
    names = {c: c if c in keep else spare(df, f"aside{i}") for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), lambda out: out.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])
