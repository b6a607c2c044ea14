"""Structured Streaming forms of the incremental operators.

The accumulators of moments, correlations, histograms and windows are
algebraic, so they are plain streaming aggregates; only the ring buffer of the
latest values keeps arbitrary state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import information
from ..shared import scratch


def stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A table's Parquet file or folder as a stream, some files a batch."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name[:-1]}[{name[-1]}]")


def drained(df: DataFrame, name: str, mode: str) -> DataFrame:
    """What a stream has given when its input is used up; complete mode gives the last batch.

    Each batch has a folder of its own, so one that is tried again replaces itself.
    """
    spark = df.sparkSession
    out, state = scratch(spark, name), scratch(spark, f"{name}-state")
    schema = df.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    spark.createDataFrame([], schema).write.parquet(f"{out}/batch=-1")
    df.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    every = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).option("basePath", out).parquet(out)
    if mode != "complete":
        return every.drop("batch")
    return every.where(F.col("batch") == every.agg(F.max("batch")).first()[0]).drop("batch")


def drained_all(frames: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Several aggregates of one source, (frame, output mode) by name: their streams run side by side, and each gives what ``drained`` would."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(len(frames)) as pool:
        running = {name: pool.submit(drained, df, name, mode) for name, (df, mode) in frames.items()}
        return {name: f.result() for name, f in running.items()}


def moments(df: DataFrame, by: str, value: str) -> DataFrame:
    """Streaming n, mean, sample variance."""
    return df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))


def correlation(df: DataFrame, by: str, x: Column, y: Column) -> DataFrame:
    """Streaming Pearson correlation out of centred sums; 0 for a constant side."""
    s = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"))
    return s.select(by, "n", F.when((F.col("vx") > 1e-10) & (F.col("vy") > 1e-10), F.col("c") / F.sqrt(F.col("vx") * F.col("vy"))).otherwise(0.0).alias("r"))


def histogram(df: DataFrame, by: str, value: str, bounds: list[float]) -> DataFrame:
    """Streaming cumulative buckets: values at or below each bound."""
    return df.groupBy(by).agg(*[F.count_if(F.col(value) <= b).alias(f"le_{b:g}".replace(".", "_")) for b in bounds], F.count(value).alias("n"), F.sum(value).alias("total"))


def ring_buffer(df: DataFrame, key: str, order: str, value: str, size: int) -> DataFrame:
    """(key, n, mean, low): of the latest ``size`` values by order of each key, given at every batch."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for b in batches:
            held = sorted([*held, *zip(b[order].tolist(), b[value].tolist())])[-size:]
        values = [v for _, v in held]
        state.update(([int(o) for o, _ in held], [float(v) for v in values]))
        yield pd.DataFrame({key: [k[0]], "n": [len(held)], "mean": [sum(values) / len(values)], "low": [min(values)]})

    return df.groupBy(key).applyInPandasWithState(step, f"{key} long, n long, mean double, low double", "o array<long>, v array<double>", "update", GroupStateTimeout.NoTimeout)


def joint_counts(lf: DataFrame, edges: DataFrame, bins: int = 10) -> DataFrame:
    """Streaming (feature, bin, cls, c) of a long stream, for edges that a first pass has fixed; information.counted_information of them is the MI so far.

    The state has a row a feature, bin and class, however long the stream, and the
    counts don't depend on how it is cut into batches.
    """
    return information.joint_counts(information.with_equal_width(lf, bins, edges))
