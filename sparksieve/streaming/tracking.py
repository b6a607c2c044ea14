"""Predictions and outcomes as they come: the quality of a key's latest ones, kept by a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.windows import spearman_of

METRICS = ("pearson", "spearman", "kendall", "mae", "rmse")
#: Stateful processors keep their state in this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def kendall_of(x: np.ndarray, y: np.ndarray) -> float:
    """Kendall's tau-a."""
    if len(x) < 2:
        return 0.0
    score = sum(int((np.sign(x[i] - x[:i]) * np.sign(y[i] - y[:i])).sum()) for i in range(1, len(x)))
    return 2 * score / (len(x) * (len(x) - 1))


def quality(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """METRICS of predictions and outcomes; correlations of a constant side are 0."""
    a, b, e = x - x.mean(), y - y.mean(), x - y
    s = float(np.sqrt((a * a).sum() * (b * b).sum()))
    pearson = float((a * b).sum()) / s if s > 1e-12 else 0.0
    return pearson, spearman_of(x, y), kendall_of(x, y), float(np.abs(e).mean()), float(np.sqrt((e * e).mean()))


class Tracker(StatefulProcessor):
    """A ring of the last ``size`` pairs of each key, slot by slot, and how many came; metrics at every ``every``-th from the ``least``-th on."""

    def __init__(self, key: str, order: str, predicted: str, actual: str, size: int, every: int, least: int):
        self.key, self.order, self.predicted, self.actual = key, order, predicted, actual
        self.size, self.every, self.least = size, every, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", T.StructType([T.StructField("n", T.LongType())]))
        self.ring = handle.getMapState("ring", T.StructType([T.StructField("slot", T.LongType())]), T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows)).dropna(subset=[self.predicted, self.actual]).sort_values(self.order)
        before = int(self.count.get()[0]) if self.count.exists() else 0
        held = {int(k[0]): (float(v[0]), float(v[1])) for k, v in self.ring.iterator()} if before else {}
        n, out, changed = before, [], {}
        for at, x, y in zip(fresh[self.order], fresh[self.predicted], fresh[self.actual]):
            slot = n % self.size
            held[slot] = changed[slot] = (float(x), float(y))
            n += 1
            if n >= self.least and n % self.every == 0:
                pairs = np.array(list(held.values()))
                out.append((key[0], int(at), n, len(pairs), *quality(pairs[:, 0], pairs[:, 1])))
        # only the slots that got another pair are written
        for slot, pair in changed.items():
            self.ring.updateValue((slot,), pair)
        if n > before:
            self.count.update((n,))
        yield pd.DataFrame(out, columns=[self.key, self.order, "total", "n", *METRICS])

    def close(self) -> None:
        pass


def tracked(df: DataFrame, key: str, order: str, predicted: str, actual: str, size: int = 1000, every: int = 10, least: int = 10) -> DataFrame:
    """(key, order, total, n, METRICS) of a stream of predictions and outcomes: rows of a batch count in the order of ``order`` (a long), batches as they come."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(order, T.LongType()), T.StructField("total", T.LongType()), T.StructField("n", T.LongType()), *(T.StructField(m, T.DoubleType()) for m in METRICS)])
    processor = Tracker(key, order, predicted, actual, size, every, least)
    return df.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")


def with_store(spark: SparkSession):
    """A context in which streams of the session keep their state where stateful processors need it."""
    from contextlib import contextmanager

    @contextmanager
    def held():
        name = "spark.sql.streaming.stateStore.providerClass"
        before = spark.conf.get(name, None)
        spark.conf.set(name, STORE)
        try:
            yield
        finally:
            if before is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, before)

    return held()
