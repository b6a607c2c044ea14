"""One interface to fitted models: settings with checks, fit, predict with confidence, save, load, and ensembles of them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import remove, scratch
from . import search

#: Kinds of models: task -> kind of search.model.
KINDS = {"boosted": {"classification": "boosted", "regression": "boosted_regressor"}, "forest": {"classification": "forest", "regression": "forest_regressor"}, "linear": {"classification": "logistic", "regression": "linear"}}
#: What a parameter may be, in MLlib's names.
CHECKS: dict[str, tuple[Callable[[float], bool], str]] = {
    "maxDepth": (lambda v: v >= 0, "0 or more"),
    "stepSize": (lambda v: 0 < v <= 1, "in (0, 1]"),
    "numTrees": (lambda v: v > 0, "above 0"),
    "maxIter": (lambda v: v > 0, "above 0"),
    "subsamplingRate": (lambda v: 0 < v <= 1, "in (0, 1]"),
    "minInstancesPerNode": (lambda v: v >= 1, "1 or more"),
    "regParam": (lambda v: v >= 0, "0 or more"),
    "elasticNetParam": (lambda v: 0 <= v <= 1, "in [0, 1]"),
}


@dataclass(frozen=True)
class ModelConfig:
    """A kind of model, its task and parameters in MLlib's names; unknown kinds, tasks and parameters out of range are errors."""

    kind: str
    task: str = "classification"
    params: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in KINDS or self.task not in KINDS[self.kind]:
            raise ValueError(f"no such model: {self.kind} for {self.task}")
        for name, value in self.params.items():
            if name in CHECKS and not CHECKS[name][0](value):
                raise ValueError(f"{name} must be {CHECKS[name][1]}, not {value}")

    def updated(self, **params: float) -> ModelConfig:
        return ModelConfig(self.kind, self.task, self.params | params)

    def estimator(self):
        """search.model's estimator with the parameters set; one that it doesn't have is an error."""
        made = search.model(KINDS[self.kind][self.task])
        if unknown := [n for n in self.params if not made.hasParam(n)]:
            raise ValueError(f"{self.kind} has no parameters {unknown}")
        return made.copy({made.getParam(n): v for n, v in self.params.items()})


@dataclass
class Fitted:
    """A fitted model over named columns; ``spread`` is a regression's residual deviation on its training rows."""

    config: ModelConfig
    names: list[str]
    pipeline: object
    spread: float = 0.0

    def predict(self, df: DataFrame, level: float = 0.95) -> DataFrame:
        """df with prediction and confidence.

        Classification: the likeliest class, ``proba`` (an array, a class a place), confidence
        the largest of it.  Regression: ``low`` and ``high``, between which a value
        lies with the given probability, confidence the residual deviation.  Rows with a null feature are left out.
        """
        from pyspark.ml.functions import vector_to_array

        out = self.pipeline.transform(df)
        if self.config.task == "classification":
            proba = vector_to_array("probability")
            return out.select(*df.columns, "prediction", proba.alias("proba"), F.array_max(proba).alias("confidence"))
        z = NormalDist().inv_cdf((1 + level) / 2) * self.spread
        return out.select(*df.columns, "prediction", (F.col("prediction") - z).alias("low"), (F.col("prediction") + z).alias("high"), F.lit(self.spread).alias("confidence"))

    def importances(self) -> list[tuple[str, float]]:
        """(feature, importance): a tree model's own, or the absolute coefficients."""
        last = self.pipeline.stages[-1]
        values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
        return [(n, abs(float(v))) for n, v in zip(self.names, values.toArray())]

    def save(self, spark: SparkSession, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        meta = json.dumps({"kind": self.config.kind, "task": self.config.task, "params": self.config.params, "names": self.names, "spread": self.spread})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load(spark: SparkSession, path: str) -> Fitted:
    from pyspark.ml import PipelineModel

    meta = json.loads(spark.read.text(f"{path}/config").first()[0])
    return Fitted(ModelConfig(meta["kind"], meta["task"], meta["params"]), meta["names"], PipelineModel.load(f"{path}/pipeline"), meta["spread"])


def fit(config: ModelConfig, df: DataFrame, names: list[str], label: Column) -> Fitted:
    """The model of df's rows without null features or label."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    data = df.withColumn("label", label.cast("double")).where(F.col("label").isNotNull())
    stages = [VectorAssembler(inputCols=names, outputCol="features", handleInvalid="skip"), config.estimator()]
    out = Fitted(config, names, search.fitted_on(Pipeline(stages=stages), data))
    if config.task == "regression":
        out.spread = float(out.pipeline.transform(data).agg(F.sqrt(F.avg(F.pow(F.col("label") - F.col("prediction"), 2)))).first()[0] or 0.0)
    return out


def ensemble(fitted: list[Fitted], df: DataFrame, voting: str = "soft", weights: list[float] | None = None) -> DataFrame:
    """df with the ensemble's prediction: of classes the heaviest vote (hard) or largest mean probability (soft), the smallest class of equals; of numbers the weighted mean.

    All models score a row in one pass; nothing is shuffled.
    """
    w = weights or [1.0] * len(fitted)
    if len(w) != len(fitted) or len({f.config.task for f in fitted}) != 1:
        raise ValueError("an ensemble takes models of one task, and a weight for each")
    out = df
    for i, f in enumerate(fitted):
        one = f.predict(out)
        kept = [F.col("proba").alias(f"__p{i}")] if f.config.task == "classification" else []
        out = one.select(*out.columns, F.col("prediction").alias(f"__y{i}"), *kept)
    total = sum(w)
    if fitted[0].config.task == "regression":
        p = sum((F.col(f"__y{i}") * (x / total) for i, x in enumerate(w)), F.lit(0.0))
    else:
        size = F.size("__p0")
        votes = (lambda i, c: F.when(F.col(f"__y{i}") == c, 1.0).otherwise(0.0)) if voting == "hard" else (lambda i, c: F.element_at(f"__p{i}", c + 1))
        weight = F.transform(F.sequence(F.lit(0), size - 1), lambda c: sum((votes(i, c) * (x / total) for i, x in enumerate(w)), F.lit(0.0)))
        p = F.array_position(F.transform(weight, lambda v: F.round(v, 12)), F.array_max(F.transform(weight, lambda v: F.round(v, 12)))).cast("double") - 1
    return out.select(*df.columns, p.alias("prediction"))


def round_trip(f: Fitted, spark: SparkSession) -> Fitted:
    """f saved to a scratch folder and loaded again."""
    path = scratch(spark, "fitted")
    f.save(spark, path)
    try:
        return load(spark, path)
    finally:
        remove(spark, path)
