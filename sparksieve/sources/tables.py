"""Reading source tables: projection, filters, paging by ranges, dataset configs."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import positioned

#: Settings of the three presets.
PRESETS: dict[str, dict[str, Any]] = {
    "fast": {"stage1_features": 20, "trees": 4, "iterations": 50, "folds": 3},
    "balanced": {"stage1_features": 50, "trees": 16, "iterations": 200, "folds": 5},
    "accurate": {"stage1_features": 100, "trees": 64, "iterations": 1000, "folds": 10},
}


@dataclass(frozen=True)
class DatasetSpec:
    """What a dataset is: its table, id columns, target and kind of problem."""

    name: str
    table: str
    target: str
    id_columns: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    problem_type: str = "auto"
    settings: dict[str, Any] = field(default_factory=dict)

    def with_preset(self, preset: str) -> DatasetSpec:
        return replace(self, settings=merged(PRESETS[preset], self.settings))


def merged(base: dict, override: dict) -> dict:
    """base with override's values, dictionaries merged in depth."""
    out = dict(base)
    for k, v in override.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def lookup(config: dict, keys: list[str], default: Any = None) -> Any:
    """Nested value by a path of keys."""
    for k in keys:
        if not isinstance(config, dict) or k not in config:
            return default
        config = config[k]
    return config


def read_config(spark: SparkSession, path: str) -> dict:
    """A YAML or JSON file from any store that Spark reads, with the preset that its ``mode`` names merged over it."""
    text = "\n".join(r[0] for r in spark.read.option("wholetext", "true").text(path).collect())  # one small file
    try:
        config = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path} is no JSON, and there is no YAML library here") from e
        config = yaml.safe_load(text)
    if not isinstance(config, dict):
        raise ValueError(f"{path} holds no settings by name")
    preset = lookup(config, ["presets", config.get("mode", "balanced")])
    return merged(config, preset) if preset else config


def config_table(spark: SparkSession, config: dict) -> DataFrame:
    """(key, value): the leaves of a config by their dotted paths, values as JSON text."""

    def leaves(node: Any, path: tuple[str, ...]) -> list[tuple[str, str]]:
        if isinstance(node, dict):
            return [x for k, v in node.items() for x in leaves(v, (*path, str(k)))]
        return [(".".join(path), json.dumps(node))]

    return spark.createDataFrame(leaves(config, ()), "key string, value string")


def find_metadata(spark: SparkSession, train: str) -> str | None:
    """The metadata file of a training table: metadata.json or the first *_metadata.json in its folder, then the first *_metadata.json one and two folders up."""
    path = spark._jvm.org.apache.hadoop.fs.Path(train).getParent()
    for up in range(3):
        if path is None:
            return None
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isFile()) if fs.exists(path) else []
        found = [n for n in names if n == "metadata.json" and not up] + [n for n in names if n.endswith("_metadata.json")]
        if found:
            return f"{path.toString()}/{found[0]}"
        path = path.getParent()
    return None


def spec_faults(spec: DatasetSpec, df: DataFrame) -> list[str]:
    """What is wrong with a spec for a table: names that it lacks, roles that clash, nothing left to learn from."""
    roles = {"id": spec.id_columns, "excluded": spec.excluded, "target": (spec.target,) if spec.target else ()}
    faults = [f"{role} column {c} is not in {spec.table}" for role, names in roles.items() for c in names if c not in df.columns]
    if not spec.target:
        faults.append("no target column is named")
    if spec.target and spec.target in (*spec.id_columns, *spec.excluded):
        faults.append(f"target column {spec.target} is an id or excluded")
    left = {*spec.id_columns, *spec.excluded, spec.target}
    if not any(isinstance(f.dataType, T.NumericType) and f.name not in left for f in df.schema.fields):
        faults.append("no numeric column is left as a feature")
    return faults


def spec_from_config(config: dict) -> DatasetSpec:
    """A spec out of a parsed YAML or JSON config; the training feature table wins over the plain one."""
    table = lookup(config, ["feature_tables", "train_features"]) or lookup(config, ["tables", "train"])
    if not table:
        raise ValueError("the config names no training table")
    return DatasetSpec(config["name"], table, config["target_column"], tuple(config.get("id_columns", ())), tuple(config.get("excluded_columns", ())), config.get("problem_type", "auto"), config.get("settings", {}))


def spec_from_metadata(row: dict) -> DatasetSpec:
    """A spec out of a metadata row whose lists are JSON text; nulls are empty."""
    names = lambda v: tuple(json.loads(v)) if v else ()
    return DatasetSpec(row["table_name"], row["table_name"], row.get("target_column") or "", names(row.get("id_columns")), names(row.get("excluded_columns")))


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | str | None = None, fmt: str = "parquet", **options: str) -> DataFrame:
    """A file table with projection and filter pushed down; fmt is any of Spark's (parquet, csv, json, jdbc)."""
    df = spark.read.format(fmt).options(**options).load(path)
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def page(df: DataFrame, order: str, after: Any, limit: int) -> DataFrame:
    """The next rows by key after ``after``: a range filter and a top-k, not an offset."""
    rest = df if after is None else df.where(F.col(order) > after)
    return rest.orderBy(order).limit(limit)


def row_count(df: DataFrame, where: Column | str | None = None) -> DataFrame:
    """One row: how many rows of a table pass the filter."""
    return (df if where is None else df.where(where)).agg(F.count(F.lit(1)).alias("rows"))


def chunk_rows(n_features: int, rows: Column, memory_gb: float) -> Column:
    """``chunk_size`` of a column of row counts."""
    return F.greatest(F.lit(1), F.least(rows, F.greatest(F.lit(1000), F.least(F.lit(100_000), F.lit(int(0.1 * memory_gb * 1e9 / (8 * n_features + 100))))))).cast("long")


def feature_columns(df: DataFrame, spec: DatasetSpec) -> list[str]:
    """The numeric columns of df that are no id, not excluded and not the target; a ValueError names what the spec has and df lacks."""
    if missing := [c for c in (*spec.id_columns, *spec.excluded, spec.target) if c and c not in df.columns]:
        raise ValueError(f"{spec.table} lacks the columns {missing}")
    left = {*spec.id_columns, *spec.excluded, spec.target}
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in left]


def chunk_size(n_features: int, n_rows: int, memory_gb: float) -> int:
    """Rows of a chunk within a tenth of the memory, between 1,000 and 100,000."""
    rows = int(0.1 * memory_gb * 1e9 / (8 * n_features + 100))
    return max(1, min(n_rows, max(1000, min(100_000, rows))))


def problem_type(df: DataFrame, target: str) -> str:
    """binary_classification, classification (up to 20 values) or regression."""
    n = df.select(target).where(F.col(target).isNotNull()).distinct().limit(21).count()
    return "binary_classification" if n <= 2 else "classification" if n <= 20 else "regression"


def batches(df: DataFrame, order: str, size: int, shuffled: bool = False, seed: int = 0) -> DataFrame:
    """df with ``batch``, from 0: consecutive runs of ``size`` rows by order, or by a seeded hash of it."""
    keys = [F.xxhash64(F.col(order), F.lit(seed)), F.col(order)] if shuffled else [F.col(order)]
    return positioned(df, [], keys).withColumn("batch", F.floor((F.col("position") - 1) / size)).drop("position")


def compared(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 1e-4) -> DataFrame:
    """One row: rows of both, of one only, the largest absolute and relative difference, and whether either is within the tolerance everywhere and no row is alone."""
    both = a.select(*keys, F.col(value).cast("double").alias("__a"), F.lit(1).alias("__ina")).join(b.select(*keys, F.col(value).cast("double").alias("__b"), F.lit(1).alias("__inb")), keys, "full")
    apart = F.abs(F.col("__a") - F.col("__b"))
    alone = F.count_if(F.col("__ina").isNull() | F.col("__inb").isNull() | (F.col("__a").isNull() != F.col("__b").isNull()))
    out = both.agg(F.count(F.lit(1)).alias("rows"), alone.alias("alone"), F.coalesce(F.max(apart), F.lit(0.0)).alias("max_abs"), F.coalesce(F.max(apart / (F.abs("__b") + 1e-8)), F.lit(0.0)).alias("max_rel"))
    return out.withColumn("passed", (F.col("alone") == 0) & ((F.col("max_abs") < tolerance) | (F.col("max_rel") < tolerance)))


def chunk_gaps(chunks: DataFrame) -> DataFrame:
    """(offset, rows, contiguous) of chunk rows (offset, rows), in order."""
    from pyspark.sql import Window

    w = Window.orderBy("offset")  # a row a chunk
    return chunks.select("offset", "rows", F.coalesce(F.col("offset") == F.lag(F.col("offset") + F.col("rows")).over(w), F.lit(True)).alias("contiguous"))
