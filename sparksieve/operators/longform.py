"""The canonical relation of feature statistics: (sample_id, feature, value, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Names of the numeric columns, booleans left out."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def feature_columns(df: DataFrame, ids: tuple[str, ...] = (), target: str | None = None, excluded: tuple[str, ...] = ()) -> list[str]:
    """Columns that are neither ids, target nor excluded; unknown names are an error."""
    named = {*ids, *excluded, *([target] if target else [])}
    if unknown := named - set(df.columns):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return [c for c in df.columns if c not in named]


def from_wide(df: DataFrame, sample_id: str, target: Column, features: list[str] | None = None) -> DataFrame:
    """Unpivot the numeric columns of a wide table; values become double."""
    names = features or numeric_columns(df, (sample_id,))
    wide = df.select(F.col(sample_id).alias("sample_id"), target.cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in names])
    return wide.unpivot(["sample_id", "y"], names, "feature", "value").select("sample_id", "feature", "value", "y")


def from_array(df: DataFrame, sample_id: str, vector: str, target: Column, prefix: str = "e") -> DataFrame:
    """Unpivot an array column; features are named e01, e02, ... by position."""
    rows = df.select(F.col(sample_id).alias("sample_id"), target.cast("double").alias("y"), F.posexplode(vector).alias("i", "v"))
    name = F.concat(F.lit(prefix), F.lpad((F.col("i") + 1).cast("string"), 2, "0"))
    return rows.select("sample_id", name.alias("feature"), F.col("v").cast("double").alias("value"), "y")
