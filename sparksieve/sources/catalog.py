"""The run catalogue: append-only Parquet tables, latest row by key, retention, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The catalogue's tables and their columns.
TABLES: dict[str, str] = {
    "result_runs": "run_id string, dataset string, status string, started timestamp, seconds double, written timestamp",
    "ensemble_config": "run_id string, key string, kind string, value string",
    "selected_features": "run_id string, feature string, rank long, score double",
    "ensemble_metrics": "run_id string, metric string, value double, written timestamp",
    "tree_statistics": "run_id string, tree_id long, visits long, depth long, best double",
    "consensus_history": "run_id string, iteration long, feature string, votes long",
    "performance_metrics": "run_id string, metric string, value double, written timestamp",
    "feature_validation": "run_id string, feature string, check string, passed boolean",
}


def append(df: DataFrame, root: str, table: str) -> None:
    """Append rows of the table's columns, in folders by run."""
    names = [c.strip().split(" ")[0] for c in TABLES[table].split(",")]
    df.select(*names).write.mode("append").partitionBy("run_id").parquet(f"{root}/{table}")


def load(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(f"{root}/{table}")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of every key: an update is a later row, so there is no rewriting."""
    names = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*names), order).alias("r")).select(*keys, "r.*")


def config_rows(run_id: str, config: dict, spark: SparkSession) -> DataFrame:
    """(run_id, key, kind, value) of a flat configuration."""
    kind = lambda v: "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "null" if v is None else "string" if isinstance(v, str) else "json"
    import json

    rows = [(run_id, k, kind(v), v if isinstance(v, str) else json.dumps(v)) for k, v in sorted(config.items())]
    return spark.createDataFrame(rows, TABLES["ensemble_config"])


def kept_latest(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows of every group."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def without_old_runs(runs: DataFrame, children: DataFrame, run_key: str, child_key: str, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Runs that started at the cutoff or later, and the children of those."""
    kept = runs.where(cutoff)
    return kept, children.join(kept.select(F.col(run_key).alias(child_key)), child_key, "left_semi")


def save_snapshot(df: DataFrame, root: str, iteration: int) -> None:
    """The state of a run at an iteration, a folder each; a repeated iteration replaces its own."""
    df.write.mode("overwrite").parquet(f"{root}/iteration={iteration}")


def snapshots(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All snapshots with their iteration."""
    return spark.read.schema(f"{schema}, iteration long").option("basePath", root).parquet(root)


def load_snapshot(spark: SparkSession, root: str, schema: str, iteration: int | None = None) -> DataFrame:
    """The state at an iteration, by default the last; the folders of others are not read."""
    every = snapshots(spark, root, schema)
    if iteration is None:
        iteration = every.agg(F.max("iteration")).first()[0]
    return every.where(F.col("iteration") == iteration)


def report_json(df: DataFrame) -> DataFrame:
    """One JSON text a row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def export_csv(df: DataFrame, path: str) -> None:
    """One file with a header; for rankings, which have a row a feature."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def prometheus(df: DataFrame, name: str, kind: str, labels: list[str], value: str) -> DataFrame:
    """Lines of the text exposition format, a row a sample."""
    label = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.regexp_replace(F.col(c).cast("string"), r'(["\\])', r"\\$1"), F.lit('"')) for c in labels])
    return df.select(F.concat(F.lit(f"{name}{{"), label, F.lit("} "), F.col(value).cast("string")).alias("line"), F.lit(f"# TYPE {name} {kind}").alias("header"))


def latex_row(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a LaTeX table."""
    from ..functions.scalars import latex_escaped

    return df.select(F.concat(F.concat_ws(" & ", *[latex_escaped(F.col(c).cast("string")) for c in columns]), F.lit(r" \\")).alias("line"))


def html_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of an HTML table, their text escaped; null is empty."""
    text = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return df.select(F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), text(c), F.lit("</td>")) for c in columns], F.lit("</tr>")).alias("line"))


def export_html(df: DataFrame, columns: list[str], order: list[Column | str], title: str, path: str) -> None:
    """One HTML file with a table; for comparisons, which have a row a model."""
    spark = df.sparkSession
    # each call appends to one partition, in order
    body = html_rows(df.orderBy(*order).coalesce(1), columns)
    head = [f"<html><head><title>{title}</title></head><body><table>", "<tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"]
    whole = spark.createDataFrame([("\n".join(head),)], "line string").union(body).union(spark.createDataFrame([("</table></body></html>",)], "line string"))
    whole.coalesce(1).write.mode("overwrite").text(path)


def summary_lines(df: DataFrame, model: str, mean: str) -> DataFrame:
    """(place, line) of a comparison's ranking, a row a model."""
    place = F.row_number().over(Window.orderBy(F.desc(mean), model)).cast("long")
    return df.select(place.alias("place"), model, mean).select("place", F.format_string("%d. %s: %.4f", "place", model, mean).alias("line"))


def summary_text(df: DataFrame, model: str, mean: str) -> str:
    """A short report of a comparison: a row a model."""
    rows = df.orderBy(F.desc(mean), model).select(model, mean).collect()
    return "\n".join([f"{len(rows)} models compared", *[f"{i}. {r[model]}: {r[mean]:.4f}" for i, r in enumerate(rows, 1)]])
