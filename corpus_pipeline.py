"""The corpus pipeline: quality rules, line dedup, Jaccard join, decontamination, segmentation.

Every stage takes rows with the columns of documents, others included, and works
on all that its predecessor kept.  Null and empty texts fail the quality rules; a
later stage on its own keeps them: they have no lines, are in no group of copies,
hold no benchmark item and have the empty segmentation.  Rows with null or
reused ids are judged one by one by their texts; of repeated rows the Jaccard
stage keeps one; of tied ids the smaller text hash stays; an empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksieve.llm.decontam import decontaminated
from sparksieve.llm.durable import remove, scratch_path, written
from sparksieve.llm.jaccard import one_of_each
from sparksieve.llm.linededup import line_dedup
from sparksieve.llm.quality import OUTPUTS as QUALITY_OUTPUTS
from sparksieve.llm.quality import quality_rules
from sparksieve.llm.queries import segmented, table
from sparksieve.llm.rows import aside

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's verdict reject go."""
    safe, back = aside(docs, *QUALITY_OUTPUTS)
    return back(quality_rules(safe, host="source").where("kept"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated three-line passages go; n_chars follows the text."""
    safe, back = aside(docs, "n_removed_lines")
    left = line_dedup(safe)
    return back(left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays, of those with the smallest id."""
    return one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def segmentation_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of what is left, decoded and compared."""
    return segmented(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("segmentation", segmentation_stage),
]

#: SQL can express neither the SimHash windows nor the sampled segmentations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next; what a stage has read goes then."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        docs = written(stage(spark, docs, sf_dir), name, path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
