"""Lineage cuts and scratch tables in the folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where it is unset and Spark runs in this process, a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="spark-sieve-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sparksieve/{name}-{uuid.uuid4().hex}"


#: Spark's own setting (4.1 on): delete a query's shuffle files when it has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, path: str | None = None, **options: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: recovery starts here.

    The job's shuffle files are not needed beyond it and are deleted at its end; the session's setting is put back.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system, whatever store it is in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """The intermediate tables of one run, in one folder of the shared store.

    ``done`` writes the result outside of the folder and deletes the rest, so a run leaves its result only.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.tables = spark, name, 0
        self.root = scratch_path(spark, name)

    def written(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        self.tables += 1
        return written(df, name, f"{self.root}/{self.tables:03d}-{name}", **options)

    def done(self, df: DataFrame) -> DataFrame:
        result = written(df, f"{self.name}-result")
        remove(self.spark, self.root)
        return result


#: Rows of a key table that may be broadcast: 16-byte rows, so 16 MB at most.
BROADCAST_ROWS = 1_000_000


def checked_broadcast(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """small, marked for broadcast only where a count shows that it has at most ``limit`` rows.

    ``small`` should be a written table, so that the count reads footers only.
    Beyond the limit the join that follows shuffles both sides.
    """
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small
