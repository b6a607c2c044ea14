"""Queries of configs, metadata, batches, thresholds, comparisons and exports."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import information as info
from ..operators import selection as sel
from ..operators import stats
from ..operators.longform import from_wide
from ..registry import query, r6, table
from ..shared import scratch
from ..sources import catalog, tables
from .stage1_queries import CORR, LF, PAIRS, PLACES, SCORES, features


def written_text(spark, path, text):
    """A file of the given text at a path of the shared folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(text, "utf-8"))
    out.close()
    return path


@query("""SELECT key, value FROM (VALUES ('mode', '"fast"'), ('name', '"orders"'), ('stage1.correlation_threshold', '0.2'), ('stage1.min_features_to_keep', '3'), ('stage2.hidden_sizes', '[64, 32]'), ('presets.fast.stage1.correlation_threshold', '0.2'), ('presets.fast.stage2.hidden_sizes', '[64, 32]')) t(key, value)
UNION ALL SELECT 'stage1.rows', count(*)::VARCHAR FROM orders UNION ALL SELECT 'stage2.hidden_sizes_of', '"' || min(o_orderpriority) || '"' FROM orders""")
def config_settings(spark, d):
    """A YAML config with a preset over it, as settings by dotted key."""
    o = table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderpriority").alias("p")).first()
    text = f"""# settings of a run
mode: fast
name: orders
stage1:
  rows: {o["n"]}
  correlation_threshold: 0.1   # kept features
  min_features_to_keep: 3
stage2:
  hidden_sizes: [256, 128]
  hidden_sizes_of: "{o["p"]}"
presets:
  fast:
    stage1: {{correlation_threshold: 0.2}}
    stage2:
      hidden_sizes: [64, 32]
"""
    return tables.config_table(spark, tables.read_config(spark, written_text(spark, f"{scratch(spark, 'config')}/run.yaml", text)))


@query("SELECT column_name AS feature, (SELECT count(*) FROM lineitem) AS rows FROM (DESCRIBE lineitem) WHERE column_name IN ('l_partkey', 'l_suppkey', 'l_quantity', 'l_extendedprice', 'l_tax')")
def metadata_search(spark, d):
    """The metadata two folders above a training table, the spec that it gives, and what it leaves as features."""
    root = scratch(spark, "competition")
    written_text(spark, f"{root}/items_metadata.json", json.dumps({"table_name": "lineitem", "id_columns": '["l_orderkey", "l_linenumber"]', "excluded_columns": '["l_discount"]', "target_column": "l_returnflag"}))
    found = tables.find_metadata(spark, f"{root}/a/b/train.parquet")
    spec, li = tables.spec_from_metadata(json.loads(spark.read.text(found).first()[0])), table(spark, d, "lineitem")
    if faults := tables.spec_faults(spec, li):
        raise ValueError("; ".join(faults))
    names = spark.createDataFrame([(c,) for c in tables.feature_columns(li, spec)], "feature string")
    return names.crossJoin(F.broadcast(tables.row_count(li)))  # one row


@query("SELECT batch, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 512 AS batch FROM orders) GROUP BY 1")
def ordered_batches(spark, d):
    o = tables.batches(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 512)
    return o.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("SELECT n, count(*) AS batches FROM (SELECT count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 512 AS batch FROM orders) GROUP BY batch) GROUP BY 1")
def shuffled_batches(spark, d):
    """Batches in an order by hash: as many and as large as those in the keys' order."""
    o = tables.batches(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 512, shuffled=True, seed=3)
    return o.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("batches"))


@query(f"WITH {LF}, {CORR} SELECT count(*) AS rows, 0 AS alone, true AS passed FROM r")
def result_comparison(spark, d):
    """Correlations by centred sums against those of Spark's own aggregate."""
    lf = features(spark, d)
    own = lf.groupBy("feature").agg(F.corr("value", "y").alias("r"))
    return tables.compared(stats.pearson(lf), own, ["feature"], "r").select("rows", "alone", "passed")


@query(f"WITH {SCORES} SELECT feature, round(mi, 6) AS mi FROM s WHERE mi >= 0.02 AND variance >= 1e-6 ORDER BY mi DESC, feature LIMIT 20")
def updated_thresholds(spark, d):
    t = sel.Thresholds(target=100).updated(mi=0.02, correlation=None, target=20)
    return r6("mi", of=sel.passing(sel.feature_scores(features(spark, d)), t).select("feature", "mi"))


@query("""WITH l AS (SELECT f AS feature, v AS value, l_returnflag AS y FROM (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount FROM lineitem) UNPIVOT (v FOR f IN (l_quantity, l_extendedprice, l_discount))),
b AS (SELECT feature, y, CASE WHEN high <= low THEN 1 ELSE least(floor((value - low) / ((high - low) / 10)) + 1, 10) END AS bin FROM l JOIN (SELECT feature, min(value) AS low, max(value) AS high FROM l GROUP BY 1) USING (feature)),
p AS (SELECT feature, c, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, bin) AS nx, sum(c) OVER (PARTITION BY feature, y) AS ny FROM (SELECT feature, bin, y, count(*) AS c FROM b GROUP BY ALL)),
k AS (SELECT count(DISTINCT y) AS classes FROM l)
SELECT feature, round(greatest(0.0, sum(c / n * ln(c * n / (nx * ny)))), 6) AS mi, any_value(classes) AS classes FROM p, k GROUP BY 1""")
def numbered_class_information(spark, d):
    """Information about a target of several classes, which get numbers from 1."""
    lf = from_wide(table(spark, d, "lineitem").withColumn("id", F.lit(0)), "id", F.ascii("l_returnflag"), ["l_quantity", "l_extendedprice", "l_discount"])
    numbered = info.with_class_numbers(lf)
    classes = F.broadcast(numbered.agg(F.max("y").alias("classes")))  # one row
    return r6("mi", of=info.mutual_information(info.with_equal_width(numbered)).crossJoin(classes))


@query("SELECT '<tr><td>' || o_orderpriority || '</td><td>' || count(*) || '</td><td>' || CASE WHEN min(o_orderkey) % 2 = 0 THEN 'a&lt;b &amp; c' ELSE '' END || '</td></tr>' AS line FROM orders GROUP BY o_orderpriority UNION ALL SELECT * FROM (VALUES ('<html><head><title>Orders</title></head><body><table>'), ('<tr><th>o_orderpriority</th><th>n</th><th>note</th></tr>'), ('</table></body></html>'))")
def html_export(spark, d):
    """A comparison as an HTML file, read again."""
    o = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.when(F.min("o_orderkey") % 2 == 0, "a<b & c").alias("note"))
    path = scratch(spark, "html")
    catalog.export_html(o, o.columns, ["o_orderpriority"], "Orders", path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(f"WITH {LF}, {PAIRS} SELECT f1, f2, round(r, 6) AS r FROM pairs ORDER BY abs(r) DESC, f1, f2 LIMIT 20")
def interaction_export(spark, d):
    """The 20 strongest pairs as a CSV file, read again."""
    pairs = stats.vector_pairs(table(spark, d, "embeddings"), "embedding", PLACES)
    path = scratch(spark, "interactions")
    catalog.export_csv(r6("r", of=pairs.orderBy(F.desc(F.abs("r")), "f1", "f2").limit(20)), path)
    return tables.scan(spark, path, fmt="csv", header="true", inferSchema="true")


@query("""WITH s AS (SELECT 'e' || lpad((l_suppkey % 70 + 1)::VARCHAR, 2, '0') AS feature, l_partkey % 997 AS rank, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END AS score FROM lineitem)
SELECT 'rank_gaps' AS "check", max(rank) - count(*) AS failures FROM s UNION ALL SELECT 'duplicates', count(*) - count(DISTINCT feature) FROM s UNION ALL SELECT 'null_scores', count(*) FILTER (WHERE score IS NULL) FROM s
UNION ALL SELECT 'unknown', count(*) FROM s WHERE feature NOT IN (SELECT 'e' || lpad(i::VARCHAR, 2, '0') FROM range(1, 65) t(i))""")
def broken_selection_validation(spark, d):
    """What the checks of a selection find in one that is none: repeated, unknown and unscored features, ranks in no order."""
    li = table(spark, d, "lineitem")
    s = li.select(F.concat(F.lit("e"), F.lpad((F.col("l_suppkey") % 70 + 1).cast("string"), 2, "0")).alias("feature"), (F.col("l_partkey") % 997).alias("rank"), F.when(F.col("l_linenumber") != 7, F.col("l_discount")).alias("score"))
    return sel.validated(s, features(spark, d))
