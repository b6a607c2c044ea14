"""Queries of scans, catalogue rows, constraints and comparisons.

Trees are orders (worker = customer modulo 4, state = order status), models are
order priorities and folds order keys modulo 5, as in the other modules.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import convergence as cv
from ..operators import decisions as de
from ..operators import information as info
from ..operators import selection as sel
from ..operators import stats, windows
from ..operators.quantiles import exact_quantiles
from ..registry import query, r6, table
from ..shared import scratch
from ..sources import catalog, tables
from .evaluation_queries import CELLS, cells
from .stage1_queries import LF, PAIRS, SCORES, features

# ---- scans -----------------------------------------------------------------


@query("SELECT count(*) AS rows FROM orders WHERE o_orderstatus = 'F'")
def filtered_row_count(spark, d):
    return tables.row_count(tables.scan(spark, f"{d}/orders.parquet"), "o_orderstatus = 'F'")


@query("SELECT event_type, greatest(1, least(count(*), greatest(1000, least(100000, 1633))))::BIGINT AS chunk FROM events GROUP BY 1")
def adaptive_chunk_rows(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.select("event_type", tables.chunk_rows(64, F.col("n"), 0.01).alias("chunk"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def chunk_user_function(spark, d):
    def per_chunk(c):
        return c.groupby("event_type", as_index=False).agg(n=("value", "size"), total=("value", "sum"))

    parts = de.mapped_chunks(table(spark, d, "events").select("event_type", "value"), per_chunk, "event_type string, n long, total double")
    return parts.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


@query("SELECT o_orderstatus, round(avg(abs(o_totalprice - 1000)), 4) AS score FROM orders GROUP BY 1")
def user_scoring_function(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderkey", F.col("o_totalprice").alias("truth"), F.lit(1000.0).alias("predicted"))
    part = o.withColumn("slice", F.pmod("o_orderkey", F.lit(97)))
    scored = de.scored_groups(part, ["o_orderstatus", "slice"], lambda a, b: (a - b).abs().mean(), "truth", "predicted")
    sizes = part.groupBy("o_orderstatus", "slice").agg(F.count(F.lit(1)).alias("n"))
    return scored.join(sizes, ["o_orderstatus", "slice"]).groupBy("o_orderstatus").agg(F.round(F.sum(F.col("score") * F.col("n")) / F.sum("n"), 4).alias("score"))


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def csv_scan(spark, d):
    path = scratch(spark, "csv")
    table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").write.option("header", True).csv(path)
    back = spark.read.schema("c_custkey long, c_mktsegment string, c_acctbal double").option("header", True).csv(path)
    return back.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query(f"WITH {SCORES} SELECT feature, round(mi, 6) AS mi, row_number() OVER (ORDER BY mi DESC, feature) AS rank FROM s QUALIFY rank <= 25")
def json_stage_output(spark, d):
    path = scratch(spark, "stage1-json")
    sel.ranked(sel.feature_scores(features(spark, d)).select("feature", "mi"), "mi").where("rank <= 25").write.json(path)
    return r6("mi", of=tables.scan(spark, path, fmt="json").select("feature", "mi", "rank"))


@query("SELECT 'l_partkey' AS feature, count(l_partkey) AS present FROM lineitem UNION ALL SELECT 'l_suppkey', count(l_suppkey) FROM lineitem UNION ALL SELECT 'l_quantity', count(l_quantity) FROM lineitem UNION ALL SELECT 'l_extendedprice', count(l_extendedprice) FROM lineitem UNION ALL SELECT 'l_discount', count(l_discount) FROM lineitem")
def resolved_features(spark, d):
    li = table(spark, d, "lineitem")
    spec = tables.spec_from_metadata({"table_name": "lineitem", "id_columns": '["l_orderkey", "l_linenumber"]', "excluded_columns": '["l_tax"]', "target_column": "l_returnflag"})
    return stats.profile(li, tables.feature_columns(li, spec)).select(F.col("column").alias("feature"), "present")


@query("SELECT column_name AS name, CASE WHEN column_type IN ('BIGINT', 'INTEGER') THEN 'Int64' WHEN column_type = 'DOUBLE' THEN 'Float64' ELSE 'String' END AS kind, n AS rows FROM (DESCRIBE lineitem), (SELECT count(*) AS n FROM lineitem)")
def declared_kinds(spark, d):
    li = table(spark, d, "lineitem")
    types = li.sparkSession.createDataFrame(li.dtypes, "name string, declared string")
    return types.select("name", fn.sql_kind(F.col("declared")).alias("kind")).crossJoin(li.agg(F.count(F.lit(1)).alias("rows")))  # one row


@query("SELECT event_id, event_type AS first, (event_id % 3)::VARCHAR AS second FROM events")
def json_lists(spark, d):
    e = table(spark, d, "events").select("event_id", F.to_json(F.array("event_type", (F.col("event_id") % 3).cast("string"))).alias("text"))
    items = e.select("event_id", fn.json_strings(F.col("text")).alias("items"))
    return items.select("event_id", F.get("items", F.lit(0)).alias("first"), F.get("items", F.lit(1)).alias("second"))


@query("""SELECT o_orderkey, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS took,
CASE WHEN b >= 1073741824 THEN round(b / 1073741824, 1) || ' GB' WHEN b >= 1048576 THEN round(b / 1048576, 1) || ' MB' WHEN b >= 1024 THEN round(b / 1024, 1) || ' KB' ELSE b || ' B' END AS size
FROM (SELECT o_orderkey, o_orderkey * 7 % 9000 AS s, o_custkey * o_custkey * 37 AS b FROM orders)""")
def duration_and_size_text(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", fn.duration_text(F.col("o_orderkey") * 7 % 9000).alias("took"), fn.byte_text(F.col("o_custkey") * F.col("o_custkey") * 37).alias("size"))


# ---- catalogue -------------------------------------------------------------


@query(f"WITH {SCORES} SELECT feature, round(mi, 6) AS score, row_number() OVER (ORDER BY mi DESC, feature) AS rank FROM s QUALIFY rank <= 10")
def ranking_csv(spark, d):
    path = scratch(spark, "ranking")
    ranking = sel.ranked(sel.feature_scores(features(spark, d)).select("feature", F.col("mi").alias("score")))
    catalog.export_csv(ranking.where("rank <= 10"), path)
    return r6("score", of=spark.read.schema("feature string, score double, rank long").option("header", True).csv(path))


@query("SELECT 'run-1' AS run_id, 'rows' AS key, 'int' AS kind, count(*)::VARCHAR AS value FROM orders UNION ALL SELECT 'run-1', 'best_priority', 'string', min(o_orderpriority) FROM orders UNION ALL SELECT 'run-1', 'any_open', 'bool', CASE WHEN bool_or(o_orderstatus = 'O') THEN 'true' ELSE 'false' END FROM orders")
def run_configuration(spark, d):
    row = table(spark, d, "orders").agg(F.count(F.lit(1)).alias("rows"), F.min("o_orderpriority").alias("best_priority"), F.bool_or(F.col("o_orderstatus") == "O").alias("any_open")).first()
    return catalog.config_rows("run-1", row.asDict(), spark)


@query("SELECT o_orderstatus AS metric, round(avg(o_totalprice), 4) AS value FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def ensemble_metric_rows(spark, d):
    root = scratch(spark, "catalogue")
    rows = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("run_id"), F.col("o_orderstatus").alias("metric")).agg(F.avg("o_totalprice").alias("value"), F.max("o_orderdate").cast("timestamp").alias("written"))
    catalog.append(rows, root, "ensemble_metrics")
    return catalog.load(spark, root, "ensemble_metrics").where("run_id = '1-URGENT'").select("metric", F.round("value", 4).alias("value"))


@query("SELECT o_custkey AS tree_id, count(*) AS visits, max(o_totalprice) AS best FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 1 ORDER BY best DESC, tree_id LIMIT 20")
def tree_statistic_rows(spark, d):
    root = scratch(spark, "catalogue")
    rows = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("run_id"), F.col("o_custkey").alias("tree_id")).agg(F.count(F.lit(1)).alias("visits"), F.countDistinct("o_orderstatus").alias("depth"), F.max("o_totalprice").alias("best"))
    catalog.append(rows, root, "tree_statistics")
    return catalog.load(spark, root, "tree_statistics").where("run_id = '2-HIGH'").orderBy(F.desc("best"), "tree_id").limit(20).select("tree_id", "visits", "best")


@query("SELECT o_orderkey % 10 AS iteration, o_orderstatus AS feature, count(*) AS votes FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY ALL")
def consensus_history_rows(spark, d):
    root = scratch(spark, "catalogue")
    rows = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("run_id"), (F.col("o_orderkey") % 10).alias("iteration"), F.col("o_orderstatus").alias("feature")).agg(F.count(F.lit(1)).alias("votes"))
    catalog.append(rows, root, "consensus_history")
    return catalog.load(spark, root, "consensus_history").where("run_id = '5-LOW'").select("iteration", "feature", "votes")


@query("SELECT o_orderstatus AS state, count(*) AS trees, round(max(o_totalprice), 2) AS best, 2 AS iteration, 3 AS snapshots FROM orders GROUP BY 1")
def snapshot_round_trip(spark, d):
    root, schema = scratch(spark, "snapshots"), "state string, trees long, best double"
    o = table(spark, d, "orders")
    for i, part in enumerate(("o_orderkey % 4 = 0", "o_orderkey % 2 = 0", "true")):
        catalog.save_snapshot(o.where(part).groupBy(F.col("o_orderstatus").alias("state")).agg(F.count(F.lit(1)).alias("trees"), F.max("o_totalprice").alias("best")), root, i)
    listed = catalog.snapshots(spark, root, schema).agg(F.countDistinct("iteration").alias("snapshots"))
    return catalog.load_snapshot(spark, root, schema).withColumn("best", F.round("best", 2)).crossJoin(listed)  # one row


@query("SELECT o_orderkey AS run_id, o_orderdate AS started, o_orderstatus AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def run_history(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started"), F.col("o_orderstatus").alias("status"))


@query(f"WITH {CELLS}, m AS (SELECT model, avg(value) AS mean FROM cells GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY mean DESC, model) AS place FROM m) SELECT place, printf('%d. %s: %.4f', place, model, mean) AS line FROM r")
def comparison_report(spark, d):
    return catalog.summary_lines(cells(spark, d).groupBy("model").agg(F.avg("value").alias("mean")), "model", "mean")


# ---- projections and constraints ------------------------------------------


@query(f"WITH {LF} SELECT feature, count(*) AS n, round(avg(value), 6) AS mean FROM lf WHERE feature IN ('e03', 'e07', 'e11', 'e64') GROUP BY 1")
def feature_projection(spark, d):
    lf = features(spark, d)
    chosen = spark.createDataFrame([(f"e{i:02d}",) for i in (3, 7, 11, 64)], "feature string")
    return r6("mean", of=de.projected(lf, chosen).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


@query("SELECT o_orderkey, o_totalprice, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::DOUBLE AS o_orderpriority_code, (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::DOUBLE AS o_orderstatus_code FROM orders")
def mixed_projection(spark, d):
    return de.mixed_columns(table(spark, d, "orders"), ["o_totalprice"], ["o_orderpriority", "o_orderstatus"], ["o_orderkey"])


@query(f"WITH {SCORES}, c AS (SELECT feature, mi, feature IN ('e01', 'e02') AS forced FROM s WHERE feature NOT IN ('e05', 'e06', 'e07')) SELECT feature, round(mi, 6) AS mi, forced, row_number() OVER (ORDER BY forced DESC, mi DESC, feature) AS rank FROM c QUALIFY rank <= 12")
def constrained_selection(spark, d):
    s = sel.feature_scores(features(spark, d)).select("feature", "mi")
    return r6("mi", of=de.constrained(s, "mi", 12, ["e05", "e06", "e07"], ["e01", "e02"]))


@query(f"WITH {SCORES}, k AS (SELECT feature, mi FROM s ORDER BY mi DESC, feature LIMIT 20) SELECT feature, substr(feature, 2)::BIGINT AS original_id, row_number() OVER (ORDER BY mi DESC, feature) AS stage_index FROM k")
def stage_index_map(spark, d):
    top = sel.feature_scores(features(spark, d)).orderBy(F.desc("mi"), "feature").limit(20)
    return de.index_map(top, [F.desc("mi"), F.col("feature")], F.substring("feature", 2, 9).cast("long"))


@query(f"""WITH {LF}, {PAIRS}, b AS (SELECT f1 AS f, f2 AS o FROM pairs WHERE abs(r) >= 0.1 UNION ALL SELECT f2, f1 FROM pairs WHERE abs(r) >= 0.1), low AS (SELECT f, min(o) AS o FROM b GROUP BY 1)
SELECT feature, least(feature, coalesce(o, feature)) AS "group" FROM (SELECT DISTINCT feature FROM lf) LEFT JOIN low ON f = feature""")
def correlation_groups(spark, d):
    lf = features(spark, d)
    return de.correlation_groups(lf.select("feature").distinct(), stats.correlation_pairs(lf, 0.1))


@query("SELECT o_orderkey AS tree_id, o_totalprice AS score FROM orders WHERE o_orderstatus = 'P'")
def trees_by_state(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("tree_id"), F.col("o_totalprice").alias("score"))


@query("SELECT o_orderstatus AS state, count(*) AS trees, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def forest_status(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count(F.lit(1)).alias("trees"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


# ---- profiles and trends ---------------------------------------------------


@query("""WITH p AS (SELECT 'n' AS k, count(o_orderkey) AS present, count(*) AS rows, count(DISTINCT o_orderkey) AS u FROM orders UNION ALL SELECT 'n', count(o_totalprice), count(*), count(DISTINCT o_totalprice) FROM orders UNION ALL SELECT 's', count(nullif(o_orderpriority, '5-LOW')), count(*), count(DISTINCT nullif(o_orderpriority, '5-LOW')) FROM orders)
SELECT count(*) AS columns, count(*) FILTER (WHERE k = 'n') AS numeric_columns, sum(rows - present)::BIGINT AS missing, round(avg(1 - present / rows), 6) AS mean_missing_ratio, count(*) FILTER (WHERE u > 1000) AS high_cardinality FROM p""")
def profile_summary(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    p = stats.profile(o)
    return p.agg(F.count(F.lit(1)).alias("columns"), F.count_if(F.col("type") != "string").alias("numeric_columns"), F.sum(F.col("rows") - F.col("present")).alias("missing"), F.round(F.avg("missing_ratio"), 6).alias("mean_missing_ratio"), F.count_if("high_cardinality").alias("high_cardinality"))


@query("SELECT event_type, max(value) AS high, min(value) AS low, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(regr_slope(value, event_id) * 1e6, 4) AS slope FROM events GROUP BY 1")
def weight_trend_statistics(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.max("value").alias("high"), F.min("value").alias("low"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.round(F.regr_slope("value", "event_id") * 1e6, 4).alias("slope"))


@query("""WITH n AS (SELECT event_id, user_id, value / 100 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::DOUBLE AS i FROM events),
s AS (SELECT event_id, count(*) OVER w AS n, regr_slope(v, i) OVER w AS slope FROM n WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 5 PRECEDING))
SELECT event_id, CASE WHEN n < 6 OR slope IS NULL OR abs(slope) < 0.001 THEN 0 WHEN slope > 0 THEN 1 ELSE -1 END AS direction FROM s""")
def trend_direction(spark, d):
    e = table(spark, d, "events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("double"))
    w = windows.last_rows(["user_id"], ["event_id"], 6)
    s = e.select("event_id", F.count(F.lit(1)).over(w).alias("n"), windows.slope(F.col("value") / 100, F.col("i"), w).alias("slope"))
    return s.select("event_id", F.when(F.col("n") >= 6, F.coalesce(de.trend(F.col("slope")), F.lit(0))).otherwise(0).alias("direction"))


@query("""WITH f AS (SELECT event_id, user_id, value < 90 AS low, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, low ORDER BY event_id) AS k FROM f)
SELECT user_id, count(*) AS updates, count(*) FILTER (WHERE low AND run >= 3) AS triggers FROM (SELECT *, row_number() OVER (PARTITION BY user_id, low, k ORDER BY event_id) AS run FROM g) GROUP BY 1""")
def retrain_triggers(spark, d):
    r = windows.runs(table(spark, d, "events"), F.col("value") < 90, ["user_id"], ["event_id"])
    return r.groupBy("user_id").agg(F.count(F.lit(1)).alias("updates"), F.count_if(F.col("run") >= 3).alias("triggers"))


@query("""WITH e AS (SELECT quantile_cont(l_quantity, [0.2,0.4,0.6,0.8]) AS a, quantile_cont(l_extendedprice, [0.2,0.4,0.6,0.8]) AS b FROM lineitem),
g AS (SELECT len(list_filter(a, lambda x: x < l_quantity)) AS i, len(list_filter(b, lambda x: x < l_extendedprice)) AS j, l_returnflag AS k FROM lineitem, e)
SELECT 'continuous' AS kind, round(sum(c / n * ln(c * n / (ci * cj))), 6) AS mi FROM (SELECT c, sum(c) OVER () AS n, sum(c) OVER (PARTITION BY i) AS ci, sum(c) OVER (PARTITION BY j) AS cj FROM (SELECT i, j, count(*) AS c FROM g GROUP BY ALL))
UNION ALL SELECT 'mixed', round(greatest(0, sum(c / n * ln(c * n / (ci * cj)))), 6) FROM (SELECT c, sum(c) OVER () AS n, sum(c) OVER (PARTITION BY i) AS ci, sum(c) OVER (PARTITION BY k) AS cj FROM (SELECT i, k, count(*) AS c FROM g GROUP BY ALL))""")
def mixed_mutual_information(spark, d):
    li = table(spark, d, "lineitem")
    at = [0.2, 0.4, 0.6, 0.8]
    a, b = (F.broadcast(exact_quantiles(li, [], c, at, name)) for c, name in (("l_quantity", "a"), ("l_extendedprice", "b")))  # one row each
    binned = li.crossJoin(a).crossJoin(b).select(F.size(F.filter("a", lambda x: x < F.col("l_quantity"))).alias("i"), F.size(F.filter("b", lambda x: x < F.col("l_extendedprice"))).alias("j"), "l_returnflag")
    both = info.discrete_mi(binned, "i", "j").select(F.lit("continuous").alias("kind"), "mi").union(info.discrete_mi(binned, "i", "l_returnflag").select(F.lit("mixed"), "mi"))
    return r6("mi", of=both)


# ---- trees and subsets -----------------------------------------------------


@query("""WITH t AS (SELECT o_orderkey AS tree_id, o_custkey % 4 AS worker, o_totalprice / 1000000 AS confidence FROM orders),
v AS (SELECT l_orderkey AS tree_id, l_partkey % 40 AS f FROM lineitem GROUP BY ALL), b AS (SELECT f, count(*) AS c FROM v GROUP BY 1 ORDER BY c DESC, f LIMIT 10),
l AS (SELECT count(*) AS k, (max(w) - min(w)) / avg(w) AS u FROM (SELECT worker, count(*) AS w FROM t GROUP BY 1)),
x AS (SELECT avg(confidence) AS confidence, (SELECT sum(c) / (count(*) * (SELECT count(*) FROM t)) FROM b) AS agreement, (SELECT CASE WHEN k < 2 THEN 0.5 ELSE greatest(0.0, least(1.0, 1 - u)) END FROM l) AS balance FROM t)
SELECT round(confidence, 6) AS confidence, round(agreement, 6) AS agreement, round(balance, 6) AS balance, round(0.4 * confidence + 0.4 * agreement + 0.2 * balance, 6) AS score FROM x""")
def ensemble_confidence(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("tree_id"), (F.col("o_custkey") % 4).alias("worker"), (F.col("o_totalprice") / 1000000).alias("confidence"))
    v = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tree_id"), (F.col("l_partkey") % 40).alias("feature_id")).distinct()
    return r6("confidence", "agreement", "balance", "score", of=de.ensemble_confidence(t, v))


@query("SELECT s_suppkey AS tree_id, round(0.5 + 1.5 * (((s_suppkey * 2654435761) % 1000003 + 0.5) / 1000003), 6) AS uniform, round(0.5 + 1.5 * (s_suppkey - 1) / greatest(count(*) OVER () - 1, 1), 6) AS adaptive FROM supplier")
def exploration_constants(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("tree_id"))
    n = s.agg(F.count(F.lit(1)).alias("n"))  # one row
    place = F.col("tree_id") - 1
    return r6("uniform", "adaptive", of=s.crossJoin(n).select("tree_id", de.exploration_constant("uniform", place, F.col("n"), cv.hash_uniform(F.col("tree_id"))).alias("uniform"), de.exploration_constant("adaptive", place, F.col("n"), F.lit(0.0)).alias("adaptive")))


@query("SELECT tree_id, feature_id FROM (SELECT DISTINCT l_suppkey AS tree_id, l_partkey % 64 AS feature_id FROM lineitem) QUALIFY row_number() OVER (PARTITION BY tree_id ORDER BY ((tree_id * 64 + feature_id) * 2654435761) % 1000003, feature_id) <= 8")
def initial_features(spark, d):
    available = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("tree_id"), (F.col("l_partkey") % 64).alias("feature_id")).distinct()
    w = Window.partitionBy("tree_id").orderBy(cv.hash_uniform(F.col("tree_id") * 64 + F.col("feature_id")), "feature_id")
    return available.withColumn("r", F.row_number().over(w)).where("r <= 8").drop("r")


@query("""WITH e AS (SELECT user_id, avg(value) / 100 AS diversity, 0.5 + (user_id % 6) / 10 AS rate, (user_id % 10) / 10 AS overlap FROM events GROUP BY user_id)
SELECT user_id, round(CASE WHEN diversity < 0.45 THEN greatest(0.5, rate - 0.1) WHEN diversity > 0.55 THEN least(1.0, rate + 0.1) ELSE rate END, 6) AS next_rate, round(CASE WHEN diversity < 0.45 THEN greatest(0.3, overlap - 0.1) WHEN diversity > 0.55 THEN least(1.0, overlap + 0.1) ELSE overlap END, 6) AS next_overlap FROM e""")
def diversity_actions(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg((F.avg("value") / 100).alias("diversity"))
    return r6("next_rate", "next_overlap", of=e.select("user_id", *[c.alias(n) for n, c in de.diversity_action(F.col("diversity"), 0.5 + (F.col("user_id") % 6) / 10, (F.col("user_id") % 10) / 10, 0.45, 0.55).items()]))


@query(f"""WITH {SCORES}, w AS (SELECT feature, 20 * mi - 0.2 AS weight FROM s), t AS (SELECT DISTINCT l_suppkey AS tree_id, 'e' || lpad((l_partkey % 64 + 1)::VARCHAR, 2, '0') AS feature FROM lineitem)
SELECT tree_id, round(1 / (1 + exp(-avg(weight))), 6) AS predicted FROM t JOIN w USING (feature) GROUP BY 1""")
def linear_surrogate(spark, d):
    weights = sel.feature_scores(features(spark, d)).select("feature", (20 * F.col("mi") - 0.2).alias("weight"))
    t = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("tree_id"), F.concat(F.lit("e"), F.lpad((F.col("l_partkey") % 64 + 1).cast("string"), 2, "0")).alias("feature")).distinct()
    return r6("predicted", of=de.linear_surrogate(t, weights))


@query("""WITH s AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_partkey % 30)) AS f FROM lineitem GROUP BY 1), x AS (SELECT id, f, f[1 + id % len(f)] AS gone, list_filter(range(30), lambda x: NOT list_contains(f, x)) AS free FROM s),
y AS (SELECT *, free[1 + id % len(free)] AS added, list_filter(f, lambda x: x <> gone) AS less FROM x)
SELECT id, 'remove' AS action, array_to_string(less, ',') AS features FROM y UNION ALL SELECT id, 'add', array_to_string(list_sort(list_append(f, added)), ',') FROM y UNION ALL SELECT id, 'swap', array_to_string(list_sort(list_append(less, added)), ',') FROM y""")
def augmented_subsets(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set(F.col("l_partkey") % 30)).alias("f"))
    pool = F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))
    return de.augmented(s, "id", "f", pool, F.col("id").cast("int")).select("id", "action", F.array_join("features", ",").alias("features"))


@query("""WITH p AS (SELECT o_orderkey, greatest(0.0, least(1.0, (1 - (o_custkey % 60) / 60.0 * 0.3) * (1 - abs(o_totalprice / 500000 - 0.5) * 0.2))) AS confidence FROM orders)
SELECT CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS level, count(*) AS n, round(avg(confidence), 6) AS mean FROM p GROUP BY 1""")
def prediction_confidence(spark, d):
    c = de.prediction_confidence(F.col("o_custkey") % 60, 60, F.col("o_totalprice") / 500000)
    return table(spark, d, "orders").select(c.alias("c")).groupBy(de.confidence_level(F.col("c")).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 6).alias("mean"))


@query(f"WITH {SCORES}, top AS (SELECT feature FROM s ORDER BY mi DESC, feature LIMIT 10), base AS (SELECT 'correlation' AS baseline, feature FROM (SELECT feature FROM s ORDER BY r DESC, feature LIMIT 10) UNION ALL SELECT 'variance', feature FROM (SELECT feature FROM s ORDER BY variance DESC, feature LIMIT 10)) SELECT baseline, round(count(top.feature) / 10, 6) AS overlap FROM base LEFT JOIN top ON top.feature = base.feature GROUP BY 1")
def baseline_overlap(spark, d):
    s = sel.feature_scores(features(spark, d))
    top = lambda c: s.orderBy(F.desc(c), "feature").limit(10).select("feature")
    baselines = top("r").select(F.lit("correlation").alias("baseline"), "feature").union(top("variance").select(F.lit("variance"), "feature"))
    hit = top("mi").withColumn("hit", F.lit(1))
    return r6("overlap", of=baselines.join(hit, "feature", "left").groupBy("baseline").agg((F.count("hit") / 10).alias("overlap")))


# ---- models ----------------------------------------------------------------


@query(f"WITH {CELLS}, c AS (SELECT model, CASE WHEN fold = 3 THEN NULL ELSE value END AS value FROM cells) SELECT model, count(*) AS runs, count(*) - count(value) AS errors, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS low, round(max(value), 6) AS high FROM c GROUP BY 1")
def model_results(spark, d):
    c = cells(spark, d).withColumn("value", F.when(F.col("fold") != 3, F.col("value")))
    return r6("mean", "std", "low", "high", of=de.model_results(c))


@query(f"WITH {CELLS} SELECT fold, round(avg(value), 6) AS score FROM cells GROUP BY 1")
def ensemble_mean_scores(spark, d):
    return cells(spark, d).groupBy("fold").agg(F.round(F.avg("value"), 6).alias("score"))


@query(f"WITH {CELLS}, m AS (SELECT model, avg(value) AS mean FROM cells GROUP BY 1 ORDER BY mean DESC, model LIMIT 3) SELECT model, round(mean, 6) AS mean, round(mean / sum(mean) OVER (), 6) AS weight FROM m")
def top_model_weights(spark, d):
    return r6("mean", "weight", of=de.top_models(cells(spark, d).groupBy("model").agg(F.avg("value").alias("mean")), 3))


@query(f"WITH {CELLS}, m AS (SELECT model, avg(value) AS mean FROM cells GROUP BY 1) SELECT x.model AS a, y.model AS b, round(y.mean - x.mean, 6) AS delta, CASE WHEN y.mean > x.mean THEN y.model ELSE x.model END AS winner FROM m x JOIN m y ON x.model < y.model")
def feature_set_comparison(spark, d):
    return r6("delta", of=de.compared_sets(cells(spark, d).groupBy("model").agg(F.avg("value").alias("mean"))))


@query(f"WITH {SCORES} SELECT feature, round(0.5 * r / max(r) OVER () + 0.5 * mi / max(mi) OVER (), 6) AS importance FROM s")
def importance_combination(spark, d):
    return r6("importance", of=de.combined_importance(sel.feature_scores(features(spark, d)), "r", "mi")).select("feature", "importance")


@query("SELECT l_returnflag, round(corr(l_quantity * 1500, l_extendedprice), 6) AS r, round(avg(abs(l_extendedprice - l_quantity * 1500)), 4) AS mae FROM lineitem GROUP BY 1")
def surrogate_validation(spark, d):
    li = table(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 1500)
    return li.groupBy("l_returnflag").agg(F.round(F.corr("p", "l_extendedprice"), 6).alias("r"), F.round(F.avg(F.abs(F.col("l_extendedprice") - F.col("p"))), 4).alias("mae"))
