"""Queries of cleaning, encoding, profiling, windows and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import clean, stats, windows
from ..registry import query, r6, table

HOLES = "h AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority, o_orderdate FROM orders)"


def holes(spark, d):
    """orders with planted nulls."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"), "o_orderdate")


@query(f"WITH {HOLES} SELECT o_orderkey, CASE WHEN price IS NULL THEN 0.0 ELSE price END AS price FROM h")
def null_to_zero(spark, d):
    return holes(spark, d).select("o_orderkey", clean.finite(F.col("price")).alias("price"))


@query("SELECT l_linestatus, count(*) AS n, round(sum(CASE WHEN l_discount = 0 THEN 0 ELSE l_tax / l_discount END), 4) AS total FROM lineitem GROUP BY 1")
def non_finite_to_zero(spark, d):
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.try_divide("l_tax", "l_discount"))
    return table(spark, d, "lineitem").select("l_linestatus", clean.finite(ratio).alias("v")).groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query("SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS p_retailprice, round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 6) AS p_size FROM part")
def z_score_normalise(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("p_retailprice"), F.col("p_size").cast("double").alias("p_size"))
    return r6("p_retailprice", "p_size", of=clean.z_scores(p, ["p_retailprice", "p_size"]))


@query(f"WITH {HOLES} SELECT o_orderkey, round(coalesce(price, (SELECT avg(price) FROM h)), 4) AS mean_price, round(coalesce(price, (SELECT median(price) FROM h)), 4) AS median_price, coalesce(priority, (SELECT priority FROM h WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, priority LIMIT 1)) AS priority FROM h")
def impute_mean_median_mode(spark, d):
    h = holes(spark, d).withColumn("median_price", F.col("price"))
    out = clean.impute(h, {"price": "mean", "median_price": "median", "priority": "mode"})
    return out.select("o_orderkey", F.round("price", 4).alias("mean_price"), F.round("median_price", 4).alias("median_price"), "priority")


@query(f"WITH {HOLES} SELECT count(*) AS n, round(sum(price), 2) AS total FROM h WHERE price IS NOT NULL")
def impute_skip(spark, d):
    return clean.impute(holes(spark, d), {"price": "skip"}).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query(f"WITH {HOLES} SELECT o_orderkey, last_value(price IGNORE NULLS) OVER w AS price FROM h WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)")
def forward_fill(spark, d):
    return clean.filled_forward(holes(spark, d), "price", "o_orderkey", ["o_custkey"]).select("o_orderkey", "price")


@query(f"WITH {HOLES} SELECT o_orderkey, first_value(price IGNORE NULLS) OVER w AS price FROM h WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
def backward_fill(spark, d):
    return clean.filled_backward(holes(spark, d), "price", "o_orderkey", ["o_custkey"]).select("o_orderkey", "price")


@query(f"WITH {HOLES} SELECT o_orderkey, round(coalesce(price, CASE WHEN a IS NULL THEN b.v WHEN b IS NULL THEN a.v ELSE a.v + (b.v - a.v) * (o_orderkey - a.x) / (b.x - a.x) END) + 1e-7, 2) AS price FROM (SELECT *, last_value(CASE WHEN price IS NOT NULL THEN {{'x': o_orderkey, 'v': price}} END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS a, first_value(CASE WHEN price IS NOT NULL THEN {{'x': o_orderkey, 'v': price}} END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM h)")
def linear_interpolation(spark, d):
    h = holes(spark, d)
    return h.select("o_orderkey", F.round(windows.interpolated(h, "price", "o_orderkey", ["o_custkey"]) + 1e-7, 2).alias("price"))


@query("SELECT p_partkey, p_size, p_retailprice FROM part")
def constant_removal(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", F.lit(5).alias("fixed"))
    return clean.without_constants(p, ["p_size", "p_retailprice", "fixed"])


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority_code FROM orders")
def label_encoding(spark, d):
    return clean.label_encoded(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority").select("o_orderkey", "o_orderpriority_code")


@query("SELECT o_orderkey, (o_orderstatus = 'F')::INT AS \"o_orderstatus_F\", (o_orderstatus = 'O')::INT AS \"o_orderstatus_O\", (o_orderstatus = 'P')::INT AS \"o_orderstatus_P\" FROM orders")
def one_hot_encoding(spark, d):
    return clean.one_hot(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus").drop("o_orderstatus")


@query("WITH c AS (SELECT c_mktsegment AS s, (row_number() OVER (ORDER BY c_mktsegment) - 1) / greatest(1, count(*) OVER () - 1) AS v FROM (SELECT DISTINCT c_mktsegment FROM customer)) SELECT c_custkey, round(v, 6) AS c_mktsegment_ordinal FROM customer JOIN c ON s = c_mktsegment")
def ordinal_encoding(spark, d):
    return r6("c_mktsegment_ordinal", of=clean.ordinal(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")).drop("c_mktsegment")


@query("SELECT (event_id * 2654435761) % 1009 + 1 AS bucket, count(*) AS n FROM events GROUP BY 1")
def hash_encoding(spark, d):
    return table(spark, d, "events").groupBy(clean.hash_bucket(F.col("event_id"), 1009).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'p_size' AS "column", bool_and(p_size = floor(p_size)) AND min(p_size) >= 0 AND max(p_size) < 60 AS categorical, CASE WHEN bool_and(p_size = floor(p_size)) AND min(p_size) >= 0 AND max(p_size) < 60 THEN max(p_size) + 1 ELSE 0 END AS categories FROM part
UNION ALL SELECT 'p_retailprice', bool_and(p_retailprice = floor(p_retailprice)) AND min(p_retailprice) >= 0 AND max(p_retailprice) < 60, CASE WHEN bool_and(p_retailprice = floor(p_retailprice)) AND min(p_retailprice) >= 0 AND max(p_retailprice) < 60 THEN (max(p_retailprice) + 1)::BIGINT ELSE 0 END FROM part""")
def category_detection(spark, d):
    return clean.category_counts(table(spark, d, "part"), ["p_size", "p_retailprice"], 60)


@query("""SELECT 'price' AS "column", count(*) FILTER (WHERE p IS NULL) AS nulls, 0 AS non_finite, count(*) FILTER (WHERE p <= 0) AS non_positive, coalesce(var_samp(p), 0) <= 1e-16 AS "constant" FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders)
UNION ALL SELECT 'balance', 0, 0, count(*) FILTER (WHERE c_acctbal <= 0), coalesce(var_samp(c_acctbal), 0) <= 1e-16 FROM customer""")
def numeric_checks(spark, d):
    a = clean.numeric_checks(holes(spark, d), ["price"])
    return a.union(clean.numeric_checks(table(spark, d, "customer").withColumnRenamed("c_acctbal", "balance"), ["balance"]))


@query("""WITH y AS (SELECT (l_returnflag = 'R')::INT::DOUBLE AS y FROM lineitem)
SELECT 0 AS bad_values, (SELECT (stddev_samp(l_quantity) <= 1e-8)::INT + (stddev_samp(l_tax) <= 1e-8)::INT FROM lineitem) AS constant_columns, round(stddev_samp(y), 6) AS target_std, round(avg(y), 6) AS balance, avg(y) BETWEEN 0.1 AND 0.9 AS passed FROM y""")
def data_quality_gate(spark, d):
    return r6("target_std", "balance", of=clean.quality_gate(table(spark, d, "lineitem"), ["l_quantity", "l_tax"], (F.col("l_returnflag") == "R").cast("double")))


@query("""SELECT 'o_orderkey' AS "column", 'bigint' AS type, count(*) AS rows, count(o_orderkey) AS present, count(DISTINCT o_orderkey) AS uniques, round(avg(o_orderkey), 4) AS mean, 0.0 AS missing_ratio, count(DISTINCT o_orderkey) > 1000 AS high_cardinality, min(o_orderkey)::VARCHAR AS low, max(o_orderkey)::VARCHAR AS high FROM orders
UNION ALL SELECT 'price', 'double', count(*), count(p), count(DISTINCT p), round(avg(p), 4), round(1 - count(p) / count(*), 6), count(DISTINCT p) > 1000, min(p)::VARCHAR, max(p)::VARCHAR FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders)
UNION ALL SELECT 'priority', 'string', count(*), count(p), count(DISTINCT p), NULL, round(1 - count(p) / count(*), 6), count(DISTINCT p) > 1000, min(p)::VARCHAR, max(p)::VARCHAR FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders)""")
def column_profile(spark, d):
    p = stats.profile(holes(spark, d), ["o_orderkey", "price", "priority"])
    return p.withColumn("mean", F.round("mean", 4)).withColumn("missing_ratio", F.round("missing_ratio", 6))


@query("SELECT l_shipdate AS value, count(*) AS c FROM lineitem GROUP BY 1 ORDER BY c DESC, value LIMIT 1")
def mode_of_column(spark, d):
    return stats.mode(table(spark, d, "lineitem"), "l_shipdate").withColumnRenamed("l_shipdate", "value")


@query("""SELECT 'user_id' AS "column", count(*) AS present, 'Int64' AS kind FROM events UNION ALL SELECT 'value', count(*), 'Float64' FROM events UNION ALL SELECT 'event_type', count(*), 'String' FROM events UNION ALL SELECT 'ts', count(*), 'DateTime' FROM events""")
def type_inference(spark, d):
    e = table(spark, d, "events").select(*[F.col(c).cast("string").alias(c) for c in ("user_id", "value", "event_type", "ts")])
    out = clean.inferred_type(e, "user_id")
    for c in ("value", "event_type", "ts"):
        out = out.union(clean.inferred_type(e, c))
    return out


@query("SELECT slice AS part, count(DISTINCT kind) <= 1 AS consistent FROM (SELECT event_id % 5 AS slice, CASE WHEN regexp_matches(event_type, '^[0-9]+$') THEN 'Int64' ELSE 'String' END AS kind FROM events) GROUP BY 1")
def type_consistency(spark, d):
    kind = F.when(F.col("event_type").try_cast("bigint").isNotNull(), "Int64").otherwise("String")
    return table(spark, d, "events").groupBy((F.col("event_id") % 5).alias("part")).agg((F.countDistinct(kind) <= 1).alias("consistent"))


EVENTS = "w AS (PARTITION BY user_id ORDER BY ts, event_id"


def events(spark, d):
    return table(spark, d, "events")


@query("SELECT event_id, round(avg(value) OVER w + 1e-9, 6) AS mean, round(coalesce(var_samp(value) OVER w, 0) + 1e-9, 6) AS variance FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING)")
def sliding_window_variance(spark, d):
    w = windows.last_rows(["user_id"], ["ts", "event_id"], 10)
    return events(spark, d).select("event_id", F.round(F.avg("value").over(w) + 1e-9, 6).alias("mean"), F.round(F.coalesce(F.var_samp("value").over(w), F.lit(0.0)) + 1e-9, 6).alias("variance"))


@query("WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) SELECT event_id, round(CASE WHEN i >= 2 THEN regr_slope(value, i) OVER (PARTITION BY user_id ORDER BY i ROWS 4 PRECEDING) END + 1e-9, 6) AS slope FROM n")
def trend_last_five(spark, d):
    n = events(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("double"))
    return r6("slope", of=n.select("event_id", (1e-9 + windows.slope(F.col("value"), F.col("i"), windows.last_rows(["user_id"], ["i"], 5))).alias("slope")))


@query("SELECT event_id, count(*) OVER w = 3 AND min(value) OVER w >= 20 AS stable FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING)")
def all_in_window(spark, d):
    w = windows.last_rows(["user_id"], ["ts", "event_id"], 3)
    return events(spark, d).select("event_id", ((F.count("value").over(w) == 3) & (F.min("value").over(w) >= 20)).alias("stable"))


@query("WITH g AS (SELECT *, sum(CASE WHEN value < 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS b FROM events) SELECT event_id, CASE WHEN value < 50 THEN sum(CASE WHEN value < 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, b ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS run FROM g")
def consecutive_runs(spark, d):
    return windows.runs(events(spark, d), F.col("value") < 50, ["user_id"], ["ts", "event_id"]).select("event_id", "run")


@query("SELECT event_id, coalesce(count(value) OVER w >= 10 AND stddev_samp(value) OVER w > 0 AND abs(value - avg(value) OVER w) > 2 * stddev_samp(value) OVER w, false) AS anomaly FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)")
def rolling_anomaly(spark, d):
    return events(spark, d).select("event_id", windows.rolling_anomaly(F.col("value"), ["user_id"], ["ts", "event_id"]).alias("anomaly"))


@query("WITH x AS (SELECT event_id, user_id, ts, value AS a, (event_id * 7919 % 101)::DOUBLE AS b FROM events) SELECT event_id, round(CASE WHEN var_pop(a) OVER w > 1e-12 AND var_pop(b) OVER w > 1e-12 THEN corr(a, b) OVER w END, 6) AS r, round(avg(abs(a - b)) OVER w + 1e-9, 6) AS mae, round(sqrt(avg((a - b) * (a - b)) OVER w) + 1e-9, 6) AS rmse FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 99 PRECEDING)")
def rolling_prediction_quality(spark, d):
    x = events(spark, d).select("event_id", "user_id", "ts", F.col("value").alias("a"), (F.col("event_id") * 7919 % 101).cast("double").alias("b"))
    w = windows.last_rows(["user_id"], ["ts", "event_id"], 100)
    e = F.col("a") - F.col("b")
    return x.select("event_id", F.round(windows.rolling_correlation(F.col("a"), F.col("b"), w), 6).alias("r"), F.round(F.avg(F.abs(e)).over(w) + 1e-9, 6).alias("mae"), F.round(F.sqrt(F.avg(e * e).over(w)) + 1e-9, 6).alias("rmse"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS centred FROM events")
def centred_moving_average(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 2)
    return events(spark, d).select("event_id", F.round(F.avg("value").over(w), 6).alias("centred"))


@query("""WITH RECURSIVE n AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
s AS (SELECT user_id, event_id, i, value AS v FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.event_id, n.i, 0.3 * n.value + 0.7 * s.v FROM s JOIN n ON n.user_id = s.user_id AND n.i = s.i + 1)
SELECT user_id, event_id, round(v, 6) AS smooth FROM s""")
def exponential_smoothing(spark, d):
    return r6("smooth", of=windows.smoothed(events(spark, d), "value", ["user_id"], "event_id"))


@query("SELECT event_id, coalesce(avg(value) OVER w > 50 AND value < 0.5 * avg(value) OVER w, false) AS dropped FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)")
def performance_drop(spark, d):
    avg = F.avg("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-10, -1))
    return events(spark, d).select("event_id", F.coalesce((avg > 50) & (F.col("value") < 0.5 * avg), F.lit(False)).alias("dropped"))


@query("SELECT user_id, round(regr_slope(value, event_id), 9) AS slope, count(*) AS n FROM events GROUP BY 1")
def linear_trend(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.round(F.regr_slope("value", F.col("event_id").cast("double")), 9).alias("slope"), F.count(F.lit(1)).alias("n"))


@query("WITH b AS (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, n, round(sum(n) OVER w / count(*) OVER w, 6) AS per_day, round((sum(n) OVER () - sum(n) OVER (ORDER BY day)) / (sum(n) OVER w / count(*) OVER w), 6) AS eta_days FROM b WINDOW w AS (ORDER BY day ROWS 5 PRECEDING)")
def throughput_and_eta(spark, d):
    b = events(spark, d).groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("day").rowsBetween(-5, 0)  # a row a day
    rate = F.sum("n").over(w) / F.count(F.lit(1)).over(w)
    left = F.sum("n").over(Window.partitionBy(F.lit(1))) - F.sum("n").over(Window.orderBy("day"))
    return r6("per_day", "eta_days", of=b.select("day", "n", rate.alias("per_day"), (left / rate).alias("eta_days")))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS ordinal, rank() OVER p + (count(*) OVER (PARTITION BY o_custkey, o_orderpriority) - 1) / 2 AS average_rank, count(*) OVER (PARTITION BY o_custkey) - row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) + 1 AS borda FROM orders WINDOW p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def ranks_and_borda(spark, d):
    o = table(spark, d, "orders")
    ordinal = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    mid = F.rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")) + (F.count(F.lit(1)).over(Window.partitionBy("o_custkey", "o_orderpriority")) - 1) / 2
    return o.select("o_orderkey", "o_custkey", ordinal.cast("long").alias("ordinal"), mid.alias("average_rank"), windows.borda(ordinal, ["o_custkey"]).alias("borda"))


@query("""SELECT part, count(*) AS n, round(sum(sig), 6) AS sigmoid, round(sum(pw), 6) AS performance, round(sum(ew), 6) AS exploration, round(sum(aw), 6) AS adaptive, round(sum(dw), 6) AS decayed FROM (
SELECT event_id % 10 AS part, 1 / (1 + exp(-(value - 50) / 10)) AS sig, 1 / (1 + exp(-5 * (value / 100 - 0.5))) AS pw, least(2, 1 + ln(greatest(1, event_id % 40)) / 10) AS ew,
0.4 * value / 100 + 0.3 * (event_id % 7) / 7 + 0.2 * (event_id % 5) / 5 + 0.1 * (event_id % 3) / 3 AS aw, value * pow(0.95, event_id % 20) AS dw FROM events) GROUP BY 1""")
def weight_functions(spark, d):
    e, i = events(spark, d), F.col("event_id")
    v = F.col("value")
    rows = e.select((i % 10).alias("part"), fn.sigmoid((v - 50) / 10).alias("sig"), fn.performance_weight(v / 100).alias("pw"), fn.exploration_weight(i % 40).alias("ew"), fn.adaptive_weight(v / 100, (i % 7) / 7, (i % 5) / 5, (i % 3) / 3).alias("aw"), fn.decayed(v, i % 20).alias("dw"))
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.sum(a), 6).alias(b) for a, b in (("sig", "sigmoid"), ("pw", "performance"), ("ew", "exploration"), ("aw", "adaptive"), ("dw", "decayed"))])


@query("SELECT p_partkey, round(CASE WHEN max(p_retailprice) OVER () > min(p_retailprice) OVER () THEN (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) ELSE 1 END, 6) AS scaled FROM part")
def min_max_normalise(spark, d):
    return r6("scaled", of=fn.min_max(table(spark, d, "part"), "p_retailprice", "scaled").select("p_partkey", "scaled"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, nullif(trim(event_type), '') AS kind, CASE WHEN value >= 1000 THEN round(value / 1000, 1) || 'K' ELSE round(value, 1)::VARCHAR END AS shown FROM events")
def json_and_text(spark, d):
    return events(spark, d).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), fn.optional_string(F.col("event_type")).alias("kind"), fn.short_number(F.col("value")).alias("shown"))


@query("SELECT i * (127 - i) // 2 + (j - i - 1) + 1 AS place, count(*) AS n FROM (SELECT l_partkey % 64 AS i, l_suppkey % 64 AS j FROM lineitem) WHERE i < j GROUP BY 1")
def packed_triangle_index(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_partkey") % 64).alias("i"), (F.col("l_suppkey") % 64).alias("j")).where("i < j")
    return li.groupBy(fn.packed_index(F.col("i"), F.col("j"), 64).alias("place")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey % 1000 AS mask, list_sort(list_filter(range(1, 11), lambda b: ((l_orderkey % 1000) >> (b - 1)) & 1 = 1)) AS bits, count(*) AS n FROM lineitem GROUP BY 1, 2")
def mask_to_indices(spark, d):
    m = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 1000).alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    return m.select("mask", fn.mask_indices(F.col("mask"), 10).alias("bits"), "n")


@query("SELECT o_orderkey, o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY AS recent FROM orders")
def date_cutoff(spark, d):
    o = table(spark, d, "orders")
    last = F.broadcast(o.agg(F.max("o_orderdate").alias("last")))
    return o.crossJoin(last).select("o_orderkey", (F.col("o_orderdate") >= F.col("last") - F.expr("INTERVAL 90 DAY")).alias("recent"))


@query(r"SELECT p_partkey, replace(replace(replace(replace(p_brand || '_' || p_type, '&', '\&'), '%', '\%'), '#', '\#'), '_', '\_') AS escaped FROM part")
def latex_escape(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.latex_escaped(F.concat_ws("_", "p_brand", "p_type")).alias("escaped"))
