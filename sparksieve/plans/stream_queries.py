"""Queries of streams and of the run catalogue; runs are orders, children line items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import query, r6, table
from ..shared import scratch
from ..sources import catalog, tables
from ..streaming import streams


def events(spark, d):
    return streams.stream(spark, f"{d}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS variance FROM events GROUP BY 1")
def stream_moments(spark, d):
    return r6("mean", "variance", of=streams.drained(streams.moments(events(spark, d), "event_type", "value"), "moments", "complete"))


@query("SELECT event_type, count(*) AS n, round(corr(value, (event_id % 97)::DOUBLE), 6) AS r FROM events GROUP BY 1")
def stream_correlation(spark, d):
    return r6("r", of=streams.drained(streams.correlation(events(spark, d), "event_type", F.col("value"), (F.col("event_id") % 97).cast("double")), "correlation", "complete"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(corr(value, (event_id % 97)::DOUBLE), 6) AS r, count(*) FILTER (WHERE value <= 50) AS le_50 FROM events GROUP BY 1")
def stream_pipeline(spark, d):
    """Moments, correlation and histogram of one stream, side by side."""
    e = events(spark, d)
    got = streams.drained_all({
        "moments": (streams.moments(e, "event_type", "value"), "complete"),
        "correlation": (streams.correlation(e, "event_type", F.col("value"), (F.col("event_id") % 97).cast("double")), "complete"),
        "histogram": (streams.histogram(e, "event_type", "value", [50]), "complete"),
    })
    both = got["moments"].join(got["correlation"].select("event_type", "r"), "event_type").join(got["histogram"].select("event_type", "le_50"), "event_type")
    return r6("mean", "r", of=both.select("event_type", "n", "mean", "r", "le_50"))


@query("SELECT event_type, count(*) FILTER (WHERE value <= 10) AS le_10, count(*) FILTER (WHERE value <= 50) AS le_50, count(*) FILTER (WHERE value <= 90) AS le_90, count(value) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_histogram(spark, d):
    return streams.drained(streams.histogram(events(spark, d), "event_type", "value", [10, 50, 90]), "histogram", "complete").withColumn("total", F.round("total", 4))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling_windows(spark, d):
    w = events(spark, d).withWatermark("at", "1 hour").groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return streams.drained(w, "tumbling", "complete").select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("WITH w AS (SELECT date_trunc('day', ts) AS day, value FROM events UNION ALL SELECT date_trunc('day', ts) - INTERVAL 1 DAY, value FROM events) SELECT day, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1")
def stream_sliding_windows(spark, d):
    w = events(spark, d).groupBy(F.window("at", "2 days", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return streams.drained(w, "sliding", "complete").select(F.col("w.start").cast("timestamp_ntz").alias("day"), "n", F.round("total", 4).alias("total"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR AND ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(DISTINCT k) AS sessions, count(*) AS n FROM s GROUP BY 1")
def stream_sessions(spark, d):
    s = events(spark, d).groupBy("user_id", F.session_window("at", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return streams.drained(s, "sessions", "complete").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("n"))


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def stream_deduplicated(spark, d):
    e = events(spark, d).withWatermark("at", "365 days")
    # ids older than the watermark leave the state
    return streams.drained(e.union(e).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type"), "distinct", "append").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("WITH l AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) SELECT user_id, count(*) AS n, round(avg(value) + 1e-9, 6) AS mean, min(value) AS low FROM l WHERE r <= 20 GROUP BY 1")
def stream_ring_buffer(spark, d):
    got = streams.drained(streams.ring_buffer(events(spark, d), "user_id", "event_id", "value", 20).withColumn("at", F.current_timestamp()), "ring", "update")
    return catalog.latest(got, ["user_id"], "at").select("user_id", "n", F.round(F.col("mean") + 1e-9, 6).alias("mean"), "low")


@query("WITH e AS (SELECT event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) SELECT event_type, count(*) AS n, round(sum(CASE WHEN nxt IS NOT NULL THEN least(epoch(nxt) - epoch(ts), 3600) END), 2) AS busy_seconds FROM e GROUP BY 1")
def event_timeline(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    nxt = F.lead("at").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    sec = lambda c: F.unix_micros(c) / 1e6
    rows = e.select("event_type", F.when(nxt.isNotNull(), F.least(sec(nxt) - sec(F.col("at")), F.lit(3600.0))).alias("s"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s"), 2).alias("busy_seconds"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3")
def retention_keep_latest(spark, d):
    o = table(spark, d, "orders")
    return catalog.kept_latest(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_totalprice")


@query("WITH k AS (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01') SELECT (SELECT count(*) FROM k) AS runs, count(*) AS children FROM lineitem SEMI JOIN k ON o_orderkey = l_orderkey")
def cascade_cleanup(spark, d):
    runs, children = catalog.without_old_runs(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    return runs.agg(F.count(F.lit(1)).alias("runs")).crossJoin(children.agg(F.count(F.lit(1)).alias("children")))  # one row each


@query("SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1")
def latest_by_key(spark, d):
    return catalog.latest(table(spark, d, "events").select("user_id", "event_id", "value").withColumn("o", F.col("event_id")), ["user_id"], "o").select("user_id", "value", "event_id")


@query("SELECT o_orderpriority AS run_id, count(*) AS features, round(max(s), 4) AS best FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY s DESC, o_custkey) AS r FROM (SELECT o_orderpriority, o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY ALL)) WHERE r <= 25 GROUP BY 1")
def catalogue_round_trip(spark, d):
    root = scratch(spark, "catalogue")
    s = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("run_id"), F.col("o_custkey").cast("string").alias("feature")).agg(F.sum("o_totalprice").alias("score"))
    w = Window.partitionBy("run_id").orderBy(F.desc("score"), F.col("feature").cast("long"))
    catalog.append(s.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 25"), root, "selected_features")
    back = catalog.load(spark, root, "selected_features")
    return back.groupBy("run_id").agg(F.count(F.lit(1)).alias("features"), F.round(F.max("score"), 4).alias("best"))


@query("SELECT r_regionkey, json_object('r_regionkey', r_regionkey, 'nations', n, 'customers', c)::VARCHAR AS json FROM (SELECT r_regionkey, count(DISTINCT n_nationkey) AS n, count(c_custkey) AS c FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)")
def results_json(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    per = n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.countDistinct("n_nationkey").alias("nations"), F.count("c_custkey").alias("customers"))
    return per.select("r_regionkey", F.to_json(F.struct("r_regionkey", "nations", "customers")).alias("json"))


@query("SELECT 'events_total{type=\"' || event_type || '\"} ' || count(*) AS line, '# TYPE events_total counter' AS header FROM events GROUP BY event_type")
def prometheus_lines(spark, d):
    n = table(spark, d, "events").groupBy(F.col("event_type").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return catalog.prometheus(n, "events_total", "counter", ["type"], "n")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 500")
def keyed_page(spark, d):
    o = tables.scan(spark, f"{d}/orders.parquet", ["o_orderkey", "o_totalprice"], "o_orderstatus = 'F'")
    return tables.page(o, "o_orderkey", 1000, 500)


@query("WITH c AS (SELECT o_orderkey // 1000 AS k, min(o_orderkey) AS a, count(*) AS rows FROM orders GROUP BY 1) SELECT a AS \"offset\", rows, coalesce(a = lag(a + rows) OVER (ORDER BY a), true) AS contiguous FROM c")
def chunk_integrity(spark, d):
    c = table(spark, d, "orders").groupBy(F.floor(F.col("o_orderkey") / 1000).alias("k")).agg(F.min("o_orderkey").alias("offset"), F.count(F.lit(1)).alias("rows"))
    return tables.chunk_gaps(c)


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def best_results(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)
