"""Queries of rolling rank statistics, tracked predictions, streamed information and custom statistics; predictions are made of events."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import information as info
from ..operators import windows
from ..operators.longform import from_wide
from ..operators.quantiles import exact_quantiles
from ..registry import query, r6, table
from ..streaming import streams, tracking

#: SQL of the metrics of each user's last 1,000 predictions, at every tenth.
_PAIRS = "x AS (SELECT user_id, event_id, value AS a, (event_id * 7919 % 101)::DOUBLE AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)"
_WINDOWS = f"""{_PAIRS},
w AS (SELECT t.user_id, t.event_id, t.p AS upto, s.p, s.a, s.b FROM x t JOIN x s ON s.user_id = t.user_id AND s.p BETWEEN t.p - 999 AND t.p WHERE t.p % 10 = 0),
r AS (SELECT *, rank() OVER (PARTITION BY user_id, upto ORDER BY a) + (count(*) OVER (PARTITION BY user_id, upto, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY user_id, upto ORDER BY b) + (count(*) OVER (PARTITION BY user_id, upto, b) - 1) / 2.0 AS rb FROM w),
s AS (SELECT user_id, event_id, upto, count(*) AS n, coalesce(CASE WHEN var_pop(a) > 1e-12 AND var_pop(b) > 1e-12 THEN corr(a, b) END, 0) AS pearson, CASE WHEN var_pop(ra) > 0 AND var_pop(rb) > 0 THEN corr(ra, rb) ELSE 0 END AS spearman, avg(abs(a - b)) AS mae, sqrt(avg((a - b) * (a - b))) AS rmse FROM r GROUP BY ALL),
k AS (SELECT i.user_id, i.upto, sum(sign(i.a - j.a) * sign(i.b - j.b)) AS c FROM w i JOIN w j ON i.user_id = j.user_id AND i.upto = j.upto AND i.p < j.p GROUP BY ALL)"""


@query(f"WITH {_WINDOWS} SELECT s.user_id, event_id, s.upto AS position, n, round(spearman, 6) AS spearman, round(2 * c / (n * (n - 1)), 6) AS kendall FROM s JOIN k ON k.user_id = s.user_id AND k.upto = s.upto")
def rolling_rank_correlations(spark, d):
    x = table(spark, d, "events").select("user_id", "event_id", F.col("value").alias("a"), (F.col("event_id") * 7919 % 101).cast("double").alias("b"))
    return r6("spearman", "kendall", of=windows.rolling_ranks(x, ["user_id"], ["event_id"], "a", "b"))


@query(f"WITH {_WINDOWS} SELECT s.user_id, event_id, s.upto AS total, n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(2 * c / (n * (n - 1)), 6) AS kendall, round(mae, 6) AS mae, round(rmse, 6) AS rmse FROM s JOIN k ON k.user_id = s.user_id AND k.upto = s.upto")
def tracked_predictions(spark, d):
    """The events as a stream: each user's ring of the last 1,000, looked at at every tenth."""
    e = streams.stream(spark, f"{d}/events.parquet").select("user_id", "event_id", F.col("value").alias("a"), (F.col("event_id") * 7919 % 101).cast("double").alias("b"))
    with tracking.with_store(spark):
        got = streams.drained(tracking.tracked(e, "user_id", "event_id", "a", "b"), "tracked", "append")
    return r6(*tracking.METRICS, of=got)


_LONG = "l AS (SELECT f AS feature, v AS value, y FROM (SELECT (l_returnflag = 'R')::INT AS y, l_quantity, l_extendedprice, l_discount FROM lineitem) UNPIVOT (v FOR f IN (l_quantity, l_extendedprice, l_discount)))"


@query(f"""WITH {_LONG}, b AS (SELECT feature, y, CASE WHEN high <= low THEN 1 ELSE least(floor((value - low) / ((high - low) / 10)) + 1, 10) END AS bin FROM l JOIN (SELECT feature, min(value) AS low, max(value) AS high FROM l GROUP BY 1) USING (feature)),
p AS (SELECT feature, c, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, bin) AS nx, sum(c) OVER (PARTITION BY feature, y) AS ny FROM (SELECT feature, bin, y, count(*) AS c FROM b GROUP BY ALL))
SELECT feature, round(greatest(0.0, sum(c / n * ln(c * n / (nx * ny)))), 6) AS mi FROM p GROUP BY 1""")
def stream_mutual_information(spark, d):
    """Edges by a pass over the table, joint counts by a stream of it."""
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    long = lambda df: from_wide(df.withColumn("id", F.lit(0)), "id", F.col("l_returnflag") == "R", names)
    counts = streams.drained(streams.joint_counts(long(streams.stream(spark, f"{d}/lineitem.parquet")), info.value_ranges(long(table(spark, d, "lineitem")))), "mi", "complete")
    return r6("mi", of=info.counted_information(counts))


@query("SELECT event_type, round(quantile_cont(value, 0.05), 6) AS low, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS high FROM events GROUP BY 1")
def grouped_quantiles(spark, d):
    q = exact_quantiles(table(spark, d, "events"), ["event_type"], "value", [0.05, 0.5, 0.95], "q")
    return r6("low", "median", "high", of=q.select("event_type", F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high")))


@query()
def custom_statistic_tests(spark, d):
    """Medians of customers' yearly spending in two halves of the keys, by segment: is the difference one of chance?"""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").cast("double").alias("spent"))
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(o, "c_custkey")
    got = ev.custom_permutation_test(c, ["c_mktsegment"], "c_custkey", "spent", F.col("c_custkey") % 2 == 0, lambda a, b: float(np.median(a) - np.median(b)), 2000)
    return r6("statistic", "p", of=got)
