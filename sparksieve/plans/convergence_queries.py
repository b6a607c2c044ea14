"""Queries of convergence, diversity, sampling and joins on ranges; rounds are days of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import convergence as cv
from ..operators import sets, stats, voting
from ..registry import query, r6, table
from .ensemble_queries import RAW, SETS, raw_votes, tree_sets
from .stage1_queries import LF, PAIRS, features

#: A run's settings, scaled to a month of rounds.
SETTINGS = cv.Detector(window=12, least_rounds=6, most_rounds=28, patience=4, stable_windows=3, interval=3, test_window=8, sensitivity=0.004, variance=0.0008)
ROUNDS = """rounds AS (
  SELECT event_type, date_trunc('day', ts) AS day, 0.9::DOUBLE + (sum(event_id * 7) % 11)::DOUBLE / 100 AS stability, 0.7::DOUBLE + (sum(event_id) % 31)::DOUBLE / 100 AS consensus,
         (sum(event_id) % 26)::DOUBLE / 100 AS entropy, 0.7::DOUBLE + (count(*) % 31)::DOUBLE / 100 AS agreement FROM events GROUP BY ALL),
n AS (
  SELECT *, row_number() OVER w AS r, CASE WHEN count(*) OVER p >= 10 THEN regr_slope(stability, rn) OVER p END AS slope
  FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day)::DOUBLE AS rn FROM rounds)
  WINDOW w AS (PARTITION BY event_type ORDER BY day), p AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))"""


def adaptation_sql(mode, step):
    """The thresholds of a mode by recursion over its steps: t_<mode> (event_type, k, t), k the number of steps made."""
    aim = f"greatest(0.8::DOUBLE, least(0.95::DOUBLE, {step}))"
    return f"t_{mode} AS (SELECT DISTINCT event_type, 0 AS k, 0.95::DOUBLE AS t FROM rounds UNION ALL SELECT p.event_type, k + 1, CASE WHEN abs({aim} - t) > 0.01 THEN {aim} ELSE t END FROM t_{mode} p JOIN n ON n.event_type = p.event_type AND n.r = 3 * (k + 1))"


STEPS = {"linear": "0.95::DOUBLE - r / 28::DOUBLE * (0.95::DOUBLE - 0.8::DOUBLE)", "exponential": "0.95::DOUBLE * pow(0.99::DOUBLE, r / 3::DOUBLE)", "problem": "t * CASE WHEN slope > 0.001 THEN 1.01::DOUBLE WHEN slope < -0.001 THEN 0.99::DOUBLE ELSE 1 END", "performance": "t * CASE WHEN consensus > 0.9::DOUBLE THEN 0.98::DOUBLE ELSE 1 END"}


def rounds(spark, d):
    ids = F.sum("event_id")
    out = table(spark, d, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day"))
    return out.agg((0.9 + (F.sum(F.col("event_id") * 7) % 11) / 100).alias("stability"), (0.7 + (ids % 31) / 100).alias("consensus"), ((ids % 26) / 100).alias("entropy"), (0.7 + (F.count(F.lit(1)) % 31) / 100).alias("agreement"))


@query(f"""WITH RECURSIVE {ROUNDS}, {adaptation_sql("performance", STEPS["performance"])},
x AS (SELECT n.*, a.t AS before, b.t AS adapted FROM n JOIN t_performance a ON a.event_type = n.event_type AND a.k = (r - 1) // 3 JOIN t_performance b ON b.event_type = n.event_type AND b.k = r // 3),
y AS (SELECT *, count(*) OVER m = 3 AND min(stability) OVER m >= before - 0.02 AS stable, CASE WHEN count(*) OVER f = 5 THEN round(regr_slope(stability, r) OVER f, 12) ELSE 0 END AS trend, CASE WHEN count(*) OVER v = 8 THEN var_samp(stability) OVER v END AS spread
  FROM x WINDOW m AS (PARTITION BY event_type ORDER BY day ROWS 2 PRECEDING), f AS (PARTITION BY event_type ORDER BY day ROWS 4 PRECEDING), v AS (PARTITION BY event_type ORDER BY day ROWS 7 PRECEDING)),
z AS (SELECT *, r - coalesce(max(CASE WHEN NOT stable THEN r END) OVER (PARTITION BY event_type ORDER BY day), 0) AS run FROM y),
q AS (SELECT *, stability >= adapted AND run >= 3 AS a, consensus >= 0.9::DOUBLE AS b, entropy <= 0.1::DOUBLE AS c FROM z)
SELECT event_type, day, r AS round, run, round(adapted, 6) AS adapted, CASE WHEN r < 6 THEN false WHEN r >= 28 THEN true ELSE a END AS by_stability, CASE WHEN r < 6 THEN false WHEN r >= 28 THEN true ELSE b END AS by_consensus,
  CASE WHEN r < 6 THEN false WHEN r >= 28 THEN true ELSE c END AS by_entropy, CASE WHEN r < 6 THEN false WHEN r >= 28 THEN true ELSE a::INT + b::INT + c::INT >= 2 END AS by_majority,
  CASE WHEN r < 6 THEN false WHEN r >= 28 THEN true ELSE (stability > 0.95::DOUBLE AND consensus > 0.9::DOUBLE) OR (entropy < 0.1::DOUBLE AND run >= 3) END AS by_state,
  run >= 4 AS stop_fixed, coalesce(spread < 0.0008, false) AS stop_variance, r >= 20 AND abs(trend) < 0.004 AS stop_plateau, agreement >= 0.85::DOUBLE AS stop_agreement,
  (run >= 3)::INT + (consensus >= 0.85::DOUBLE)::INT + (entropy <= 0.2::DOUBLE)::INT + (abs(trend) < 0.01)::INT >= 3 AS stop_adaptive FROM q""")
def stop_criteria(spark, d):
    return r6("adapted", of=cv.convergence(rounds(spark, d), ["event_type"], "day", "performance", SETTINGS).drop("stability", "consensus", "entropy", "agreement"))


@query(f"""WITH RECURSIVE {ROUNDS}, {", ".join(adaptation_sql(m, s) for m, s in STEPS.items())}
SELECT n.event_type, day, {", ".join(f"round(t_{m}.t, 6) AS {m}" for m in STEPS)} FROM n {" ".join(f"JOIN t_{m} ON t_{m}.event_type = n.event_type AND t_{m}.k = r // 3" for m in STEPS)}""")
def threshold_adaptation(spark, d):
    x, out = rounds(spark, d), None
    for mode in STEPS:
        one = cv.with_thresholds(x, ["event_type"], "day", mode, SETTINGS).select("event_type", "day", F.round("adapted", 6).alias(mode))
        out = one if out is None else out.join(one, ["event_type", "day"])
    return out


_JAC = "len(list_intersect(a.features, b.features)) / greatest(1, len(list_distinct(list_concat(a.features, b.features))))"


@query(f"""WITH {SETS}, o AS (SELECT avg({_JAC}) AS o FROM sets a JOIN sets b ON a.tree_id < b.tree_id),
u AS (SELECT f, count(*) AS c FROM (SELECT unnest(features) AS f FROM sets) GROUP BY 1), e AS (SELECT sum(-p * log2(p)) / log2(count(*)) AS e FROM (SELECT c / sum(c) OVER () AS p FROM u)),
z AS (SELECT var_samp(len(features)) AS v, max(len(features)) - min(len(features)) AS r, count(DISTINCT array_to_string(features, ',')) / count(*) AS q FROM sets)
SELECT round(0.4 * (1 - o) + 0.3 * e + 0.2 * CASE WHEN r > 0 THEN least(1.0, v / (r * r / 12.0)) ELSE 0 END + 0.1 * q, 6) AS diversity FROM o, e, z""")
def ensemble_diversity(spark, d):
    t = tree_sets(spark, d)
    overlap = sets.overlap_summary(t, "tree_id", "features").select(F.col("mean").alias("o"))
    entropy = voting.selection_entropy(t.select(F.explode("features").alias("feature_id"))).select(F.col("entropy").alias("e"))
    size = F.size("features")
    z = t.agg(F.var_samp(size).alias("v"), (F.max(size) - F.min(size)).alias("r"), (F.countDistinct("features") / F.count(F.lit(1))).alias("q"))
    one = overlap.crossJoin(entropy).crossJoin(z)  # one row each
    return r6("diversity", of=one.select(cv.diversity(F.col("o"), F.col("e"), F.col("v"), F.col("r"), F.col("q")).alias("diversity")))


@query("WITH u AS (SELECT l_suppkey % 20 AS tree_id, l_partkey % 50 AS feature_id, count(*) AS used FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY round(-ln((((tree_id * 64 + feature_id) * 2654435761) % 1000003 + 0.5) / 1000003) * (1 + used), 12), feature_id) AS r FROM u) SELECT tree_id, feature_id, used FROM k WHERE r <= 10")
def masking_draw(spark, d):
    u = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("tree_id"), (F.col("l_partkey") % 50).alias("feature_id")).agg(F.count(F.lit(1)).alias("used"))
    return cv.weighted_draw(u, 1 / (1 + F.col("used")), cv.hash_uniform(F.col("tree_id") * 64 + F.col("feature_id")), ["tree_id"], 10, "feature_id")


@query("SELECT s_suppkey AS tree_id, list_sort(list(f)) AS features FROM (SELECT s_suppkey, unnest(range(50)) AS f FROM supplier) WHERE (((s_suppkey * 64 + f) * 2654435761) % 1000003 + 0.5) / 1000003 < 0.7 GROUP BY 1")
def feature_subsampling(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))).alias("f"))
    return s.where(cv.hash_uniform(F.col("s_suppkey") * 64 + F.col("f")) < 0.7).groupBy(F.col("s_suppkey").alias("tree_id")).agg(F.array_sort(F.collect_list("f")).alias("features"))


@query(f"WITH {RAW}, l AS (SELECT tree_id, feature_id, avg(performance) AS score FROM raw GROUP BY ALL) SELECT tree_id, feature_id, round(0.9 * score + 0.1 * avg(score) OVER (PARTITION BY feature_id) + 1e-9, 6) AS shared FROM l")
def cross_tree_learning(spark, d):
    local = raw_votes(spark, d).groupBy("tree_id", "feature_id").agg(F.avg("performance").alias("score"))
    return cv.shared_learning(local, 0.1).select("tree_id", "feature_id", F.round(F.col("shared") + 1e-9, 6).alias("shared"))


@query("WITH e AS (SELECT event_id, pow(abs(value - 50) + 1e-6, 0.6) AS q FROM events), p AS (SELECT event_id, q / sum(q) OVER () AS p, count(*) OVER () AS n FROM e) SELECT event_id, round(p * 1e4, 6) AS probability, round(pow(n * p, -0.4) / max(pow(n * p, -0.4)) OVER (), 6) AS importance FROM p")
def prioritised_replay(spark, d):
    e = cv.replay_weights(table(spark, d, "events").select("event_id", "value"), F.col("value") - 50)
    return e.select("event_id", F.round(F.col("probability") * 1e4, 6).alias("probability"), F.round("importance", 6).alias("importance"))


@query("WITH m AS (SELECT o_orderkey, o_totalprice, (o_orderstatus = 'P')::INT AS y FROM orders), k AS (SELECT avg(y) <= 0.5 AS ones FROM m) SELECT o_orderkey, 0 AS copy, round(o_totalprice, 2) AS o_totalprice FROM m UNION ALL SELECT o_orderkey, c AS copy, round(o_totalprice * (1 + 0.1 * (2 * ((((o_orderkey * 31 + c) * 2654435761) % 1000003 + 0.5) / 1000003) - 1)), 2) FROM m, k, range(1, 3) t(c) WHERE (y = 1) = ones")
def minority_jitter(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return cv.jittered_minority(o, F.col("o_orderstatus") == "P", "o_totalprice", "o_orderkey", copies=2).select("o_orderkey", "copy", F.round("o_totalprice", 2).alias("o_totalprice"))


@query(f"WITH {LF}, {PAIRS} SELECT feature, round(sum(abs(r)), 6) AS importance FROM (SELECT f1 AS feature, r FROM pairs UNION ALL SELECT f2, r FROM pairs) GROUP BY 1")
def interaction_importance(spark, d):
    p = stats.correlation_pairs(features(spark, d))
    return r6("importance", of=p.select(F.explode(F.array("f1", "f2")).alias("feature"), F.abs("r").alias("r")).groupBy("feature").agg(F.sum("r").alias("importance")))


@query(f"WITH {LF}, {PAIRS} SELECT f1, f2, round(r, 6) AS r FROM pairs WHERE abs(r) >= 0.05 ORDER BY abs(r) DESC, f1, f2 LIMIT 20")
def strongest_interactions(spark, d):
    p = stats.correlation_pairs(features(spark, d), 0.05)
    return r6("r", of=p.orderBy(F.desc(F.abs("r")), "f1", "f2").limit(20))


@query("WITH s AS (SELECT l_partkey % 200 AS f, avg(l_quantity) AS a, avg(l_discount) AS b, avg(l_extendedprice) AS c FROM lineitem GROUP BY 1), t AS (SELECT *, 0.5 * a / 50 + 0.3 * b * 10 + 0.2 * c / 60000 AS total FROM s) SELECT round(abs(corr(a, total)), 6) AS a, round(abs(corr(b, total)), 6) AS b, round(abs(corr(c, total)), 6) AS c FROM t")
def method_contributions(spark, d):
    s = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 200).alias("f")).agg(F.avg("l_quantity").alias("a"), F.avg("l_discount").alias("b"), F.avg("l_extendedprice").alias("c"))
    t = s.withColumn("total", 0.5 * F.col("a") / 50 + 0.3 * F.col("b") * 10 + 0.2 * F.col("c") / 60000)
    return r6("a", "b", "c", of=t.agg(*[F.abs(F.corr(x, "total")).alias(x) for x in ("a", "b", "c")]))


@query("SELECT s_nationkey AS worker, count(*) AS results, count(DISTINCT l_suppkey) AS trees, round(avg(l_discount), 6) AS mean, min(l_shipdate) AS first FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def worker_statistics(spark, d):
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    out = li.join(s, F.col("s_suppkey") == F.col("l_suppkey")).groupBy(F.col("s_nationkey").alias("worker")).agg(F.count(F.lit(1)).alias("results"), F.countDistinct("l_suppkey").alias("trees"), F.avg("l_discount").alias("mean"), F.min("l_shipdate").alias("first"))
    return r6("mean", of=out)


@query("WITH e AS (SELECT p_size % 10 AS k, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1), b AS (SELECT i, 900 + 100 * i AS lo, 1000 + 100 * i AS hi FROM range(0, 20) t(i)) SELECT i AS bin, count(*) AS n FROM part JOIN b ON p_retailprice >= lo AND p_retailprice < hi GROUP BY 1")
def range_join_bins(spark, d):
    """A range join on equal bins is an equality join on the bin that arithmetic gives."""
    p = table(spark, d, "part").select(F.floor((F.col("p_retailprice") - 900) / 100).alias("bin"))
    return p.where(F.col("bin").between(0, 19)).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query()
def logistic_by_gradient(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount")
    names = li.columns
    w = cv.logistic_by_gradient(li, names, F.col("l_extendedprice") / F.col("l_quantity") > 1400)
    return r6("weight", of=spark.createDataFrame(list(zip([*names, "bias"], w)), "feature string, weight double"))
