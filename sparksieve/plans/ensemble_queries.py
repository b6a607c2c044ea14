"""Queries of sets, votes, consensus, convergence, diversity and rankings.

Trees are the suppliers, a tree's features the parts modulo 50; runs are
order years, folds order keys modulo 5.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sets, voting
from ..registry import query, r6, table

RAW = "raw AS (SELECT l_suppkey AS tree_id, l_partkey % 50 AS feature_id, l_discount * 10 AS performance, l_linenumber::DOUBLE AS depth, l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS seq FROM lineitem)"
VOTES = f"""{RAW}, first AS (SELECT tree_id, feature_id, min(seq) AS seq, count(*) AS cast_n FROM raw GROUP BY ALL),
votes AS (SELECT tree_id, feature_id, min(performance) AS performance, min(depth) AS depth, any_value(cast_n) - 1 AS rejected FROM first JOIN raw USING (tree_id, feature_id, seq) GROUP BY tree_id, feature_id)"""
SETS = "sets AS (SELECT l_suppkey AS tree_id, list_sort(list(DISTINCT l_partkey % 50)) AS features FROM lineitem GROUP BY 1)"


def raw_votes(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("tree_id"), (F.col("l_partkey") % 50).alias("feature_id"), (F.col("l_discount") * 10).alias("performance"), F.col("l_linenumber").cast("double").alias("depth"), (F.col("l_orderkey") * 10000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("seq"))


def votes(spark, d):
    # rows that share a sequence number have the smallest performance and depth, as struct order takes them
    raw = raw_votes(spark, d).groupBy("tree_id", "feature_id", "seq").agg(F.min("performance").alias("performance"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("k"))
    one = raw.groupBy("tree_id", "feature_id").agg(F.min_by(F.struct("performance", "depth"), "seq").alias("v"), F.sum("k").alias("k"))
    return one.select("tree_id", "feature_id", "v.performance", "v.depth", (F.col("k") - 1).alias("rejected"))


def tree_sets(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("tree_id")).agg(F.array_sort(F.collect_set(F.col("l_partkey") % 50)).alias("features"))


@query(f"WITH {VOTES} SELECT tree_id, feature_id, round(performance, 4) AS performance, depth, rejected FROM votes")
def cast_votes(spark, d):
    return votes(spark, d).withColumn("performance", F.round("performance", 4))


WEIGHTS = f"""{VOTES}, used AS (SELECT feature_id, count(*) AS u FROM votes GROUP BY 1),
weights AS (SELECT tree_id, (0.4 / (1 + exp(-5 * (avg(performance) - 0.5))) + 0.3 * least(2.0, 1 + ln(greatest(1.0, avg(depth))) / 10) + 0.2 * avg(1 / u) + 0.1 * 0.5) * pow(0.95, 3) AS weight FROM votes JOIN used USING (feature_id) GROUP BY 1),
cons AS (SELECT feature_id, count(*) AS votes, sum(weight) / (SELECT count(*) FROM weights) AS score, avg(performance) AS performance, avg(depth) AS exploration FROM votes JOIN weights USING (tree_id) GROUP BY 1)"""


def weights(spark, d):
    return voting.tree_weights(votes(spark, d), F.lit(0.5), F.lit(3))


def scores(spark, d):
    return voting.consensus(votes(spark, d), weights(spark, d))


@query(f"WITH {WEIGHTS} SELECT tree_id, round(weight, 6) AS weight FROM weights")
def tree_weights(spark, d):
    return r6("weight", of=weights(spark, d))


@query(f"WITH {WEIGHTS}, k AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, round(performance, 9) DESC, feature_id) AS rank, 0.8 * max(score) OVER () AS t FROM cons) SELECT feature_id, votes, round(score, 6) AS score, rank FROM k WHERE (score >= t AND rank <= 20) OR rank <= 5")
def build_consensus(spark, d):
    s = scores(spark, d)
    out = voting.build_consensus(s, voting.consensus_threshold(s, "relative"), 20, 5)
    return r6("score", of=out).select("feature_id", "votes", "score", "rank")


@query(f"WITH {WEIGHTS} SELECT count(*) FILTER (WHERE score >= 0.3) AS absolute, count(*) FILTER (WHERE score >= 0.8 * m) AS relative, count(*) FILTER (WHERE score >= 0.3 * 0.88) AS dynamic, count(*) FILTER (WHERE score >= 0.3 * 1.25) AS progressive FROM (SELECT *, max(score) OVER () AS m FROM cons)")
def consensus_thresholds(spark, d):
    s = scores(spark, d)
    kinds = {"absolute": {}, "relative": {}, "dynamic": {"stability": 0.4}, "progressive": {"progress": 0.5}}
    marked = s.select(*[(F.col("score") >= voting.consensus_threshold(s, k, 0.3, **o)).alias(k) for k, o in kinds.items()])
    return marked.agg(*[F.count_if(k).alias(k) for k in kinds])


@query(f"WITH {RAW}, c AS (SELECT count(*) AS c FROM raw GROUP BY feature_id), p AS (SELECT c / sum(c) OVER () AS p FROM c) SELECT round(sum(-p * log2(p)) / log2(count(*)), 6) AS entropy FROM p")
def selection_entropy(spark, d):
    return r6("entropy", of=voting.selection_entropy(raw_votes(spark, d)))


@query(f"WITH {SETS} SELECT round(1 / (1 + stddev_samp(len(features)) / avg(len(features))), 6) AS agreement FROM sets")
def agreement_coefficient(spark, d):
    return r6("agreement", of=tree_sets(spark, d).agg(voting.agreement(F.size("features")).alias("agreement")))


_JAC = "CASE WHEN len(list_distinct(list_concat(a.features, b.features))) > 0 THEN len(list_intersect(a.features, b.features)) / len(list_distinct(list_concat(a.features, b.features))) ELSE 0 END"


@query(f"WITH {SETS} SELECT a.tree_id AS a, b.tree_id AS b, round({_JAC}, 6) AS jaccard FROM sets a JOIN sets b ON a.tree_id < b.tree_id WHERE len(list_intersect(a.features, b.features)) > 0")
def tree_overlap_pairs(spark, d):
    return r6("jaccard", of=sets.overlap_pairs(tree_sets(spark, d), "tree_id", "features"))


@query(f"WITH {SETS}, j AS (SELECT {_JAC} AS j FROM sets a JOIN sets b ON a.tree_id < b.tree_id) SELECT round(avg(j), 6) AS mean, round(max(j), 6) AS high, round(min(j), 6) AS low FROM j")
def tree_overlap_summary(spark, d):
    return r6("mean", "high", "low", of=sets.overlap_summary(tree_sets(spark, d), "tree_id", "features"))


@query(f"WITH {SETS}, u AS (SELECT unnest(features) AS f, tree_id FROM sets), t AS (SELECT count(DISTINCT tree_id) AS n FROM u) SELECT f AS feature_id, count(*) AS trees, round(count(*) / any_value(n), 6) AS share, count(*) >= ceil(any_value(n) * 0.5) AS consensus FROM u, t GROUP BY 1")
def consensus_features(spark, d):
    s = tree_sets(spark, d).select("tree_id", F.explode("features").alias("feature_id"))
    n = F.broadcast(s.agg(F.countDistinct("tree_id").alias("n")))
    out = s.groupBy("feature_id").agg(F.count(F.lit(1)).alias("trees")).crossJoin(n)
    return r6("share", of=out.select("feature_id", "trees", (F.col("trees") / F.col("n")).alias("share"), (F.col("trees") >= F.ceil(F.col("n") * 0.5)).alias("consensus")))


@query(f"""WITH {RAW}, r AS (SELECT tree_id, feature_id, max(performance) AS score, avg(depth) / 7 AS confidence, max(depth) >= 5 AS selected FROM raw GROUP BY ALL),
p AS (SELECT feature_id, count(*) FILTER (WHERE selected) AS n, sum(score * confidence * CASE WHEN selected THEN 1.0 ELSE 0.5 END) / sum(confidence) AS a FROM r GROUP BY 1),
q AS (SELECT *, n / (SELECT count(DISTINCT tree_id) FROM r) AS f FROM p)
SELECT feature_id, n, round(a, 6) AS avg, round(f, 6) AS frequency, round(0.7 * a + 0.3 * f, 6) AS score, row_number() OVER (ORDER BY 0.7 * a + 0.3 * f DESC, feature_id) AS rank FROM q""")
def result_aggregation(spark, d):
    r = raw_votes(spark, d).groupBy("tree_id", "feature_id").agg(F.max("performance").alias("score"), (F.avg("depth") / 7).alias("confidence"), (F.max("depth") >= 5).alias("selected"))
    return r6("avg", "frequency", "score", of=voting.aggregate_results(r))


@query(f"WITH {RAW}, t AS (SELECT tree_id, max(performance) AS best, avg(performance) AS mean, max(depth) AS depth, count(*) AS visits FROM raw GROUP BY 1) SELECT tree_id, round(best, 4) AS best, round(mean, 6) AS mean, depth, visits, row_number() OVER (ORDER BY best DESC, mean DESC, tree_id) AS rank FROM t QUALIFY rank <= 10")
def top_trees(spark, d):
    t = raw_votes(spark, d).groupBy("tree_id").agg(F.max("performance").alias("best"), F.avg("performance").alias("mean"), F.max("depth").alias("depth"), F.count(F.lit(1)).alias("visits"))
    top = t.orderBy(F.desc("best"), F.desc("mean"), "tree_id").limit(10)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("best"), F.desc("mean"), "tree_id")).cast("long"))
    return ranked.withColumn("best", F.round("best", 4)).withColumn("mean", F.round("mean", 6))


@query(f"WITH {RAW} SELECT depth, count(*) AS visits, count(DISTINCT tree_id) AS trees, round(avg(performance) + 1e-9, 6) AS mean FROM raw GROUP BY 1")
def tree_statistics(spark, d):
    return r6("mean", of=raw_votes(spark, d).groupBy("depth").agg(F.count(F.lit(1)).alias("visits"), F.countDistinct("tree_id").alias("trees"), (F.avg("performance") + 1e-9).alias("mean")))


@query(f"WITH {RAW} SELECT feature_id, count(*) AS total, count(DISTINCT tree_id) AS trees, round(avg(performance) + 1e-9, 6) AS score, round(count(DISTINCT tree_id) / (SELECT count(DISTINCT tree_id) FROM raw), 6) AS share FROM raw GROUP BY 1")
def feature_heat_map(spark, d):
    v = raw_votes(spark, d)
    n = F.broadcast(v.agg(F.countDistinct("tree_id").alias("n")))
    out = v.groupBy("feature_id").agg(F.count(F.lit(1)).alias("total"), F.countDistinct("tree_id").alias("trees"), (F.avg("performance") + 1e-9).alias("score")).crossJoin(n)
    return r6("score", "share", of=out.withColumn("share", F.col("trees") / F.col("n")).drop("n"))


RUNS = "runs AS (SELECT DISTINCT year(o_orderdate) AS run, l_partkey % 200 AS feature_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def runs(spark, d):
    o, li = table(spark, d, "orders").select("o_orderkey", "o_orderdate"), table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.year("o_orderdate").alias("run"), (F.col("l_partkey") % 200).alias("feature_id")).distinct()


@query(f"WITH {RUNS} SELECT feature_id, round(count(DISTINCT run) / (SELECT count(DISTINCT run) FROM runs), 6) AS frequency, count(DISTINCT run) / (SELECT count(DISTINCT run) FROM runs) >= 0.7 AS stable FROM runs GROUP BY 1")
def run_stability(spark, d):
    return r6("frequency", of=voting.stability(runs(spark, d), "run", "feature_id"))


@query(f"WITH {RUNS}, s AS (SELECT run, list_sort(list(feature_id)) AS features FROM runs GROUP BY 1), p AS (SELECT run, features AS f, lag(features) OVER (ORDER BY run) AS g FROM s) SELECT run, round(CASE WHEN g IS NULL THEN NULL ELSE len(list_intersect(f, g)) / len(list_distinct(list_concat(f, g))) END, 6) AS jaccard FROM p")
def jaccard_with_previous(spark, d):
    s = runs(spark, d).groupBy("run").agg(F.array_sort(F.collect_set("feature_id")).alias("f"))
    p = s.withColumn("g", F.lag("f").over(Window.orderBy("run")))  # a row a run
    return r6("jaccard", of=p.select("run", F.when(F.col("g").isNotNull(), sets.jaccard(F.col("f"), F.col("g"))).alias("jaccard")))


_UID = "WITH a AS (SELECT l_suppkey AS k, list_sort(list(DISTINCT l_partkey % 50)) AS a FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_suppkey AS k, list_sort(list(DISTINCT l_partkey % 50)) AS b FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)"


@query(f"{_UID} SELECT k, len(list_distinct(list_concat(a, b))) AS n_union, len(list_intersect(a, b)) AS n_both, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS n_only, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM a JOIN b USING (k)")
def set_operations(spark, d):
    li = table(spark, d, "lineitem")
    of = lambda flag, name: li.where(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_set(F.col("l_partkey") % 50).alias(name))
    j = of("R", "a").join(of("A", "b"), "k")
    size = lambda how: F.size(sets.merged(F.col("a"), F.col("b"), how)).cast("long")
    return r6("jaccard", of=j.select("k", size("union").alias("n_union"), size("intersection").alias("n_both"), size("difference").alias("n_only"), sets.jaccard(F.col("a"), F.col("b")).alias("jaccard")))


MASKS = "masks AS (SELECT l_suppkey % 5 AS mask_id, l_partkey % 50 AS feature_id, bool_or(l_quantity > 49) AS selected, bool_and(l_quantity <= 49) AND bool_or(l_discount > 0.05) AS rejected, true AS available, bool_or(l_tax > 0.079) AS locked FROM lineitem GROUP BY ALL)"


def masks(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 5).alias("mask_id"), (F.col("l_partkey") % 50).alias("feature_id")).agg(F.bool_or(F.col("l_quantity") > 49).alias("selected"), (F.bool_and(F.col("l_quantity") <= 49) & F.bool_or(F.col("l_discount") > 0.05)).alias("rejected"), F.lit(True).alias("available"), F.bool_or(F.col("l_tax") > 0.079).alias("locked"))


@query(f"WITH {MASKS} SELECT 'intersection' AS how, feature_id, bool_and(selected) AS selected, bool_or(rejected) AS rejected, bool_and(available) AS available, bool_or(locked) AS locked FROM masks GROUP BY feature_id UNION ALL SELECT 'union', feature_id, bool_or(selected), bool_and(rejected), bool_or(available), bool_and(locked) FROM masks GROUP BY feature_id")
def mask_merges(spark, d):
    m = masks(spark, d)
    parts = [sets.mask_merge(m, how).select(F.lit(how).alias("how"), "feature_id", "selected", "rejected", "available", "locked") for how in ("intersection", "union")]
    return parts[0].union(parts[1])


@query(f"WITH {MASKS}, w AS (SELECT feature_id, sum(CASE WHEN selected THEN mask_id + 1.0 ELSE 0 END) / sum(mask_id + 1.0) > 0.5 AS s, bool_or(rejected) AS r FROM masks GROUP BY 1) SELECT feature_id, s AS selected, r AND NOT s AS rejected FROM w")
def mask_merge_weighted(spark, d):
    return sets.mask_merge(masks(spark, d).withColumn("w", F.col("mask_id") + 1.0), "weighted", "w")


@query(f"WITH {MASKS}, f AS (SELECT feature_id, arg_min(selected, mask_id) AS s FROM masks WHERE selected OR rejected GROUP BY 1) SELECT DISTINCT feature_id, coalesce(s, false) AS selected, coalesce(NOT s, false) AS rejected FROM masks LEFT JOIN f USING (feature_id)")
def mask_merge_priority(spark, d):
    return sets.mask_priority(masks(spark, d), "mask_id")


@query(f"""WITH {MASKS}, p AS (SELECT feature_id, bool_or(rejected) AS r, bool_and(feature_id % 3 <> 0 OR selected) AS v, bool_or(locked) AS l, 10.0 AS w FROM masks WHERE mask_id = 0 GROUP BY 1),
c AS (SELECT m.*, m.rejected OR coalesce(p.r, false) AS rej, coalesce(p.v, true) AND NOT (m.rejected OR coalesce(p.r, false)) AS av, m.locked OR coalesce(p.l, false) AS lo, coalesce((m.feature_id + p.w * 0.5) / 2, m.feature_id) AS pr FROM masks m LEFT JOIN p USING (feature_id) WHERE mask_id > 0)
SELECT mask_id, feature_id, selected AND av AS selected, rej AS rejected, av AS available, lo AS locked, round(pr, 6) AS priority FROM c""")
def inherited_masks(spark, d):
    """Masks 1 to 4 under the constraints of mask 0."""
    m = masks(spark, d).withColumn("priority", F.col("feature_id").cast("double"))
    parent = m.where("mask_id = 0").withColumns({"available": (F.col("feature_id") % 3 != 0) | F.col("selected"), "priority": F.lit(10.0)})
    return r6("priority", of=sets.inherited(m.where("mask_id > 0"), parent, 0.5))


@query(f"""WITH {MASKS} SELECT mask_id, list_filter([CASE WHEN bool_or(selected AND rejected) THEN 'selected and rejected' END, CASE WHEN bool_or(selected AND NOT available) THEN 'selected but not available' END, CASE WHEN bool_or(available AND rejected) THEN 'available and rejected' END,
CASE WHEN count(*) FILTER (WHERE available) < 10 THEN 'too few available' END, CASE WHEN count(*) FILTER (WHERE selected) > 30 THEN 'too many selected' END, CASE WHEN bool_or(locked AND rejected) THEN 'locked and rejected' END], lambda x: x IS NOT NULL) AS faults FROM masks GROUP BY 1""")
def mask_validation(spark, d):
    return sets.mask_faults(masks(spark, d), ["mask_id"], 10, 30)


@query("SELECT event_type, CASE WHEN event_id % 11 = 0 THEN 'locked' WHEN event_id % 2 = 0 THEN 'selected' ELSE 'available' END AS state, count(*) AS n, count(*) FILTER (WHERE CASE WHEN event_id % 11 = 0 THEN 'locked' WHEN event_id % 3 = 0 THEN 'selected' WHEN event_id % 3 = 1 THEN 'rejected' ELSE 'available' END = 'selected') AS selected_after FROM events GROUP BY 1, 2")
def mask_actions(spark, d):
    i = F.col("event_id")
    state = F.when(i % 11 == 0, "locked").when(i % 2 == 0, "selected").otherwise("available")
    action = F.when(i % 3 == 0, "select").when(i % 3 == 1, "reject").otherwise("deselect")
    rows = table(spark, d, "events").select("event_type", state.alias("state"), sets.mask_action(state, action).alias("after"))
    return rows.groupBy("event_type", "state").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("after") == "selected").alias("selected_after"))


@query("WITH s AS (SELECT o_custkey AS k, list(o_orderkey % 40 ORDER BY o_orderkey) AS f FROM orders GROUP BY 1) SELECT k, CASE WHEN len(list_filter(f, lambda x: x >= 38)) > 0 THEN 'INVALID' WHEN len(list_distinct(f)) < len(f) THEN 'WARNING' ELSE 'VALID' END AS status FROM s")
def subset_validation(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_list(F.col("o_orderkey") % 40).alias("f"))
    return s.select("k", sets.subset_status(F.col("f"), F.sequence(F.lit(0), F.lit(37)).cast("array<bigint>")).alias("status"))


@query("WITH s AS (SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderkey % 8)), ',') AS key FROM orders GROUP BY 1) SELECT key, count(*) AS n FROM s GROUP BY 1")
def unique_subsets(spark, d):
    from ..functions.scalars import set_key

    s = table(spark, d, "orders").groupBy("o_custkey").agg(set_key(F.collect_list(F.col("o_orderkey") % 8)).alias("key"))
    return s.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


_MODEL = "m AS (SELECT l_shipdate_m AS model, feature_id, avg(l_quantity) AS score FROM (SELECT month(l_shipdate) AS l_shipdate_m, l_partkey % 50 AS feature_id, l_quantity FROM lineitem) GROUP BY ALL)"


def model_scores(spark, d):
    return table(spark, d, "lineitem").groupBy(F.month("l_shipdate").alias("model"), (F.col("l_partkey") % 50).alias("feature_id")).agg(F.avg("l_quantity").alias("score"))


@query(f"WITH {_MODEL}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, feature_id) AS r, count(*) OVER (PARTITION BY model) AS n FROM m) SELECT feature_id, sum(n - r + 1)::DOUBLE AS borda, round(avg(r), 6) AS average_rank, sum((r <= 10)::INT)::DOUBLE AS majority FROM r GROUP BY 1")
def rank_aggregation(spark, d):
    m = model_scores(spark, d)
    out = None
    for how in ("borda", "average_rank", "majority"):
        part = voting.rankings_combined(m, how).withColumnRenamed("total", how)
        out = part if out is None else out.join(part, "feature_id")
    return r6("average_rank", of=out)


@query("""WITH m AS (SELECT l_returnflag AS method, l_partkey % 50 AS feature_id, avg(l_extendedprice) AS score FROM lineitem GROUP BY ALL),
n AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS s, CASE method WHEN 'R' THEN 0.5 WHEN 'A' THEN 0.3 ELSE 0.2 END AS w FROM m WINDOW w AS (PARTITION BY method))
SELECT feature_id, round(sum(s * w) / sum(w), 6) AS score FROM n GROUP BY 1""")
def score_aggregation(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("method"), (F.col("l_partkey") % 50).alias("feature_id")).agg(F.avg("l_extendedprice").alias("score"))
    return r6("score", of=voting.weighted_scores(m, {"R": 0.5, "A": 0.3, "N": 0.2}))


_PRED = "p AS (SELECT l_orderkey AS sample_id, (l_quantity > 25)::INT AS label, l_quantity / 50 AS proba, 1 + l_linenumber::DOUBLE AS weight FROM lineitem)"


@query(f"WITH {_PRED}, h AS (SELECT sample_id, label, count(*) AS c FROM p GROUP BY ALL), hv AS (SELECT sample_id, arg_max(label, c * 10 - label) AS hard FROM h GROUP BY 1) SELECT sample_id, hard, (avg(proba) >= 0.5)::INT AS soft, (sum(proba * weight) / sum(weight) >= 0.5)::INT AS weighted FROM p JOIN hv USING (sample_id) GROUP BY ALL")
def prediction_voting(spark, d):
    # a sample's items are added in the table's order, as SQL does it in one thread
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample_id"), (F.col("l_quantity") > 25).cast("long").alias("label"), (F.col("l_quantity") / 50).alias("proba"), (1 + F.col("l_linenumber").cast("double")).alias("weight"), *at)
    out = None
    for how in ("hard", "soft", "weighted"):
        v = voting.voted(p, how, order=["file", "row"]).withColumnRenamed("vote", how)
        out = v if out is None else out.join(v, "sample_id")
    return out


@query(f"WITH {_PRED}, h AS (SELECT sample_id, label, round(sum(weight), 9) AS c FROM p GROUP BY ALL), hv AS (SELECT sample_id, arg_max(label, c * 1000 - label) AS weighted_hard FROM h GROUP BY 1) SELECT sample_id, weighted_hard, round(sum(proba * weight) / sum(weight), 6) AS mean FROM p JOIN hv USING (sample_id) GROUP BY ALL")
def weighted_votes(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample_id"), (F.col("l_quantity") > 25).cast("long").alias("label"), (F.col("l_quantity") / 50).alias("prediction"), (1 + F.col("l_linenumber").cast("double")).alias("weight"))
    hard = voting.voted(p, "weighted_hard").withColumnRenamed("vote", "weighted_hard")
    return hard.join(voting.weighted_mean(p).select("sample_id", F.round("prediction", 6).alias("mean")), "sample_id")


@query(f"WITH {WEIGHTS}, k AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, round(performance, 9) DESC, feature_id) AS by_performance, row_number() OVER (ORDER BY round(score, 9) DESC, round(exploration, 9) DESC, feature_id) AS by_exploration, row_number() OVER (ORDER BY round(score, 9) DESC, first, feature_id) AS by_timestamp, row_number() OVER (ORDER BY round(score, 9) DESC, feature_id * 2654435761 % 1000003, feature_id) AS by_hash FROM (SELECT feature_id, round(score, 1) AS score, performance, exploration, first FROM cons JOIN (SELECT feature_id, min(seq) AS first FROM raw GROUP BY 1) USING (feature_id))) SELECT feature_id, by_performance, by_exploration, by_timestamp, by_hash FROM k")
def consensus_tie_rules(spark, d):
    """Ranks under each rule for ties; scores are rounded to one place, so that there are many."""
    seq = raw_votes(spark, d).groupBy("tree_id", "feature_id").agg(F.min("seq").alias("seq"))
    s = voting.consensus(votes(spark, d).join(seq, ["tree_id", "feature_id"]), weights(spark, d)).withColumn("score", F.round("score", 1))
    out = None
    for rule in ("performance", "exploration", "timestamp", "hash"):
        one = voting.build_consensus(s, F.lit(-1.0), 10**9, 0, rule).select("feature_id", F.col("rank").alias(f"by_{rule}"))
        out = one if out is None else out.join(one, "feature_id")
    return out


@query("WITH c AS (SELECT o_custkey AS id, avg(o_totalprice) AS score, count(*) AS size FROM orders GROUP BY 1) SELECT id, size, round(score / sqrt(greatest(size, 1)), 4) AS value, row_number() OVER (ORDER BY score / sqrt(greatest(size, 1)) DESC, size) AS rank FROM c QUALIFY rank <= 20")
def pareto_selection(spark, d):
    c = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.avg("o_totalprice").alias("score"), F.count(F.lit(1)).alias("size"))
    return voting.pareto(c, most=20).select("id", "size", F.round("value", 4).alias("value"), "rank")
