"""Queries of folds, metrics, curves and statistical tests.

Labelled rows are documents with labels; the heuristic score is a function of
the document's length.  Models are order priorities, folds order keys modulo 5.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators.ordered import positioned
from ..operators.quantiles import exact_quantiles
from ..registry import query, r6, table

LAB = "lab AS (SELECT doc_id, quality, toxic, n_chars, least(n_chars / 5000.0, 1.0) AS score FROM documents JOIN labels USING (doc_id))"


def labelled(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels")
    return docs.join(labels, "doc_id").withColumn("score", F.least(F.col("n_chars") / 5000.0, F.lit(1.0)))


@query("WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey, least((i - 1) // greatest(1, n // 5), 4) AS fold FROM n")
def contiguous_folds(spark, d):
    return ev.contiguous_folds(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5)


@query("WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey, i <= n * 7 // 10 AS train FROM n")
def holdout_split(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    n = o.count()
    return positioned(o, [], ["o_orderkey"]).select("o_orderkey", (F.col("position") <= n * 7 // 10).alias("train"))


@query("SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey * 2654435761 % 1000003, o_orderkey) - 1) % 5 AS fold FROM orders")
def stratified_folds(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return ev.stratified_folds(o, F.col("o_orderpriority"), [F.col("o_orderkey") * 2654435761 % 1000003, F.col("o_orderkey")], 5).select("o_orderkey", "fold")


@query("WITH q AS (SELECT quantile_cont(o_totalprice, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS e FROM orders), l AS (SELECT o_orderkey, len(list_filter(e, lambda x: x < o_totalprice)) AS cls FROM orders, q), f AS (SELECT *, (row_number() OVER (PARTITION BY cls ORDER BY o_orderkey) - 1) % 5 AS fold FROM l), c AS (SELECT fold, cls, count(*) AS c FROM f GROUP BY ALL) SELECT fold, count(*) AS classes, min(c) AS smallest, min(c) >= 1 AS valid FROM c GROUP BY 1")
def quantile_stratified_folds(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    edges = F.broadcast(exact_quantiles(o, [], "o_totalprice", [i / 10 for i in range(1, 10)], "e"))  # one row
    cls = F.size(F.filter("e", lambda x: x < F.col("o_totalprice")))
    return ev.fold_check(ev.stratified_folds(o.crossJoin(edges).withColumn("cls", cls).drop("e"), F.col("cls"), [F.col("o_orderkey")], 5), "cls")


@query("SELECT l_returnflag, round(avg(abs(e)), 4) AS mae, round(avg(e * e), 2) AS mse, round(sqrt(avg(e * e)), 4) AS rmse, round(1 - avg(e * e) / var_pop(l_extendedprice), 6) AS r2, round(avg(CASE WHEN l_extendedprice <> 0 THEN abs(e / l_extendedprice) END), 6) AS mape FROM (SELECT *, l_extendedprice - l_quantity * 1500 AS e FROM lineitem) GROUP BY 1")
def regression_metrics(spark, d):
    li = table(spark, d, "lineitem")
    m = li.groupBy("l_returnflag").agg(*ev.regression_metrics(F.col("l_extendedprice"), F.col("l_quantity") * 1500))
    return m.select("l_returnflag", F.round("mae", 4).alias("mae"), F.round("mse", 2).alias("mse"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"), F.round("mape", 6).alias("mape"))


@query(f"""WITH {LAB}, c AS (SELECT count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE NOT t AND NOT p) AS tn, count(*) FILTER (WHERE t AND NOT p) AS fn FROM (SELECT quality = 1 AS t, score > 0.2 AS p FROM lab)),
m AS (SELECT *, (tp + tn) / (tp + fp + tn + fn) AS accuracy, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, tn / nullif(tn + fp, 0) AS specificity FROM c)
SELECT tp, fp, tn, fn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(specificity, 6) AS specificity, round(2 * precision * recall / (precision + recall), 6) AS f1, round((2 * precision * recall / (precision + recall) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) AS macro_f1 FROM m""")
def confusion_metrics(spark, d):
    return r6("accuracy", "precision", "recall", "specificity", "f1", "macro_f1", of=ev.confusion(labelled(spark, d), F.col("quality") == 1, F.col("score") > 0.2))


ROC = f"""{LAB}, c AS (SELECT round(score, 3) AS t, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality <> 1) AS n FROM lab GROUP BY 1),
roc AS (SELECT t AS threshold, sum(n) OVER w / sum(n) OVER () AS fpr, sum(p) OVER w / sum(p) OVER () AS tpr FROM c WINDOW w AS (ORDER BY t DESC) UNION ALL SELECT NULL, 0.0, 0.0)"""


def curve(spark, d):
    return ev.roc_curve(labelled(spark, d), F.col("quality") == 1, F.round("score", 3))


@query(f"WITH {ROC} SELECT threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc")
def roc_curve(spark, d):
    return r6("fpr", "tpr", of=curve(spark, d))


@query(f"WITH {ROC} SELECT round(sum(a), 6) AS auc FROM (SELECT (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS a FROM roc WINDOW w AS (ORDER BY fpr, tpr))")
def roc_auc(spark, d):
    return r6("auc", of=ev.auc(curve(spark, d)))


CELLS = "cells AS (SELECT o_orderpriority AS model, o_orderkey % 5 AS fold, avg(o_totalprice) / 1000 AS value FROM orders GROUP BY ALL)"


def cells(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("model"), (F.col("o_orderkey") % 5).alias("fold")).agg((F.avg("o_totalprice") / 1000).alias("value"))


@query(f"WITH {CELLS} SELECT model, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS low, round(max(value), 6) AS high, round(1 / (1 + stddev_samp(value) / abs(avg(value))), 6) AS stability, round(1.96 * stddev_samp(value) / sqrt(count(*)), 6) AS half_width FROM cells GROUP BY 1")
def fold_summary(spark, d):
    return r6("mean", "std", "low", "high", "stability", "half_width", of=ev.fold_summary(cells(spark, d), ["model"], "value"))


@query(f"WITH {CELLS}, m AS (SELECT model, median(value) AS med FROM cells GROUP BY 1) SELECT model, round(any_value(med), 6) AS median, round(1.4826 * median(abs(value - med)), 6) AS spread FROM cells JOIN m USING (model) GROUP BY 1")
def robust_fold_summary(spark, d):
    return r6("median", "spread", of=ev.robust_summary(cells(spark, d), ["model"], "value"))


def pairs_of(spark, d):
    c = cells(spark, d)
    a = c.select(F.col("model").alias("a"), "fold", F.col("value").alias("x"))
    return a.join(c.select(F.col("model").alias("b"), "fold", F.col("value").alias("y")), "fold").where("a < b")


_T = f"{CELLS}, t AS (SELECT a.model AS a, b.model AS b, count(*) AS n, avg(a.value - b.value) AS m, stddev_samp(a.value - b.value) AS sd, sqrt((var_samp(a.value) + var_samp(b.value)) / 2) AS pooled FROM cells a JOIN cells b ON a.fold = b.fold AND a.model < b.model GROUP BY ALL)"


@query(f"WITH {_T} SELECT a, b, n, round(m, 6) AS mean_diff, round(m / (sd / sqrt(n)), 6) AS t, n - 1 AS df, round(m / pooled, 6) AS cohen_d FROM t")
def paired_t_tests(spark, d):
    return r6("mean_diff", "t", "cohen_d", of=ev.paired_t(pairs_of(spark, d), ["a", "b"], "x", "y")).drop("p", "ci_low", "ci_high")


# Student's distribution with four degrees of freedom (there are five folds) has a closed form; 2.776... is its 0.975 quantile
_P = f"{_T}, v AS (SELECT *, m / (sd / sqrt(n)) AS t FROM t), p AS (SELECT *, 1 - 2 * (3.0 / 8 * abs(t) / sqrt(1 + t * t / 4) * (1 - t * t / (1 + t * t / 4) / 12)) AS p FROM v)"


@query(f"WITH {_P} SELECT a, b, round(p, 6) AS p, round(m - 2.7764451051977987::DOUBLE * sd / sqrt(n), 6) AS ci_low, round(m + 2.7764451051977987::DOUBLE * sd / sqrt(n), 6) AS ci_high FROM p")
def paired_t_tails(spark, d):
    return r6("p", "ci_low", "ci_high", of=ev.paired_t(pairs_of(spark, d), ["a", "b"], "x", "y").select("a", "b", "p", "ci_low", "ci_high"))


@query(f"""WITH {_P}, r AS (SELECT a, b, p, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM p)
SELECT a, b, round(p, 6) AS p, round(least(1, p * m), 6) AS bonferroni, round(least(1, max(p * (m - r + 1)) OVER (ORDER BY r)), 6) AS holm, round(least(1, min(p * m / r) OVER (ORDER BY r DESC)), 6) AS benjamini_hochberg FROM r""")
def model_comparison_adjusted(spark, d):
    t = ev.compared_models(pairs_of(spark, d), ["a", "b"], "x", "y").select("a", "b", "p", "bonferroni", "holm", "benjamini_hochberg")
    return r6("p", "bonferroni", "holm", "benjamini_hochberg", of=t)


@query(f"WITH {CELLS} SELECT model, round(avg(value), 6) AS mean, round(avg(value) - 2.7764451051977987::DOUBLE * stddev_samp(value) / sqrt(count(*)), 6) AS ci_low, round(avg(value) + 2.7764451051977987::DOUBLE * stddev_samp(value) / sqrt(count(*)), 6) AS ci_high FROM cells GROUP BY 1")
def confidence_intervals(spark, d):
    return r6("mean", "ci_low", "ci_high", of=ev.confidence_interval(cells(spark, d), ["model"], "fold", "value").select("model", "mean", "ci_low", "ci_high"))


@query("""WITH p AS (SELECT o_custkey AS k, least(1.0, (1 + count(*)) / 97.0 * (o_custkey % 89 + 1) / 89) AS p FROM orders GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY p, k) AS r, count(*) OVER () AS m FROM p)
SELECT k, round(least(1.0, p * m), 6) AS bonferroni, round(least(1.0, max(p * (m - r + 1)) OVER (ORDER BY r)), 6) AS holm, round(least(1.0, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS benjamini_hochberg FROM r""")
def multiple_test_corrections(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    p = o.select("k", F.least(F.lit(1.0), (1 + F.col("c")) / 97.0 * (F.col("k") % 89 + 1) / 89).alias("p"))
    return r6("bonferroni", "holm", "benjamini_hochberg", of=ev.adjusted(p)).drop("p")


@query("""WITH d AS (SELECT l_returnflag AS g, round(abs(l_quantity - 25.5 - l_linenumber), 9) AS m, (l_quantity - 25.5 - l_linenumber) > 0 AS pos FROM lineitem WHERE l_quantity - 25.5 - l_linenumber <> 0),
c AS (SELECT g, m, count(*) AS c, count(*) FILTER (WHERE pos) AS plus FROM d GROUP BY ALL), r AS (SELECT *, sum(c) OVER (PARTITION BY g ORDER BY m ROWS UNBOUNDED PRECEDING) - c + (c + 1) / 2 AS rank FROM c),
s AS (SELECT g, sum(c)::BIGINT AS n, sum(plus * rank) AS w, sum(pow(c, 3) - c) AS ties FROM r GROUP BY 1)
SELECT g, n, w AS w_plus, round((w - n::DOUBLE * (n + 1) / 4) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z, round((2 * w - n::DOUBLE * (n + 1) / 2) / (n::DOUBLE * (n + 1) / 2), 6) AS rank_biserial FROM s""")
def wilcoxon_signed_rank(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_quantity") - 25.5).alias("x"), F.col("l_linenumber").cast("double").alias("y"))
    return r6("z", "rank_biserial", of=ev.wilcoxon(li, ["g"], "x", "y")).drop("p")


@query(f"WITH {LAB}, c AS (SELECT count(*) FILTER (WHERE a AND NOT b) AS b, count(*) FILTER (WHERE NOT a AND b) AS c FROM (SELECT (score > 0.2) = (quality = 1) AS a, (n_chars % 2 = 0) = (quality = 1) AS b FROM lab)) SELECT b, c, round(CASE WHEN b + c > 0 THEN pow(greatest(abs(b - c) - CASE WHEN b + c < 25 THEN 1 ELSE 0 END, 0), 2) / (b + c) ELSE 0 END, 6) AS chi2, round(b / nullif(c, 0), 6) AS odds_ratio FROM c")
def mcnemar_test(spark, d):
    good = F.col("quality") == 1
    return r6("chi2", "odds_ratio", of=ev.mcnemar(labelled(spark, d), [], (F.col("score") > 0.2) == good, (F.col("n_chars") % 2 == 0) == good)).drop("p")


@query("""WITH s AS (SELECT o_orderstatus, count(*) FILTER (WHERE f) AS n1, count(*) FILTER (WHERE NOT f) AS n2, avg(v) FILTER (WHERE f) AS m1, avg(v) FILTER (WHERE NOT f) AS m2, var_samp(v) FILTER (WHERE f) AS v1, var_samp(v) FILTER (WHERE NOT f) AS v2 FROM (SELECT o_orderstatus, o_totalprice AS v, o_orderpriority < '3' AS f FROM orders) GROUP BY 1),
d AS (SELECT *, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS d FROM s)
SELECT o_orderstatus, round(d, 6) AS cohen_d, round((m1 - m2) / sqrt(v2), 6) AS glass_delta, round(d * (1 - 3 / (4 * (n1 + n2) - 9)), 6) AS hedges_g FROM d""")
def effect_sizes(spark, d):
    return r6("cohen_d", "glass_delta", "hedges_g", of=ev.effect_sizes(table(spark, d, "orders"), ["o_orderstatus"], "o_totalprice", F.col("o_orderpriority") < "3"))


@query()
def bootstrap_intervals(spark, d):
    return r6("ci_low", "ci_high", of=ev.bootstrap(labelled(spark, d), ["quality"], "doc_id", "score", 10_000))


@query()
def permutation_tests(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice", (F.col("o_custkey") * 300.0).alias("other"))
    return r6("p", "mean_diff", of=ev.permutation_test(o, ["o_orderpriority"], "o_orderkey", "o_totalprice", "other", 10_000))
