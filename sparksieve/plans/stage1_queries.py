"""Queries of the univariate statistics and the first selection stage.

Features are the 64 places of ``embeddings.embedding``; the target is label < 5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import information as info
from ..operators import selection as sel
from ..operators import stats
from ..operators.longform import from_array, from_wide
from ..operators.quantiles import exact_quantiles
from ..registry import query, r6, table


def features(spark: SparkSession, d: str) -> DataFrame:
    return from_array(table(spark, d, "embeddings"), "vec_id", "embedding", F.col("label") < 5)


#: Names of the embeddings' places.
PLACES = [f"e{i:02d}" for i in range(1, 65)]


def few(spark: SparkSession, d: str) -> DataFrame:
    """The line items' numeric columns as features of l_returnflag = 'R'."""
    li = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    return from_wide(li.withColumn("l_net", F.col("l_extendedprice") * (1 - F.col("l_discount"))), "l_returnflag", F.col("l_returnflag") == "R", ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_net"])


LF = """lf AS (
  SELECT vec_id AS sample_id, 'e' || lpad(i::VARCHAR, 2, '0') AS feature, embedding[i]::DOUBLE AS value, (label < 5)::INT::DOUBLE AS y
  FROM embeddings, range(1, 65) t(i))"""
FEW = """few AS (
  SELECT feature, value, y FROM (
    SELECT (l_returnflag = 'R')::INT::DOUBLE AS y, l_quantity, l_extendedprice, l_discount, l_tax, l_extendedprice * (1 - l_discount) AS l_net FROM lineitem)
  UNPIVOT (value FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax, l_net)))"""
CORR = """r AS (SELECT feature, abs(CASE WHEN var_pop(value) * count(*) > 1e-10 AND var_pop(y) * count(*) > 1e-10 THEN corr(value, y) ELSE 0 END) AS r FROM lf GROUP BY feature)"""
MI = """b AS (
  SELECT lf.feature, y, CASE WHEN high <= low THEN 1 ELSE least(floor((value - low) / ((high - low) / 10)) + 1, 10)::BIGINT END AS bin
  FROM lf JOIN (SELECT feature, min(value) AS low, max(value) AS high FROM lf GROUP BY feature) e USING (feature)),
j AS (SELECT feature, bin, y, count(*) AS c FROM b GROUP BY ALL),
p AS (SELECT feature, c, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, bin) AS nx, sum(c) OVER (PARTITION BY feature, y) AS ny FROM j),
mi AS (SELECT feature, greatest(0.0, sum(c / n * ln(c * n / (nx * ny)))) AS mi FROM p GROUP BY feature)"""
VAR = "v AS (SELECT feature, coalesce(var_samp(value), 0) AS variance FROM lf GROUP BY feature)"
PAIRS = """pairs AS (
  SELECT a.feature AS f1, b.feature AS f2, CASE WHEN var_pop(a.value) * count(*) > 1e-10 AND var_pop(b.value) * count(*) > 1e-10 THEN corr(a.value, b.value) ELSE 0 END AS r
  FROM lf a JOIN lf b ON a.sample_id = b.sample_id AND a.feature < b.feature GROUP BY ALL)"""
SCORES = f"{LF}, {CORR}, {MI}, {VAR}, s AS (SELECT feature, r, mi, variance FROM r JOIN mi USING (feature) JOIN v USING (feature))"
COMPOSITE = f"{SCORES}, c AS (SELECT *, CASE WHEN variance <= 1e-6 THEN '-inf'::DOUBLE ELSE mi + 0.1 * ln(variance + 1e-10) END AS score FROM s)"


@query(f"""WITH {LF}, {CORR}, {VAR}, k AS (
  SELECT feature, r AS score, variance, row_number() OVER (ORDER BY r DESC, feature) AS rank, count(*) FILTER (WHERE r > 0.05) OVER () AS passed
  FROM r JOIN v USING (feature) WHERE variance > 1e-6)
SELECT feature, round(score, 6) AS score, round(variance, 6) AS variance, rank FROM k WHERE CASE WHEN passed >= 10 THEN score > 0.05 ELSE rank <= 10 END""")
def stage1_filter(spark, d):
    return r6("score", "variance", of=sel.stage1_filter(features(spark, d)))


@query(f"WITH {LF} SELECT feature, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS var_samp, round(var_pop(value), 6) AS var_pop, round(min(value), 6) AS low, round(max(value), 6) AS high, round(sqrt(var_samp(value) + 1e-10), 6) AS std FROM lf GROUP BY feature")
def feature_moments(spark, d):
    m = stats.moments(features(spark, d)).withColumn("std", F.sqrt(F.col("var_samp") + 1e-10))
    return r6("mean", "var_samp", "var_pop", "low", "high", "std", of=m)


@query(f"WITH {FEW} SELECT feature, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std FROM few GROUP BY feature")
def lineitem_moments(spark, d):
    m = stats.moments(few(spark, d))
    return m.select("feature", "n", F.round("mean", 4).alias("mean"), F.round(F.sqrt("var_samp"), 4).alias("std"))


@query(f"WITH {LF} SELECT feature, CASE WHEN var_samp(value) > 0.015 THEN round(var_samp(value), 6) ELSE 0 END AS variance, var_samp(value) <= 0.015 AS low_variance FROM lf GROUP BY feature")
def low_variance_marks(spark, d):
    return r6("variance", of=stats.variance_scores(features(spark, d), 0.015))


@query(f"WITH {LF} SELECT feature, count(*) AS n, round(CASE WHEN var_pop(value) * count(*) > 1e-10 THEN corr(value, y) ELSE 0 END, 6) AS r FROM lf GROUP BY feature")
def feature_pearson(spark, d):
    return r6("r", of=stats.pearson(features(spark, d)))


@query(f"WITH {LF} SELECT feature, count(*) AS n, round(covar_pop(value, y) / sqrt(var_pop(value) * var_pop(y) + 1e-8), 6) AS r FROM lf GROUP BY feature")
def feature_pearson_smoothed(spark, d):
    return r6("r", of=stats.pearson(features(spark, d), 1e-8))


@query(f"WITH {LF}, {MI} SELECT feature, round(mi, 6) AS mi FROM mi")
def feature_mi_equal_width(spark, d):
    return r6("mi", of=info.mutual_information(info.with_equal_width(features(spark, d))))


@query(f"""WITH {LF}, e AS (SELECT feature, list_distinct(quantile_cont(value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS edges FROM lf GROUP BY feature),
j AS (SELECT feature, bin, y, count(*) AS c FROM (SELECT feature, y, len(list_filter(edges, lambda x: x < value)) + 1 AS bin FROM lf JOIN e USING (feature)) GROUP BY ALL),
p AS (SELECT feature, c, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, bin) AS nx, sum(c) OVER (PARTITION BY feature, y) AS ny FROM j)
SELECT feature, round(greatest(0.0, sum(c / n * ln(c * n / (nx * ny)))), 6) AS mi FROM p GROUP BY feature""")
def feature_mi_quantile(spark, d):
    return r6("mi", of=info.mutual_information(info.with_quantile_bins(features(spark, d))))


@query(f"""WITH {LF}, e AS (SELECT feature, avg(value) AS m, stddev_samp(value) AS s FROM lf GROUP BY feature),
j AS (SELECT feature, bin, y, count(*) AS c FROM (SELECT feature, y, greatest(1, least(10, floor((CASE WHEN s > 0 THEN (value - m) / s ELSE 0 END + 3) / 6 * 10) + 1)) AS bin FROM lf JOIN e USING (feature)) GROUP BY ALL),
p AS (SELECT feature, c, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, bin) AS nx, sum(c) OVER (PARTITION BY feature, y) AS ny FROM j)
SELECT feature, round(greatest(0.0, sum(c / n * ln(c * n / (nx * ny))) / ln(2)), 6) AS mi FROM p GROUP BY feature""")
def feature_mi_zscore(spark, d):
    return r6("mi", of=info.mutual_information(info.with_z_bins(features(spark, d)), 2.0))


_EDGE = f"""{LF}, e AS (SELECT feature, min(value) AS a, CASE WHEN max(value) > min(value) THEN max(value) - min(value) ELSE 1 END AS span FROM lf GROUP BY feature),
b AS (SELECT feature, greatest(1, least(256, ceil((value - (a - 0.001 * span)) / (span * 1.002 / 256))))::BIGINT AS bin, y FROM lf JOIN e USING (feature))"""


@query(f"WITH {_EDGE} SELECT feature, bin, count(*) AS n FROM b GROUP BY ALL")
def feature_histogram_256(spark, d):
    return info.with_edge_bins(features(spark, d)).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_EDGE}, j AS (SELECT feature, bin, count(*) AS c FROM b GROUP BY ALL), t AS (SELECT feature, c, sum(c) OVER (PARTITION BY feature) AS n, count(*) OVER (PARTITION BY feature) AS k FROM j)
SELECT feature, round(sum(-((c + 1e-10) / (n + 256e-10)) * log2((c + 1e-10) / (n + 256e-10))) - (256 - any_value(k)) * (1e-10 / (any_value(n) + 256e-10)) * log2(1e-10 / (any_value(n) + 256e-10)), 6) AS entropy FROM t GROUP BY feature""")
def feature_entropy_256(spark, d):
    counts = info.with_edge_bins(features(spark, d)).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("c"))
    return r6("entropy", of=info.smoothed_entropy(counts, 256))


@query(f"""WITH {_EDGE}, j AS (SELECT feature, bin, y, count(*) AS c FROM b GROUP BY ALL), x AS (SELECT feature, bin, sum(c) AS c FROM j GROUP BY ALL), yy AS (SELECT feature, y, sum(c) AS c FROM j GROUP BY ALL),
h AS (SELECT feature, sum(-p * log2(p)) AS h FROM (SELECT feature, c / sum(c) OVER (PARTITION BY feature) AS p FROM j) GROUP BY 1),
hx AS (SELECT feature, sum(-p * log2(p)) AS h FROM (SELECT feature, c / sum(c) OVER (PARTITION BY feature) AS p FROM x) GROUP BY 1),
hy AS (SELECT feature, sum(-p * log2(p)) AS h FROM (SELECT feature, c / sum(c) OVER (PARTITION BY feature) AS p FROM yy) GROUP BY 1)
SELECT feature, round(hx.h, 6) AS h_x, round(hy.h, 6) AS h_y, round(h.h, 6) AS h_xy, round(hx.h + hy.h - h.h, 6) AS mi FROM h JOIN hx USING (feature) JOIN hy USING (feature)""")
def feature_mi_entropy_form(spark, d):
    j = info.joint_counts(info.with_edge_bins(features(spark, d)))
    hx = info.entropy(j.groupBy("feature", "bin").agg(F.sum("c").alias("c")), base=2).withColumnRenamed("entropy", "h_x")
    hy = info.entropy(j.groupBy("feature", "cls").agg(F.sum("c").alias("c")), base=2).withColumnRenamed("entropy", "h_y")
    h = info.entropy(j, base=2).withColumnRenamed("entropy", "h_xy")
    return r6("h_x", "h_y", "h_xy", "mi", of=hx.join(hy, "feature").join(h, "feature").withColumn("mi", F.col("h_x") + F.col("h_y") - F.col("h_xy")))


@query("""WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS c FROM lineitem GROUP BY ALL),
p AS (SELECT c / sum(c) OVER () AS p, sum(c) OVER (PARTITION BY a) / sum(c) OVER () AS pa, sum(c) OVER (PARTITION BY b) / sum(c) OVER () AS pb FROM c),
s AS (SELECT greatest(sum(p * ln(p / (pa * pb))), 0.0) AS mi, sum(-p * ln(pa)) AS ha, sum(-p * ln(pb)) AS hb FROM p)
SELECT round(mi, 6) AS mi, round(ha, 6) AS ha, round(hb, 6) AS hb, round(2 * mi / (ha + hb + 1e-10), 6) AS nmi FROM s""")
def discrete_mutual_information(spark, d):
    return r6("mi", "ha", "hb", "nmi", of=info.discrete_mi(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"))


@query(f"WITH {LF}, {PAIRS} SELECT f1, f2, round(r, 6) AS r FROM pairs")
def correlation_pairs(spark, d):
    return r6("r", of=stats.vector_pairs(table(spark, d, "embeddings"), "embedding", PLACES))


@query(f"WITH {LF}, {PAIRS} SELECT f1, f2, round(r, 6) AS r FROM pairs")
def correlation_matrix_gramian(spark, d):
    names = [f"e{i:02d}" for i in range(1, 65)]
    emb = table(spark, d, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return r6("r", of=stats.correlation_matrix(emb, "v", names))


@query(f"WITH {LF}, {PAIRS} SELECT f1, f2, round(r, 6) AS r FROM pairs WHERE abs(r) >= 0.1")
def correlated_pairs(spark, d):
    return r6("r", of=stats.vector_pairs(table(spark, d, "embeddings"), "embedding", PLACES, 0.1))


@query(f"""WITH {LF}, rx AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rx, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2 AS ry FROM lf)
SELECT feature, round(corr(rx, ry), 6) AS rho FROM rx GROUP BY feature""")
def feature_spearman(spark, d):
    return r6("rho", of=stats.spearman(features(spark, d)))


@query(f"""WITH {LF}, c AS (SELECT a.feature, sum(sign(a.value - b.value)) AS s FROM lf a JOIN lf b ON a.feature = b.feature AND a.y > b.y GROUP BY 1), n AS (SELECT feature, count(*) AS n FROM lf GROUP BY 1)
SELECT feature, round(s / (n * (n - 1) / 2), 6) AS tau FROM c JOIN n USING (feature)""")
def feature_kendall(spark, d):
    return r6("tau", of=stats.kendall(features(spark, d)))


@query(f"WITH {LF}, c AS (SELECT feature, corr(value, y) AS r, count(*) AS n FROM lf GROUP BY 1) SELECT feature, round(tanh(atanh(r) + 1.96 / sqrt(n - 3)) - tanh(atanh(r) - 1.96 / sqrt(n - 3)), 6) AS width FROM c")
def correlation_interval(spark, d):
    return stats.pearson(features(spark, d)).select("feature", F.round(stats.fisher_width(F.col("r"), F.col("n")), 6).alias("width"))


@query(f"WITH {COMPOSITE} SELECT feature, round(mi, 6) AS mi, round(variance, 6) AS variance, round(score, 6) AS score FROM c")
def composite_score(spark, d):
    return r6("mi", "variance", "score", of=sel.composite(sel.feature_scores(features(spark, d)))).drop("r")


_LOSERS = f"{COMPOSITE}, {PAIRS}, l AS (SELECT CASE WHEN a.score <= b.score THEN f1 ELSE f2 END AS feature, count(*) AS hits FROM pairs JOIN c a ON a.feature = f1 JOIN c b ON b.feature = f2 WHERE abs(pairs.r) >= 0.1 GROUP BY 1)"


@query(f"WITH {_LOSERS} SELECT feature, coalesce(hits, 0) AS hits, round(score * pow(0.5, coalesce(hits, 0)), 6) AS score FROM c LEFT JOIN l USING (feature)")
def correlation_penalty(spark, d):
    lf = features(spark, d)
    scored = sel.composite(sel.feature_scores(lf)).select("feature", "score")
    return r6("score", of=sel.penalised(scored, stats.correlation_pairs(lf, 0.1)))


@query(f"WITH {_LOSERS} SELECT feature, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, feature) AS rank FROM c ANTI JOIN l USING (feature) QUALIFY rank <= 20")
def integrated_ranker(spark, d):
    lf = features(spark, d)
    scored = sel.composite(sel.feature_scores(lf)).select("feature", "score")
    left = sel.penalised(scored, stats.correlation_pairs(lf, 0.1), penalty=1.0).drop("hits")
    return r6("score", of=sel.ranked(left).where("rank <= 20"))


@query(f"""WITH {SCORES}, {PAIRS}, l AS (SELECT DISTINCT CASE WHEN a.mi < b.mi THEN f1 ELSE f2 END AS feature FROM pairs JOIN s a ON a.feature = f1 JOIN s b ON b.feature = f2 WHERE abs(pairs.r) >= 0.1)
SELECT feature, round(mi, 6) AS mi FROM s ANTI JOIN l USING (feature)""")
def redundancy_removal(spark, d):
    lf = features(spark, d)
    return r6("mi", of=sel.without_redundant(sel.feature_scores(lf), stats.correlation_pairs(lf, 0.1))).select("feature", "mi")


@query(f"""WITH {SCORES}, {PAIRS}, t AS (SELECT *, row_number() OVER (ORDER BY mi DESC, feature) AS rn FROM s WHERE variance > 1e-6 QUALIFY rn <= 32),
l AS (SELECT DISTINCT CASE WHEN a.mi < b.mi THEN f1 ELSE f2 END AS feature FROM pairs JOIN t a ON a.feature = f1 JOIN t b ON b.feature = f2 WHERE abs(pairs.r) >= 0.1)
SELECT feature, round(mi, 6) AS mi, row_number() OVER (ORDER BY mi DESC, feature) AS rank FROM t ANTI JOIN l USING (feature) QUALIFY rank <= 10""")
def fused_pipeline(spark, d):
    lf = features(spark, d)
    top = sel.ranked(sel.feature_scores(lf).where("variance > 1e-6"), "mi").where("rank <= 32").drop("rank")
    kept = sel.without_redundant(top, stats.correlation_pairs(lf, 0.1))
    return r6("mi", of=sel.ranked(kept.select("feature", "mi"), "mi").where("rank <= 10"))


@query()
def greedy_uncorrelated_filter(spark, d):
    lf = features(spark, d)
    scored = sel.universal_score(sel.feature_scores(lf))
    return r6("score", of=sel.greedy_uncorrelated(scored, stats.correlation_pairs(lf, 0.1), 0.1)).select("feature", "score")


@query(f"WITH {SCORES}, u AS (SELECT feature, 0.4 * r + 0.4 * mi + 0.2 * variance / max(variance) OVER () AS score FROM s) SELECT feature, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, feature) AS rank FROM u")
def universal_score(spark, d):
    return r6("score", of=sel.ranked(sel.universal_score(sel.feature_scores(features(spark, d))))).select("feature", "score", "rank")


@query(f"""WITH {SCORES}, t AS (SELECT *, count(*) FILTER (WHERE r > 0.05) OVER () AS passed, row_number() OVER (ORDER BY r DESC, feature) AS k FROM s WHERE variance > 1e-16),
u AS (SELECT * FROM t WHERE CASE WHEN passed >= 10 THEN r > 0.05 ELSE k <= 10 END)
SELECT feature, round(mi, 6) AS mi, row_number() OVER (ORDER BY mi DESC, feature) AS rank FROM u""")
def stage1_constant_corr_mi(spark, d):
    s = sel.feature_scores(features(spark, d)).where("variance > 1e-16")
    kept = sel.threshold_or_best(s, 0.05, 10, "r").drop("rank")
    return r6("mi", of=sel.ranked(kept, "mi")).select("feature", "mi", "rank")


@query(f"WITH {SCORES} SELECT count(*) FILTER (WHERE mi >= 0.01 AND variance >= 0.014) AS passing, count(*) AS total, round(min(mi), 6) AS min_mi, round(max(mi), 6) AS max_mi, round(avg(mi), 6) AS mean_mi, round(min(variance), 6) AS min_var, round(max(variance), 6) AS max_var, round(avg(variance), 6) AS mean_var FROM s")
def selection_summary(spark, d):
    s = sel.feature_scores(features(spark, d))
    out = s.agg(F.count_if((F.col("mi") >= 0.01) & (F.col("variance") >= 0.014)).alias("passing"), F.count(F.lit(1)).alias("total"), *[f(c).alias(f"{n}_{c if c == 'mi' else 'var'}") for c in ("mi", "variance") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])
    return r6("min_mi", "max_mi", "mean_mi", "min_var", "max_var", "mean_var", of=out)


@query(f"WITH {LF}, {CORR} SELECT q, round(quantile_cont, 6) AS value FROM (SELECT unnest([0.01,0.05,0.1,0.25,0.5,0.75,0.9,0.95,0.99]) AS q, unnest(quantile_cont(r, [0.01,0.05,0.1,0.25,0.5,0.75,0.9,0.95,0.99])) AS quantile_cont FROM r)")
def score_percentiles(spark, d):
    return r6("value", of=stats.percentiles(stats.pearson(features(spark, d)).select(F.abs("r").alias("score")), "score"))


@query(f"WITH {LF}, {CORR} SELECT CASE WHEN r <= 0.05 THEN 1 WHEN r <= 0.1 THEN 2 WHEN r <= 0.15 THEN 3 WHEN r <= 0.2 THEN 4 WHEN r <= 0.3 THEN 5 WHEN r <= 0.5 THEN 6 ELSE 7 END AS bucket, count(*) AS n FROM r WHERE r > 0 GROUP BY 1")
def correlation_buckets(spark, d):
    return stats.correlation_buckets(stats.pearson(features(spark, d)).select(F.abs("r").alias("score")))


@query(f"WITH {LF}, {CORR} SELECT round(min(r), 6) AS low, round(avg(r), 6) AS mean, round(median(r), 6) AS median, round(max(r), 6) AS high FROM r WHERE r > 0")
def correlation_summary(spark, d):
    s = stats.pearson(features(spark, d)).select(F.abs("r").alias("r")).where("r > 0")
    return r6("low", "mean", "median", "high", of=s.agg(F.min("r").alias("low"), F.avg("r").alias("mean"), F.median("r").alias("median"), F.max("r").alias("high")))


@query(f"""WITH {SCORES}, {PAIRS}, m AS (SELECT f, avg(abs(r)) AS red FROM (SELECT f1 AS f, r FROM pairs UNION ALL SELECT f2, r FROM pairs) GROUP BY 1),
q AS (SELECT feature, stddev_samp(value) / nullif(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 0) AS spread FROM lf GROUP BY 1)
SELECT feature, round(mi, 6) AS relevance, round(1 - red, 6) AS redundancy, round(variance / sum(variance) OVER (), 6) AS coverage, round(spread, 6) AS diversity FROM s JOIN m ON m.f = s.feature JOIN q USING (feature)""")
def feature_quality(spark, d):
    from pyspark.sql import Window

    lf = features(spark, d)
    pairs = stats.correlation_pairs(lf)
    red = pairs.select(F.explode(F.array("f1", "f2")).alias("feature"), F.abs("r").alias("r")).groupBy("feature").agg((1 - F.avg("r")).alias("redundancy"))
    quartiles = exact_quantiles(lf, ["feature"], "value", [0.25, 0.75], "q", small=True)
    spread = lf.groupBy("feature").agg(F.stddev_samp("value").alias("s")).join(quartiles, "feature").select("feature", (F.col("s") / F.nullif(F.col("q")[1] - F.col("q")[0], F.lit(0.0))).alias("diversity"))
    s = sel.feature_scores(lf).select("feature", F.col("mi").alias("relevance"), (F.col("variance") / F.sum("variance").over(Window.partitionBy(F.lit(1)))).alias("coverage"))
    return r6("relevance", "redundancy", "coverage", "diversity", of=s.join(red, "feature").join(spread, "feature"))


@query()
def adaptive_selection(spark, d):
    s = sel.feature_scores(features(spark, d))
    return r6("mi", of=s.where(F.col("mi") >= sel.adaptive_threshold(s, 16))).select("feature", "mi")


@query("SELECT 'rank_gaps' AS \"check\", 0 AS failures UNION ALL SELECT 'duplicates', 0 UNION ALL SELECT 'null_scores', 0 UNION ALL SELECT 'unknown', 0")
def selection_validation(spark, d):
    lf = features(spark, d)
    return sel.validated(sel.stage1_filter(lf), lf)
