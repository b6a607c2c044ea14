"""Rolling ranks, tracked predictions, streamed information, exact quantiles and custom statistics against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparksieve.operators import evaluation as ev
from sparksieve.operators import information as info
from sparksieve.operators import windows
from sparksieve.operators.longform import from_wide
from sparksieve.operators.quantiles import exact_quantiles
from sparksieve.shared import scratch
from sparksieve.streaming import streams, tracking


def pairs(n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, n).astype(float)
    return x, np.round(0.5 * x + rng.normal(size=n) * 2)


def brute(x, y):
    rank = lambda v: np.array([(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v])
    a, b = rank(x), rank(y)
    rho = np.corrcoef(a, b)[0, 1] if a.std() and b.std() else 0.0
    tau = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(len(x)) for j in range(i)) / (len(x) * (len(x) - 1) / 2)
    return rho, tau


@pytest.mark.parametrize("n, every, chunk", [(20, 5, 25), (7, 1, 7), (1000, 50, 64)])
def test_rolling_ranks_over_chunks(spark, n, every, chunk):
    x, y = pairs()
    rows = [(k, i, float(a), float(b)) for k, s in (("a", 300), (None, 40)) for i, (a, b) in enumerate(zip(x[:s], y[:s]))] + [("a", 1000, None, 1.0), ("c", 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, i long, x double, y double").repartition(5)
    got = windows.rolling_ranks(df, ["k"], ["i"], "x", "y", n, every, 3, chunk).collect()
    assert len(got) == len({(r.k, r.i) for r in got}) == sum(p % every == 0 and min(p, n) >= 3 for s in (300, 40) for p in range(1, s + 1))
    for r in got:
        lo = max(0, r.i + 1 - n)
        rho, tau = brute(x[lo : r.i + 1], y[lo : r.i + 1])
        assert r.position == r.i + 1 and r.n == r.i + 1 - lo and abs(r.spearman - rho) < 1e-9 and abs(r.kendall - tau) < 1e-9


def test_tracking_over_batches_and_a_restart(spark):
    x, y = pairs(200, 1)
    root, schema = scratch(spark, "predictions"), "k string, i long, x double, y double"
    out, state = scratch(spark, "tracked"), scratch(spark, "tracked-state")

    def add(lo, hi):
        rows = [(k, i, float(x[i]), float(y[i])) for k in ("a", "b") for i in range(lo, hi) if k == "a" or i % 3 == 0] + [("a", hi - 1, None, None)]
        spark.createDataFrame(rows, schema).repartition(1).write.mode("append").parquet(root)

    def go():
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root)
        with tracking.with_store(spark):
            tracking.tracked(src, "k", "i", "x", "y", size=30, every=5, least=10).writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).start().awaitTermination()

    add(0, 50)
    add(50, 90)
    go()
    add(90, 200)
    go()
    got = spark.read.parquet(out).collect()
    assert len({r.batch for r in got}) == 3
    for k, own in (("a", list(range(200))), ("b", [i for i in range(200) if i % 3 == 0])):
        mine = {r.total: r for r in got if r.k == k}
        assert sorted(mine) == [t for t in range(10, len(own) + 1) if t % 5 == 0]
        for t, r in mine.items():
            last = own[max(0, t - 30) : t]
            rho, tau = brute(x[last], y[last])
            e = x[last] - y[last]
            assert r.i == own[t - 1] and r.n == len(last)
            assert abs(r.spearman - rho) < 1e-9 and abs(r.kendall - tau) < 1e-9 and abs(r.pearson - np.corrcoef(x[last], y[last])[0, 1]) < 1e-9
            assert abs(r.mae - np.abs(e).mean()) < 1e-9 and abs(r.rmse - np.sqrt((e * e).mean())) < 1e-9


@pytest.mark.parametrize("files, a_batch", [(1, 1), (4, 1), (4, 3)])
def test_information_of_a_stream_is_that_of_the_table(spark, files, a_batch):
    x, y = pairs(400, 2)
    wide = spark.createDataFrame([(i, float(a), float(b), int(a) % 2) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, z double, t int")
    root = scratch(spark, "long")
    lf = from_wide(wide, "id", F.col("t"), ["x", "z"])
    for k in range(files):
        lf.where(F.pmod("sample_id", F.lit(files)) == k).repartition(1).write.mode("append").parquet(root)
    src = spark.readStream.schema(lf.schema).option("maxFilesPerTrigger", a_batch).parquet(root)
    counts = streams.drained(streams.joint_counts(src, info.value_ranges(lf)), "mi", "complete")
    got = {r.feature: r.mi for r in info.counted_information(counts).collect()}
    want = {r.feature: r.mi for r in info.mutual_information(info.with_equal_width(lf)).collect()}
    assert got.keys() == want.keys() == {"x", "z"} and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    at = [0.0, 0.25, 0.5, 0.9, 0.999, 1.0]
    groups = {"normal": rng.normal(size=20_000), "ties": rng.integers(0, 3, 5000).astype(float), "skew": np.exp(8 * rng.normal(size=9000)), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), None: rng.normal(size=100)}
    rows = [(k, float(v)) for k, g in groups.items() for v in g] + [("none", None), ("two", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    for small in (False, True):
        got = {r.g: r.q for r in exact_quantiles(df, ["g"], "v", at, "q", small).collect()}
        assert got.keys() == {*groups, "none"} and got["none"] == [None] * len(at)
        for k, g in groups.items():
            assert np.allclose(got[k], np.quantile(g, at), rtol=1e-12, atol=1e-12), k
    one = exact_quantiles(df.where("g = 'skew'"), [], "v", at, "q").first()
    assert np.allclose(one.q, np.quantile(groups["skew"], at), rtol=1e-12)


def test_custom_statistics(spark):
    rng = np.random.default_rng(4)
    rows = [(g, i, float(v), i % 2 == 0) for g, shift in (("same", 0.0), ("apart", 1.2)) for i, v in enumerate(rng.normal(size=60) + shift * (np.arange(60) % 2))] + [("alone", 1, 2.0, True), ("same", 99, None, True)]
    df = spark.createDataFrame(rows, "g string, i long, v double, first boolean")
    for statistic in (lambda a, b: a.mean() - b.mean(), lambda a, b: np.median(a) - np.median(b)):
        got = {r.g: r for r in ev.custom_permutation_test(df, ["g"], "i", "v", F.col("first"), statistic, 2000).collect()}
        assert got["alone"].p is None and got["apart"].p < 0.01 and got["same"].p > 0.05
        for g in ("same", "apart"):
            v = np.array([r[2] for r in rows if r[0] == g and r[2] is not None])
            one = np.array([r[3] for r in rows if r[0] == g and r[2] is not None])
            seen = statistic(v[one], v[~one])
            assert abs(got[g].statistic - seen) < 1e-12
            draws = [abs(statistic(d[: one.sum()], d[one.sum() :])) for d in (rng.permutation(v) for _ in range(2000))]
            assert abs(got[g].p - np.mean(np.array(draws) >= abs(seen) - 1e-12)) < 0.04
    greater = {r.g: r.p for r in ev.custom_permutation_test(df, ["g"], "i", "v", F.col("first"), lambda a, b: a.mean() - b.mean(), 1000, "greater").collect()}
    assert greater["apart"] > 0.99
    # the mean difference agrees with the test by group sums, on pairs whose sides are dealt anew
    with pytest.raises(ValueError):
        ev.custom_permutation_test(df, ["g"], "i", "v", F.col("first"), np.mean, alternative="sideways")
