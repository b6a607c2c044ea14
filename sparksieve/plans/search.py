"""Subset search and model evaluation: seeded trees, cheap surrogates, MLlib models.

The search relations are small (trees, features): each seeded tree runs its own
UCB1 search in a task, over feature scores that Spark computed from the data.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quantiles import exact_quantiles
from ..shared import remove, scratch, stored


def set_reward(scores: list[float], chosen: set[int]) -> float:
    """The size-corrected surrogate: sum of scores over the square root of the size."""
    return sum(scores[i] for i in chosen) / math.sqrt(len(chosen)) if chosen else 0.0


def grow(scores: list[float], seed: int, iterations: int, size: int, c: float) -> tuple[list[int], float, int]:
    """(best set, its reward, nodes) of one UCB1 tree: select, expand, random rollout, backpropagate."""
    rng, n = random.Random(seed), len(scores)
    visits: dict[tuple[int, ...], int] = {}
    totals: dict[tuple[int, ...], float] = {}
    best: tuple[float, list[int]] = (-math.inf, [])
    for _ in range(iterations):
        node: tuple[int, ...] = ()
        path = [node]
        while len(node) < size:
            free = [i for i in range(node[-1] + 1 if node else 0, n - (size - len(node)) + 1)]
            if not free:
                break
            fresh = [i for i in free if (*node, i) not in visits]
            if fresh:
                node = (*node, rng.choice(fresh))
                path.append(node)
                break
            node = (*node, max(free, key=lambda i: totals[(*node, i)] / visits[(*node, i)] + c * math.sqrt(math.log(visits.get(node, 1) + 1) / visits[(*node, i)])))
            path.append(node)
        rest = rng.sample([i for i in range(n) if i not in node], max(0, min(size, n) - len(node)))
        chosen = {*node, *rest}
        reward = set_reward(scores, chosen)
        if reward > best[0]:
            best = (reward, sorted(chosen))
        for p in path:
            visits[p] = visits.get(p, 0) + 1
            totals[p] = totals.get(p, 0.0) + reward
    return best[1], best[0], len(visits)


def forest(scores: DataFrame, seeds: DataFrame, score: str, iterations: int = 200, size: int = 8, c: float = 1.4, share: float = 0.8) -> DataFrame:
    """(tree_id, selected, reward, nodes): a tree for each seed over its own hash-drawn share of the features.

    scores has a row a feature and is broadcast: as many rows as the table has
    columns.
    """
    known = [(r["feature"], float(r[score])) for r in scores.orderBy("feature").collect()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch["tree_id"].tolist():
                rng = random.Random(t)
                own = [k for k in known if rng.random() < share] or known
                chosen, reward, nodes = grow([s for _, s in own], t, iterations, min(size, len(own)), c)
                rows.append((t, [own[i][0] for i in chosen], reward, nodes))
            yield pd.DataFrame(rows, columns=["tree_id", "selected", "reward", "nodes"])

    return seeds.select("tree_id").mapInPandas(run, "tree_id long, selected array<string>, reward double, nodes long")


def candidates(scores: DataFrame, n: int, size: int, seed: int = 0) -> list[list[str]]:
    """Distinct subsets: random, best plus random, windows over the ranking, strides; all subsets of few features."""
    from itertools import combinations

    names = [r["feature"] for r in scores.orderBy(F.desc("score"), "feature").collect()]
    if len(names) <= 5:
        return [list(c) for k in range(1, len(names) + 1) for c in combinations(names, k)]
    rng, out = random.Random(seed), []
    size = min(size, len(names))
    for i in range(n):
        kind = i % 10
        if kind < 4:
            s = rng.sample(names, size)
        elif kind < 7:
            s = [*names[: size // 2], *rng.sample(names[size // 2 :], size - size // 2)]
        elif kind < 9:
            a = rng.randrange(len(names) - size + 1)
            s = names[a : a + size]
        else:
            s = names[rng.randrange(3) :: max(1, len(names) // size)][:size]
        out.append(sorted(s))
    return [list(x) for x in dict.fromkeys(map(tuple, out))]


def assembled(df: DataFrame, names: list[str], label: Column) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="skip").transform(df.withColumn("label", label.cast("double")))


def model(kind: str, **params):
    """An MLlib classifier (logistic, forest, boosted) or regressor (linear, forest_regressor, boosted_regressor)."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    regressors = {"linear": lambda: LinearRegression(maxIter=20, **params), "forest_regressor": lambda: RandomForestRegressor(numTrees=10, maxDepth=4, seed=1, **params), "boosted_regressor": lambda: GBTRegressor(maxIter=5, maxDepth=3, seed=1, **params)}
    return (regressors | {"logistic": lambda: LogisticRegression(maxIter=20, **params), "forest": lambda: RandomForestClassifier(numTrees=10, maxDepth=4, seed=1, **params), "boosted": lambda: GBTClassifier(maxIter=5, maxDepth=3, seed=1, **params)})[kind]()


def fitted_on(estimator, data: DataFrame):
    """The fitted model without its training summary, which holds the session and so can't go to tasks once something observes."""
    model = estimator.fit(data)
    path = scratch(data.sparkSession, "model")
    model.write().save(path)
    try:
        return type(model).load(path)
    finally:
        remove(data.sparkSession, path)


def predicted(fitted, df: DataFrame) -> DataFrame:
    """df with ``p``, the probability of label 1."""
    from pyspark.ml.functions import vector_to_array

    return fitted.transform(df).withColumn("p", vector_to_array("probability")[1])


def cross_validated(df: DataFrame, subsets: list[list[str]], kinds: list[str], label: Column, fold: str, folds: int) -> DataFrame:
    """(subset, model, fold, accuracy) over the grid; the models fit in Spark."""
    scored, held = None, []
    for names in subsets:
        data = assembled(df, names, label).select("features", "label", fold).cache()
        held.append(data)
        for kind in kinds:
            for k in range(folds):
                fitted = fitted_on(model(kind), data.where(F.col(fold) != k))
                hit = ((F.col("p") >= 0.5).cast("double") == F.col("label")).cast("double").alias("hit")
                one = predicted(fitted, data.where(F.col(fold) == k)).select(F.lit(",".join(names)).alias("subset"), F.lit(kind).alias("model"), F.lit(k).alias("fold"), hit)
                scored = one if scored is None else scored.union(one)
    # all held-out predictions are scored in one job
    try:
        return stored(scored.groupBy("subset", "model", "fold").agg(F.avg("hit").alias("accuracy")), "cross-validated")
    finally:
        for data in held:
            data.unpersist()


def permuted(df: DataFrame, names: list[str], id: str, rounds: int = 1, rows: int = 10_000, seed: int = 0) -> DataFrame:
    """df with ``name#r`` for each name and round r: its values dealt to other rows, each column and round on its own.

    Rows meet in buckets of about ``rows`` by a hash of their ids, which one pass
    deals out; within a bucket a seeded generator shuffles each column, in the order of the ids' hashes.
    """
    buckets = 1 + df.count() // rows
    key = F.xxhash64(F.col(id), F.lit(seed))
    dealt = df.withColumns({"__h": key, "__b": F.pmod(key, F.lit(buckets))})
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {k}" for c, k in df.dtypes) + "".join(f", `{n}#{r}` {kinds[n]}" for r in range(rounds) for n in names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__h")
        rng = random.Random(f"{seed}.{int(pdf['__b'].iloc[0])}")
        out = pdf.drop(columns=["__h", "__b"])
        for r in range(rounds):
            for n in names:
                order = list(range(len(out)))
                rng.shuffle(order)
                out[f"{n}#{r}"] = pdf[n].to_numpy()[order]
        return out

    return dealt.groupBy("__b").applyInPandas(run, schema)


def scored_variants(fitted, df: DataFrame, variants: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """``keep`` and, for each variant, the probability of label 1 when the model gets the variant's columns for its own; one pass."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    model, done = fitted.stages[-1], []
    out = df.select(*dict.fromkeys([*keep, *(c for v in variants.values() for c in v)]))
    for name, columns in variants.items():
        with_vector = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(out)
        out = model.transform(with_vector).withColumn(f"p:{name}", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
        done.append(f"p:{name}")
    return out.select(*keep, *done)


def _fitted_and_permuted(df: DataFrame, names: list[str], label: Column, id: str, kind: str, rounds: int):
    """A model of df, and df's features, label and permuted features, written."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    data = df.select(id, *names, label.cast("double").alias("label"))
    fitted = fitted_on(Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), model(kind)]), data)
    return fitted, stored(permuted(data, names, id, rounds), "permuted")


def permutation_importance(df: DataFrame, names: list[str], label: Column, id: str, kind: str = "logistic", repeats: int = 2) -> DataFrame:
    """(feature, importance, half_width): accuracy lost when a column is shuffled; the rows are dealt once and scored in one pass."""
    fitted, mixed = _fitted_and_permuted(df, names, label, id, kind, repeats)
    variants = {"": names} | {f"{f}/{r}": [f"{f}#{r}" if n == f else n for n in names] for f in names for r in range(repeats)}
    scored = scored_variants(fitted, mixed, variants, ["label"])
    hit = lambda v: F.avg(((F.col(f"`p:{v}`") >= 0.5).cast("double") == F.col("label")).cast("double"))
    one = scored.agg(*[hit(v).alias(f"a:{v}") for v in variants])
    lost = F.array(*[F.struct(F.lit(f).alias("feature"), (F.col("`a:`") - F.col(f"`a:{f}/{r}`")).alias("d")) for f in names for r in range(repeats)])
    return one.select(F.explode(lost).alias("l")).select("l.*").groupBy("feature").agg(F.avg("d").alias("importance"), (1.96 * F.coalesce(F.stddev_samp("d"), F.lit(0.0)) / math.sqrt(repeats)).alias("half_width"))


def additivity_gaps(df: DataFrame, names: list[str], label: Column, id: str, kind: str = "forest") -> DataFrame:
    """(f1, f2, strength): mean |p(both changed) - (p(first changed) + p(second changed) - p)| over all rows, where a changed feature has another row's value."""
    fitted, mixed = _fitted_and_permuted(df, names, label, id, kind, 1)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    change = lambda *fs: [f"{n}#0" if n in fs else n for n in names]
    variants = {"": names} | {f: change(f) for f in names} | {f"{a}*{b}": change(a, b) for a, b in pairs}
    p = lambda v: F.col(f"`p:{v}`")
    gap = lambda a, b: F.avg(F.abs(p(f"{a}*{b}") - (p(a) + p(b) - p(""))))
    one = scored_variants(fitted, mixed, variants, ["label"]).agg(*[gap(a, b).alias(f"g:{a}*{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(f"`g:{a}*{b}`").alias("strength")) for a, b in pairs])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def ablation_importance(df: DataFrame, names: list[str], label: Column, kind: str = "logistic") -> DataFrame:
    """(feature, importance): mean |p(x) - p(x with the feature at its mean)|."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    data = df.withColumn("label", label.cast("double"))
    fitted = fitted_on(Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), model(kind)]), data)
    means = data.agg(*[F.avg(f).alias(f) for f in names]).first()
    whole = predicted(fitted, data).select(*names, F.col("p").alias("p0"))
    out = None
    for f in names:
        one = predicted(fitted, whole.withColumn(f, F.lit(float(means[f])))).agg(F.avg(F.abs(F.col("p") - F.col("p0"))).alias("importance")).select(F.lit(f).alias("feature"), "importance")
        out = one if out is None else out.union(one)
    return out


def forward_selection(df: DataFrame, ranked: list[str], pairs: dict[tuple[str, str], float], label: Column, fold: str, folds: int, kind: str = "logistic", most: float = 0.95, patience: int = 2) -> DataFrame:
    """(step, feature, accuracy, kept): features in rank order, each kept if cross-validation gains by it.

    A feature that is correlated at ``most`` or above with one kept before is
    skipped; ``patience`` features in a row without a gain end the walk.  A
    step fits ``folds`` models; its rows are features of the table.
    """
    kept, rows, best, idle = [], [], 0.0, 0
    for name in ranked:
        if any(abs(pairs.get((min(name, k), max(name, k)), 0.0)) >= most for k in kept):
            continue
        accuracy = cross_validated(df, [[*kept, name]], [kind], label, fold, folds).agg(F.avg("accuracy")).first()[0] or 0.0
        gain = accuracy > best + 1e-9
        rows.append((len(rows) + 1, name, float(accuracy), gain))
        best, idle = (accuracy, 0) if gain else (best, idle + 1)
        kept += [name] if gain else []
        if idle >= patience:
            break
    return df.sparkSession.createDataFrame(rows, "step long, feature string, accuracy double, kept boolean")


def shapley_sampled(df: DataFrame, names: list[str], label: Column, id: str, orders: int = 4, kind: str = "logistic", seed: int = 0) -> DataFrame:
    """(feature, importance): mean |Shapley value| over the rows, by sampled orders of the features.

    In an order, features get the row's own values one after the other, the
    others standing at their means; what a prediction gains is its feature's
    share.  A subset that several orders come through is scored once; all are scored in one pass, and nothing is shuffled.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    data = df.withColumn("label", label.cast("double"))
    fitted = fitted_on(Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), model(kind)]), data)
    means = data.agg(*[F.avg(f).alias(f) for f in names]).first()
    frame = data.select(*[F.col(f).cast("double").alias(f) for f in names], *[F.lit(float(means[f] or 0.0)).alias(f"{f}#m") for f in names])
    of = lambda own: ",".join(sorted(own))
    variants, gains = {}, {f: [] for f in names}
    for order in sampled_orders(names, orders, seed):
        for k in range(len(names) + 1):
            variants[of(order[:k])] = [f if f in order[:k] else f"{f}#m" for f in names]
            if k:
                gains[order[k - 1]].append((of(order[:k]), of(order[: k - 1])))
    p = lambda v: F.col(f"`p:{v}`")
    shares = [F.avg(F.abs(sum((p(x) - p(y) for x, y in gains[f]), F.lit(0.0)) / orders)).alias(f) for f in names]
    one = scored_variants(fitted, frame, variants, []).agg(*shares)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").alias("importance")) for f in names])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def sampled_orders(names: list[str], orders: int, seed: int) -> list[list[str]]:
    rng = random.Random(seed)
    return [rng.sample(names, len(names)) for _ in range(orders)]


def joint_degradation(df: DataFrame, names: list[str], label: Column, id: str, kind: str = "logistic", repeats: int = 1) -> DataFrame:
    """(f1, f2, interaction): accuracy lost when both columns are shuffled, beyond what each loses alone; the rows are dealt once and scored in one pass."""
    fitted, mixed = _fitted_and_permuted(df, names, label, id, kind, repeats)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    sets = [(f,) for f in names] + pairs
    variants = {"": names} | {f"{','.join(s)}/{r}": [f"{n}#{r}" if n in s else n for n in names] for s in sets for r in range(repeats)}
    hit = lambda v: F.avg(((F.col(f"`p:{v}`") >= 0.5).cast("double") == F.col("label")).cast("double"))
    one = scored_variants(fitted, mixed, variants, ["label"]).agg(*[hit(v).alias(f"a:{v}") for v in variants])
    lost = lambda *s: sum((F.col("`a:`") - F.col(f"`a:{','.join(s)}/{r}`") for r in range(repeats)), F.lit(0.0)) / repeats
    rows = F.array(*[F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), (lost(a, b) - lost(a) - lost(b)).alias("interaction")) for a, b in pairs])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def pair_interactions(df: DataFrame, names: list[str], label: Column, grid: int = 20, kind: str = "forest") -> DataFrame:
    """(f1, f2, strength, h): root mean square of what partial dependence on two features adds to that on each, and its share of the joint dependence's spread (Friedman's H).

    The model's mean prediction is taken over grid points built from the
    features' quantiles, the other features at their means.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import Window

    spark = df.sparkSession
    data = df.withColumn("label", label.cast("double"))
    fitted = fitted_on(Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), model(kind)]), data)
    long = data.select(*[F.col(f).cast("double").alias(f) for f in names]).unpivot([], names, "feature", "value")
    known = exact_quantiles(long, ["feature"], "value", [(i + 0.5) / grid for i in range(grid)], "q", small=True)
    means = data.agg(*[F.avg(f).alias(f) for f in names]).first()
    # a row a column
    row = {f"{r['feature']}#q": r["q"] for r in known.collect()} | {f"{f}#m": means[f] for f in names}
    points = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            for x in row[f"{a}#q"]:
                for y in row[f"{b}#q"]:
                    values = {f: float(row[f"{f}#m"]) for f in names} | {a: float(x), b: float(y)}
                    points.append((a, b, float(x), float(y), *[values[f] for f in names]))
    frame = spark.createDataFrame(points, "f1 string, f2 string, x double, y double, " + ", ".join(f"`{f}` double" for f in names))
    p = predicted(fitted, frame).select("f1", "f2", "x", "y", "p")
    over = lambda *by: F.avg("p").over(Window.partitionBy("f1", "f2", *by))
    gap = F.col("p") - over("x") - over("y") + over()
    centred = F.col("p") - over()
    g = p.select("f1", "f2", gap.alias("g"), centred.alias("c")).groupBy("f1", "f2").agg(F.sqrt(F.avg(F.col("g") * F.col("g"))).alias("strength"), F.sqrt(F.avg(F.col("c") * F.col("c"))).alias("spread"))
    return g.select("f1", "f2", "strength", F.when(F.col("spread") > 1e-12, F.col("strength") / F.col("spread")).otherwise(0.0).alias("h"))


def combined_interactions(parts: list[tuple[DataFrame, str]]) -> DataFrame:
    """(f1, f2, score): the mean of several interaction measures, each as |value| over its largest; a row a pair of features."""
    from pyspark.sql import Window

    w, rows = Window.partitionBy(F.lit(1)), None
    for df, value in parts:
        one = df.select("f1", "f2", F.coalesce(F.try_divide(F.abs(value), F.max(F.abs(value)).over(w)), F.lit(0.0)).alias("s"))
        rows = one if rows is None else rows.union(one)
    return rows.groupBy("f1", "f2").agg(F.avg("s").alias("score"))


def seeds_of(spark: SparkSession, df: DataFrame, key: str) -> DataFrame:
    """(tree_id): a tree for each distinct key."""
    return df.select(F.col(key).cast("long").alias("tree_id")).distinct()
