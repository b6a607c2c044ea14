"""Tree search over feature subsets in rounds of Spark jobs: many trees in lockstep, rewards read from the rows.

A forest is a table with a row a node: its tree, its path of chosen features,
visits and total value.  In a round every tree is one group; a small step backs up
the values of the leaves of the round before, then walks down ``batch`` times and
hands out as many leaves.  Visits that are still under way count as losses
(virtual loss), so the walks of a batch spread.  All leaves of all trees are then
scored by tasks out of the sums of products (operators.grams), so a reward is the
held-out R^2 of the subset.  The table is written between rounds; a round that
is lost is done again, and a forest can be resumed from its last table.

A walk takes the child of the largest
total / visits + c sqrt(ln(parent's visits) / visits) + prior / (1 + visits); a
child without visits comes first, of several the one of the largest prior, by lot
among equals.  A zero prior makes this UCB1.  Going up, a value is damped at
each node, v = damping v + (1 - damping) average so far; a node has converged when
it has enough visits and its average moved less than a threshold in the last round.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grams import Grams, scored_subsets
from ..shared import remove, scratch

STATE = "tree_id long, kind string, path string, visits long, total double, delta double, converged boolean, seq int, subset array<int>"


class Tree:
    """One tree of a round: node statistics, and the walks under way."""

    def __init__(self, own: np.ndarray, size: int, c: float, prior: np.ndarray, loss: float):
        #: the places of features that the tree may choose, in the order of their ranks
        self.own, self.size, self.c, self.prior, self.loss = own, min(size, len(own)), c, prior[own], loss
        self.nodes: dict[tuple[int, ...], list[float]] = {(): [0, 0.0, 0.0]}
        self.below: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray]] = {}
        self.under_way: dict[tuple[int, ...], int] = {}

    def add(self, node: tuple[int, ...], visits: int, total: float) -> None:
        self.nodes[node] = [visits, total, 0.0]

    def children(self, node: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Visits and totals of a node's children, those under way included."""
        if node not in self.below:
            self.below[node] = (np.zeros(len(self.own)), np.zeros(len(self.own)))
        return self.below[node]

    def open(self) -> None:
        """Lay the nodes out for walking down."""
        for node, (visits, total, _) in self.nodes.items():
            if node:
                v, t = self.children(node[:-1])
                v[node[-1]], t[node[-1]] = visits, total

    def walk(self, rng: random.Random) -> list[tuple[int, ...]]:
        """Nodes from the root to a new one, or to a full subset; they are under way from now on."""
        node: tuple[int, ...] = ()
        path = [node]
        while len(node) < self.size:
            lo, hi = node[-1] + 1 if node else 0, len(self.own) - (self.size - len(node)) + 1
            v, t = (x[lo:hi] for x in self.children(node))
            fresh = np.flatnonzero(v == 0)
            if len(fresh):
                p = self.prior[lo:hi][fresh]
                best = fresh[p == p.max()]
                node = (*node, lo + int(best[rng.randrange(len(best))]))
                path.append(node)
                break
            n = self.nodes.get(node, [0])[0] + self.under_way.get(node, 0)
            node = (*node, lo + int(np.argmax(t / v + self.c * np.sqrt(np.log(max(n, 1)) / v) + self.prior[lo:hi] / (1 + v))))
            path.append(node)
        for p in path:
            self.under_way[p] = self.under_way.get(p, 0) + 1
            if p:
                v, t = self.children(p[:-1])
                v[p[-1]] += 1
                t[p[-1]] -= self.loss
        return path

    def filled(self, node: tuple[int, ...], rng: random.Random) -> list[int]:
        """The node's features and as many others as a subset lacks, as places."""
        rest = rng.sample([i for i in range(len(self.own)) if i not in node], self.size - len(node))
        return sorted(int(self.own[i]) for i in (*node, *rest))

    def back_up(self, leaf: tuple[int, ...], value: float, damping: float) -> None:
        """The leaf's value, damped at every node on its way up."""
        for k in range(len(leaf), -1, -1):
            s = self.nodes.setdefault(leaf[:k], [0, 0.0, 0.0])
            before = s[1] / s[0] if s[0] else 0.0
            value = damping * value + (1 - damping) * before
            s[0], s[1] = s[0] + 1, s[1] + value
            s[2] = max(s[2], abs(s[1] / s[0] - before))


def text(node: tuple[int, ...]) -> str:
    return ".".join(map(str, node))


def node_of(path: str) -> tuple[int, ...]:
    return tuple(map(int, path.split("."))) if path else ()


def own_features(tree: int, width: int, share: float) -> np.ndarray:
    """The ranks that a tree may choose, drawn by its seed."""
    rng = random.Random(tree)
    return np.array([i for i in range(width) if rng.random() < share] or range(width))


def turn(pdf: pd.DataFrame, number: int, batch: int, size: int, c: float, share: float, loss: float, damping: float, least: int, threshold: float, prior: np.ndarray) -> pd.DataFrame:
    """One tree's round: back up the scored leaves, then hand out ``batch`` new ones."""
    key = int(pdf["tree_id"].iloc[0])
    tree = Tree(own_features(key, len(prior), share), size, c, prior, loss)
    nodes, leaves, best = pdf[pdf["kind"] == "node"], pdf[pdf["kind"] == "leaf"].sort_values("seq"), pdf[pdf["kind"] == "best"]
    for path, visits, total in zip(nodes["path"], nodes["visits"], nodes["total"]):
        tree.add(node_of(path), int(visits), float(total))
    top = (float(best["total"].iloc[0]), list(best["subset"].iloc[0])) if len(best) else (-np.inf, [])
    for path, subset, score in zip(leaves["path"], leaves["subset"], leaves["score"]):
        tree.back_up(node_of(path), float(score), damping)
        if score > top[0]:
            top = (float(score), list(subset))
    rows = [(key, "node", text(n), int(v), t, d, bool(v >= least and d < threshold), 0, None) for n, (v, t, d) in tree.nodes.items()]
    if top[1]:
        rows.append((key, "best", "", 0, top[0], 0.0, False, 0, top[1]))
    if batch:
        rng = random.Random(f"{key}.{number}")
        tree.open()
        for i in range(batch):
            path = tree.walk(rng)
            rows.append((key, "leaf", text(path[-1]), 0, 0.0, 0.0, False, i, tree.filled(path[-1], rng)))
    return pd.DataFrame(rows, columns=["tree_id", "kind", "path", "visits", "total", "delta", "converged", "seq", "subset"])


def grown(spark: SparkSession, seeds: DataFrame, grams: Grams, order: list[int], rounds: int = 20, batch: int = 50, size: int = 8, c: float = 1.4, share: float = 0.8, prior: list[float] | None = None, loss: float = 1.0, damping: float = 1.0, least: int = 10, threshold: float = 0.01, start: DataFrame | None = None, done: int = 0, finish: bool = True) -> tuple[DataFrame, str]:
    """The table after ``rounds`` rounds from round ``done`` on, and its path: rows of nodes and the best subset of each tree.

    ``order`` has the features' places in the order of their ranks, ``prior`` a number for each rank.  Without ``finish`` the
    last leaves stay in the table, which as ``start`` of another call (and with the rounds ``done``) goes on as if it had never stopped.
    """
    ranks, p = np.array(order), np.array(prior if prior is not None else [0.0] * len(order), dtype=float)
    state = start if start is not None else seeds.select(F.col("tree_id").cast("long").alias("tree_id"), F.lit("node").alias("kind"), F.lit("").alias("path"), F.lit(0).cast("long").alias("visits"), F.lit(0.0).alias("total"), F.lit(0.0).alias("delta"), F.lit(False).alias("converged"), F.lit(0).alias("seq"), F.lit(None).cast("array<int>").alias("subset"), F.lit(0.0).alias("score"))
    before = None

    def step(k: int, b: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        return lambda pdf: turn(pdf, k, b, size, c, share, loss, damping, least, threshold, p)

    for k in range(done, done + rounds + finish):
        # the table is small but its trees are work: as many tasks as the session has partitions
        dealt = state.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "tree_id")
        out = dealt.groupBy("tree_id").applyInPandas(step(k, batch if k < done + rounds else 0), STATE)
        path = scratch(spark, "forest")
        # a subset is scored by places; nodes have none
        places = F.transform("subset", lambda i: F.element_at(F.lit(ranks.tolist()), i + 1).cast("int")) if len(ranks) else F.col("subset")
        scored_subsets(out.withColumn("places", F.when(F.col("kind") == "leaf", places)), grams, "places", "score").drop("places").write.parquet(path)
        state = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return state, before


#: Trees that a task grows side by side.
TOGETHER = 128


class Lockstep:
    """Many trees of one task, grown in the same rounds as ``turn`` grows one: every step is taken by all of them at once.

    A node is a number; ``child`` leads from a node and a place to the next one. The
    lots are drawn from each tree's own generator as Tree draws them, so a tree is the same in any company.
    """

    def __init__(self, keys: list[int], nodes: int, size: int, c: float, share: float, loss: float, damping: float, prior: np.ndarray):
        self.keys, self.c, self.loss, self.damping, self.trees = keys, c, loss, damping, np.arange(len(keys))
        own = [own_features(k, len(prior), share) for k in keys]
        self.lengths = np.array([len(x) for x in own])
        self.sizes, width = np.minimum(size, self.lengths), int(self.lengths.max(initial=0))
        self.own, self.prior = np.zeros((len(keys), width), dtype=np.int64), np.zeros((len(keys), width))
        for t, x in enumerate(own):
            self.own[t, : len(x)], self.prior[t, : len(x)] = x, prior[x]
        self.child = np.zeros((len(keys), nodes, width), dtype=np.int32)
        self.visits, self.total, self.delta = (np.zeros((len(keys), nodes)) for _ in range(3))
        self.last, self.used = np.full((len(keys), nodes), -1), np.ones(len(keys), dtype=np.int64)
        self.best, self.top = np.full(len(keys), -np.inf), [[] for _ in keys]

    def walk(self, rngs: list[random.Random], seen: np.ndarray, worth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, places) of a walk of each tree, -1 beyond its end; ``seen`` and ``worth`` are visits and totals with those under way."""
        most = int(self.sizes.max(initial=0))
        path, places = np.full((len(self.trees), most + 1), -1), np.full((len(self.trees), most), -1)
        path[:, 0], at, columns = 0, self.trees[self.sizes > 0], np.arange(self.own.shape[1])
        for depth in range(most):
            node = path[at, depth]
            ahead = (columns > self.last[at, node][:, None]) & (columns <= (self.lengths[at] - self.sizes[at] + depth)[:, None])
            child, prior = self.child[at, node], self.prior[at]
            fresh = ahead & (child == 0)
            some = fresh.any(axis=1)
            choice = np.zeros(len(at), dtype=np.int64)
            if some.any():
                p = np.where(fresh[some], prior[some], -np.inf)
                equal = fresh[some] & (p == p.max(axis=1, keepdims=True))
                lot = np.array([rngs[t].randrange(n) for t, n in zip(at[some].tolist(), equal.sum(axis=1).tolist())])
                choice[some] = np.argmax(np.cumsum(equal, axis=1) > lot[:, None], axis=1)
                new = at[some]
                self.child[new, node[some], choice[some]] = self.used[new]
                self.last[new, self.used[new]] = choice[some]
                self.used[new] += 1
            if not some.all():
                k = ~some
                v, w = (x[at[k][:, None], child[k]] for x in (seen, worth))
                v = np.where(ahead[k], v, 1.0)
                n = np.maximum(seen[at[k], node[k]], 1)[:, None]
                value = w / v + self.c * np.sqrt(np.log(n) / v) + prior[k] / (1 + v)
                choice[k] = np.argmax(np.where(ahead[k], value, -np.inf), axis=1)
            path[at, depth + 1], places[at, depth] = self.child[at, node, choice], choice
            at = at[~some & (depth + 1 < self.sizes[at])]
        on = path >= 0
        tree, node = np.broadcast_to(self.trees[:, None], path.shape)[on], path[on]
        seen[tree, node] += 1
        worth[tree, node] -= self.loss
        return path, places

    def filled(self, places: np.ndarray, rngs: list[random.Random]) -> np.ndarray:
        """Each walk's features and as many others as its subset lacks, as sorted ranks, -1 beyond its size."""
        taken = np.zeros(self.own.shape, dtype=bool)
        tree, nth = np.nonzero(places >= 0)
        taken[tree, places[tree, nth]] = True
        free = np.argsort(taken, axis=1, kind="stable")
        have, out = (places >= 0).sum(axis=1), places.copy()
        for t, (n, length, size) in enumerate(zip(have.tolist(), self.lengths.tolist(), self.sizes.tolist())):
            if size > n:
                out[t, n:size] = free[t, rngs[t].sample(range(length - n), size - n)]
        ranks = np.where(out >= 0, np.take_along_axis(self.own, np.maximum(out, 0), axis=1), 1 << 40)
        ranks.sort(axis=1)
        return np.where(ranks < 1 << 40, ranks, -1)

    def back_up(self, path: np.ndarray, value: np.ndarray) -> None:
        """The leaves' values, damped at every node on their way up."""
        value = value.copy()
        for depth in range(path.shape[1] - 1, -1, -1):
            t = np.flatnonzero(path[:, depth] >= 0)
            node = path[t, depth]
            n, s = self.visits[t, node], self.total[t, node]
            before = np.divide(s, n, out=np.zeros(len(t)), where=n > 0)
            value[t] = self.damping * value[t] + (1 - self.damping) * before
            n, s = n + 1, s + value[t]
            self.visits[t, node], self.total[t, node] = n, s
            self.delta[t, node] = np.maximum(self.delta[t, node], np.abs(s / n - before))

    def round(self, number: int, batch: int, scored: Callable[[np.ndarray], np.ndarray]) -> None:
        """``batch`` walks of each tree, their scores, and the way up of these."""
        rngs = [random.Random(f"{k}.{number}") for k in self.keys]
        seen, worth, paths, subsets = self.visits.copy(), self.total.copy(), [], []
        for _ in range(batch):
            path, places = self.walk(rngs, seen, worth)
            paths.append(path)
            subsets.append(self.filled(places, rngs))
        scores = scored(np.concatenate(subsets)).reshape(batch, -1)
        self.delta[:] = 0.0
        for path, subset, score in zip(paths, subsets, scores):
            self.back_up(path, score)
            for t in np.flatnonzero(score > self.best):
                self.best[t], self.top[t] = score[t], subset[t][subset[t] >= 0].tolist()


def searched(spark: SparkSession, seeds: DataFrame, grams: Grams, order: list[int], names: list[str], rounds: int = 20, batch: int = 50, size: int = 8, c: float = 1.4, share: float = 0.8, prior: list[float] | None = None, loss: float = 1.0, damping: float = 1.0, least: int = 10, threshold: float = 0.01) -> DataFrame:
    """``summary`` of the forest that ``grown`` grows, without its table of nodes: a task takes TOGETHER trees through all rounds, and nothing is written.

    A tree's nodes live as long as its search, so a forest that is to be resumed needs ``grown``.
    """
    ranks, p = np.array(order, dtype=np.int64), np.array(prior if prior is not None else [0.0] * len(order), dtype=float)
    shared = spark.sparkContext.broadcast(grams)

    def scored(subsets: np.ndarray) -> np.ndarray:
        """Scores of rows of ranks, -1 beyond their sizes."""
        sizes, out = (subsets >= 0).sum(axis=1), np.zeros(len(subsets))
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            out[at] = shared.value.scores(np.sort(ranks[subsets[at, :n]], axis=1) if n else np.zeros((len(at), 0), dtype=np.int64))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, TOGETHER):
                keys = b.column(0).slice(lo, TOGETHER).to_pylist()
                forest = Lockstep(keys, 1 + rounds * batch, size, c, share, loss, damping, p)
                for k in range(rounds):
                    forest.round(k, batch, scored)
                live = np.arange(forest.visits.shape[1]) < forest.used[:, None]
                settled = ((forest.visits >= least) & (forest.delta < threshold) & live).sum(axis=1) / forest.used
                selected = [[names[i] for i in s] if s else None for s in forest.top]
                reward = [float(v) if s else None for v, s in zip(forest.best, forest.top)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(selected, pa.list_(pa.string())), pa.array(reward, pa.float64()), pa.array(forest.used), pa.array(settled)], names=["tree_id", "selected", "reward", "nodes", "converged"])

    # the seeds are a small table but trees are work: as many tasks as the session has partitions, by ranges, since a hash that the seeds have already would be coalesced
    dealt = seeds.select(F.col("tree_id").cast("long").alias("tree_id")).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "tree_id")
    return dealt.mapInArrow(run, "tree_id long, selected array<string>, reward double, nodes long, converged double")


def summary(state: DataFrame, names: list[str]) -> DataFrame:
    """(tree_id, selected, reward, nodes, converged): each tree's best subset by name (in rank order of ``names``), its value, its nodes and the share of them that converged."""
    known = F.lit(names) if names else F.array().cast("array<string>")
    per = state.groupBy("tree_id").agg(F.count_if(F.col("kind") == "node").alias("nodes"), F.avg(F.when(F.col("kind") == "node", F.col("converged").cast("double"))).alias("converged"), F.max(F.when(F.col("kind") == "best", F.struct("total", "subset"))).alias("b"))
    return per.select("tree_id", F.transform("b.subset", lambda i: F.element_at(known, i + 1)).alias("selected"), F.col("b.total").alias("reward"), "nodes", "converged")
