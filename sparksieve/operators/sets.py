"""Feature sets and masks as arrays, and comparisons of sets between trees or rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import stored


def jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b|, 0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def merged(a: Column, b: Column, how: str) -> Column:
    """Union, intersection or difference, sorted."""
    op = {"union": F.array_union, "intersection": F.array_intersect, "difference": F.array_except}[how]
    return F.array_sort(op(a, b))


#: Sets of a block, and pairs that are sent at a time; members whose columns of a block's matrix are in memory at a time.
BLOCK, SENT, MEMBERS = 4096, 1 << 18, 1024


def overlap_pairs(sets: DataFrame, key: str, features: str) -> DataFrame:
    """(a, b, jaccard) of every pair of keys that share a feature.

    Keys without a common member form no row; their similarity is 0.  Where sets share little, common
    members are counted by a join on the feature.  Where that would make more rows than there are
    pairs, blocks of sets meet instead, each pair of blocks in one place, and pairs are made and sent a
    slice at a time: what is shuffled are sets, once for each block, never pairs.
    """
    rows = sets.select(F.col(key).alias("k"), F.explode(features).alias("f"))
    shared = rows.groupBy("f").agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") * (F.col("c") - 1) / 2), F.lit(0.0)).alias("joined"))
    one = shared.crossJoin(sets.agg(F.count(F.lit(1)).alias("n"))).first()  # one row each
    if one["joined"] > one["n"] * (one["n"] - 1) / 2:
        return block_pairs(sets, key, features, 1 + one["n"] // BLOCK)
    size = sets.select(F.col(key).alias("k"), F.size(features).alias("n"))
    both = rows.select(F.col("k").alias("a"), "f").join(rows.select(F.col("k").alias("b"), "f"), "f").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    j = both.join(size.select(F.col("k").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("k").alias("b"), F.col("n").alias("nb")), "b")
    return j.select("a", "b", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("jaccard"))


def block_pairs(sets: DataFrame, key: str, features: str, blocks: int) -> DataFrame:
    """``overlap_pairs`` by pairs of ``blocks`` ranges of the keys."""
    dealt = stored(sets.select(F.col(key).alias("k"), F.col(features).alias("f")).repartitionByRange(blocks, "k").withColumn("block", F.spark_partition_id()), "blocks")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    cells = dealt.withColumn("other", other).select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "k", "f")
    cells = cells.repartition(blocks * (blocks + 1) // 2, "i", "j").sortWithinPartitions("i", "j", "block", "k")

    def pairs(i: int, j: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(held).combine_chunks()
        keys, lists, size = got.column("k").combine_chunks(), got.column("f").combine_chunks(), pc.list_value_length(got.column("f")).combine_chunks().to_numpy(zero_copy_only=False)
        members = lists.flatten().dictionary_encode()
        row, place = np.repeat(np.arange(len(keys)), np.nan_to_num(size).astype(np.int64)), members.indices.to_numpy(zero_copy_only=False)
        known = ~np.isnan(place) if place.dtype.kind == "f" else np.ones(len(place), dtype=bool)
        row, place = row[known], place[known].astype(np.int64)
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        cuts = np.searchsorted(place, np.arange(0, len(members.dictionary) + MEMBERS, MEMBERS))
        block = got.column("block").to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        step = max(1, SENT // max(1, len(right)))

        def matrix(k: int) -> np.ndarray:
            has = np.zeros((len(keys), min(MEMBERS, len(members.dictionary))), dtype=np.float32)
            has[row[cuts[k] : cuts[k + 1]], place[cuts[k] : cuts[k + 1]] % MEMBERS] = 1
            return has

        parts = len(cuts) - 1
        first = matrix(0) if parts == 1 else None
        for lo in range(0, len(left), step):
            own = left[lo : lo + step]
            common = np.zeros((len(own), len(right)), dtype=np.float32)
            for k in range(parts):
                has = matrix(k) if first is None else first
                common += has[own] @ has[right].T
            # keys rise within a block and from block to block; equal ones are no pair
            u, v = np.nonzero((common > 0) & (own[:, None] < right))
            a, b = own[u], right[v]
            c = common[u, v].astype(np.float64)
            out = pa.RecordBatch.from_arrays([keys.take(pa.array(a)), keys.take(pa.array(b)), pa.array(c / (size[a] + size[b] - c))], names=["a", "b", "jaccard"])
            yield out.filter(pc.less(out.column("a"), out.column("b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])]) if len(i) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(i)]):
                if held and now != (i[lo], j[lo]):
                    yield from pairs(*now, held)
                    held = []
                now = (i[lo], j[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from pairs(*now, held)

    kind = dealt.schema["k"].dataType
    return cells.mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("jaccard", T.DoubleType())]))


def overlap_summary(sets: DataFrame, key: str, features: str) -> DataFrame:
    """One row: mean, largest and smallest Jaccard over all pairs, those without a common member included.

    Equal sets are one set with a multiplicity, so only different sets are compared;
    pairs within a set count 1, or 0 where it is empty.
    """
    groups = sets.groupBy(F.array_sort(F.array_distinct(features)).alias("f")).agg(F.min(key).alias("k"), F.count(F.lit(1)).alias("m"))
    inner = groups.where("m > 1").select((F.col("m") * (F.col("m") - 1) / 2).cast("long").alias("w"), F.when(F.size("f") > 0, 1.0).otherwise(0.0).alias("jaccard"))
    times = groups.select("k", "m")
    across = overlap_pairs(groups, "k", "f").join(times.select(F.col("k").alias("a"), F.col("m").alias("ma")), "a").join(times.select(F.col("k").alias("b"), F.col("m").alias("mb")), "b").select((F.col("ma") * F.col("mb")).alias("w"), "jaccard")
    found = inner.union(across).agg(F.coalesce(F.sum("w"), F.lit(0)).alias("c"), F.coalesce(F.sum(F.col("jaccard") * F.col("w")), F.lit(0.0)).alias("s"), F.coalesce(F.max("jaccard"), F.lit(0.0)).alias("hi"), F.min("jaccard").alias("lo"))
    n = sets.agg(F.count(F.lit(1)).alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return found.crossJoin(n).select(F.when(pairs > 0, F.col("s") / pairs).otherwise(0.0).alias("mean"), F.col("hi").alias("high"), F.when(F.col("c") < pairs, F.lit(0.0)).otherwise(F.coalesce("lo", F.lit(0.0))).alias("low"))  # one row each


def mask_merge(masks: DataFrame, how: str, weight: str | None = None) -> DataFrame:
    """One mask out of (mask_id, feature_id, selected, rejected, available, locked).

    intersection: selected and available by AND, rejected and locked by OR;
    union: the other way round; weighted: selected where the weighted share is
    above one half; a feature that is selected isn't rejected.
    """
    if how == "weighted":
        w = F.col(weight)
        share = F.sum(F.when(F.col("selected"), w).otherwise(0.0)) / F.sum(w)
        return masks.groupBy("feature_id").agg((share > 0.5).alias("selected"), F.bool_or("rejected").alias("rejected")).select("feature_id", "selected", (F.col("rejected") & ~F.col("selected")).alias("rejected"))
    both, either = (F.bool_and, F.bool_or) if how == "intersection" else (F.bool_or, F.bool_and)
    return masks.groupBy("feature_id").agg(both("selected").alias("selected"), either("rejected").alias("rejected"), both("available").alias("available"), either("locked").alias("locked"))


def mask_priority(masks: DataFrame, priority: str) -> DataFrame:
    """Each feature's state by the first mask, in priority order, that selects or rejects it."""
    said = F.col("selected") | F.col("rejected")
    first = masks.where(said).groupBy("feature_id").agg(F.min_by("selected", priority).alias("selected"))
    return masks.select("feature_id").distinct().join(first, "feature_id", "left").select("feature_id", F.coalesce("selected", F.lit(False)).alias("selected"), (F.col("selected") == F.lit(False)).alias("r")).select("feature_id", "selected", F.coalesce("r", F.lit(False)).alias("rejected"))


def mask_action(state: Column, action: Column) -> Column:
    """State after an action; locked stays, and unknown actions change nothing."""
    return (
        F.when((state == "locked") & (action != "restore"), state)
        .when(action == "select", F.lit("selected"))
        .when(action == "reject", F.lit("rejected"))
        .when(action.isin("deselect", "restore"), F.lit("available"))
        .when(action == "lock", F.lit("locked"))
        .otherwise(state)
    )


def inherited(child: DataFrame, parent: DataFrame, strength: float, key: str = "feature_id") -> DataFrame:
    """Child masks (feature_id, selected, rejected, available, locked, priority) under the constraints of a parent with a row a feature.

    Available by AND, rejected by OR, locked by OR from a strength of one half
    on; the priority is the mean of the child's and the weakened parent's; what is rejected isn't available, what
    isn't available isn't selected.  A feature that the parent doesn't have keeps its own state.
    """
    p = parent.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in ("rejected", "available", "locked", "priority")])
    both = child.join(p, F.col(key) == F.col("__k"), "left")
    rejected = F.col("rejected") | F.coalesce("__rejected", F.lit(False))
    available = F.col("available") & F.coalesce("__available", F.lit(True)) & ~rejected
    locked = F.col("locked") | F.coalesce("__locked", F.lit(False)) if strength >= 0.5 else F.col("locked")
    priority = F.coalesce((F.col("priority") + F.col("__priority") * strength) / 2, F.col("priority"))
    kept = [c for c in child.columns if c not in ("selected", "rejected", "available", "locked", "priority")]
    return both.select(*kept, (F.col("selected") & available).alias("selected"), rejected.alias("rejected"), available.alias("available"), locked.alias("locked"), priority.alias("priority"))


def mask_faults(masks: DataFrame, by: list[str], least: int = 1, most: int = 10**9) -> DataFrame:
    """(by..., faults): what is wrong with each mask (feature_id, selected, rejected, available, locked), in order; none is an empty list."""
    clash = lambda a, b: F.bool_or(a & b)
    c = {n: F.col(n) for n in ("selected", "rejected", "available", "locked")}
    found = {
        "selected and rejected": clash(c["selected"], c["rejected"]),
        "selected but not available": clash(c["selected"], ~c["available"]),
        "available and rejected": clash(c["available"], c["rejected"]),
        "too few available": F.count_if("available") < least,
        "too many selected": F.count_if("selected") > most,
        "locked and rejected": clash(c["locked"], c["rejected"]),
    }
    flags = masks.groupBy(*by).agg(*[v.alias(f"__{i}") for i, v in enumerate(found.values())])
    texts = F.array(*[F.when(F.col(f"__{i}"), F.lit(k)) for i, k in enumerate(found)])
    return flags.select(*by, F.filter(texts, lambda x: x.isNotNull()).alias("faults"))


def subset_status(subset: Column, known: Column) -> Column:
    """VALID, WARNING (repeated members) or INVALID (unknown members)."""
    return F.when(F.size(F.array_except(subset, known)) > 0, "INVALID").when(F.size(F.array_distinct(subset)) < F.size(subset), "WARNING").otherwise("VALID")
