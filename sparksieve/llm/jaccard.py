"""Exact n-gram Jaccard self join by grouped prefixes (operator 6).

A document's set holds its distinct word shingles.  Documents with equal sets
are one class; classes with the same prefix and size are one group, and only
groups enter the inverted index and are paired.  With the shingles in one
global order, two sets of similarity t share a shingle within their first
|x| - ceil(t|x|) + 1 (the prefix).  The order here is: shingles that are known to be
common last, otherwise by hash.  Any order gives the same result; this one keeps
passages that many documents share out of their prefixes.

1.  Count the shingles among the lowest 3/10 of the hashes; those that occur ``OFTEN``
    are common (at most ``COMMON``, the commonest).  Index the prefixes of the groups and
    keep the shingles that two classes share.
2.  Star: pair each group with one pivot group of each shared shingle, the one with
    the largest share of widely shared shingles (in a family of near copies the
    least edited); filter the group pairs by size and position, expand
    them to classes, verify, and join what links into components.  Within a
    large group of near copies this takes a linear number of pairs.
3.  Light shingles (fewer than ``HEAVY`` classes): pair the groups that are not in
    one component, each pair at its first shared shingle, behind the size and the
    positional filter; then expand the group pairs into their classes and compare
    parity sketches: each shingle of a set flips one bit, so two sketches differ in
    no more bits than the sets in members (of 256 bits while they are paired, of
    1,024 when they are expanded).
4.  Heavy shingles: their classes are grouped and indexed again with the common
    ones of all their shingles in order of frequency, rare ones first, which leaves a
    common passage outside of almost all prefixes; then as in 3, with the long
    sketches at once and the majority component of a shingle being paired with the
    others only.

Pairs whose members are in one component already need no verification, since
the result is the components; every other candidate is verified on its whole
sets, so no link between components is lost.  Verification moves each text to
the tasks of its pivots, a popular pivot being salted over several tasks.

Defined results: a text without words, empty or null, has an empty set and is
linked with nothing (its component is its own id); a text of fewer words than
the shingle is its whole sequence; repeated rows are copies of each other;
null ids take part and are smallest only where all ids of a component are null;
an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .durable import Scratch, checked_broadcast, remove, written
from .rows import need
from .textkit import Words, combine, list_array, mix64, regrouped, shingle_sets, signed, slices, tidy

#: Members from which a shingle counts as heavy.  It decides how pairs are found, never which.
HEAVY = 64
#: Occurrences from which a shingle counts as common, and how many of them are broadcast (16 bytes each), the commonest.
OFTEN, COMMON = 16, 1_000_000
#: Words of a sketch: 1,024 bits, which folded together four times make 256.
WIDE = [f"w{i}" for i in range(16)]
SKETCH = [f"s{i}" for i in range(4)]
#: Members of one pivot that a verifying task takes.
SALT_ROWS = 100
#: Pairs that are looked at together.
PAIRS = 1 << 16


def _set_hash(values: np.ndarray, bounds: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(values ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
        return mix64(sums[bounds[1:]] - sums[bounds[:-1]] + n.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def _sketches(values: np.ndarray, bounds: np.ndarray, words: int) -> np.ndarray:
    """Words of 64 bits for every set: bit k is the parity of the members whose hash picks k."""
    rows, bits = len(bounds) - 1, 64 * words
    row = np.repeat(np.arange(rows), np.diff(bounds))
    odd = np.bincount(row * bits + ((values >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=rows * bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64).reshape(rows, words)


def _prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n + (-percent * n) // 100 + 1


def _segments(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of consecutive pieces of a flat array."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def _prefixes(values: np.ndarray, bounds: np.ndarray, common: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefixes of the sets and their bounds, common shingles (hashes, ranks) coming last by rank; values are sorted within rows."""
    n = np.diff(bounds)
    p = np.where(n > 0, _prefix_length(n, percent), 0)
    hashes, ranks = common
    if len(hashes) and len(values):
        at = np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)
        rank = np.where(hashes[at] == values, ranks[at], 0)
        row = np.repeat(np.arange(len(n)), n)
        values = values[np.argsort(row * (int(ranks.max()) + 1) + rank, kind="stable")]
    return values[_segments(bounds[:-1], p)], np.concatenate([[0], np.cumsum(p)])


def common_shingles(docs: DataFrame, width: int, tenths: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes, and ranks by frequency, of shingles that are common in the lowest ``tenths`` of the hashes, where prefixes are."""

    below = np.uint64(min(tenths * (1 << 64) // 10, (1 << 64) - 1))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in regrouped(batches, "text", 16 << 20):
            found = []
            for part in slices(piece, "text"):
                w = Words(part.column("text"))
                every = combine(w.hashes, width)
                inside = w.rows[: len(every)] == w.rows[width - 1 :][: len(every)]
                found.append(every[inside & (every < below)])
            token, times = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(token)), pa.array(times.astype(np.int64))], names=["token", "c"])

    counts = docs.select("text").mapInArrow(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
    heavy = scratch.written(counts.where(F.col("c") >= OFTEN), "common")
    if heavy.count() > COMMON:
        heavy = heavy.orderBy(F.desc("c"), "token").limit(COMMON)
    got = heavy.select("token", "c").toArrow()
    token, c = got.column("token").to_numpy().view(np.uint64), got.column("c").to_numpy()
    order = np.argsort(token)
    return token[order], (np.searchsorted(np.unique(c), c) + 1)[order]


def signatures(docs: DataFrame, width: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, n, gid, pg, prefix, sketch words) of (id, text), with h where docs has it: set size, class, group, prefix; gid is null for an empty set."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    carried = [c for c in docs.columns if c == "h"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, bounds = shingle_sets(Words(part.column("text")), width)
                n = np.diff(bounds)
                prefix, pb = _prefixes(values, bounds, shared.value, percent)
                empty = n == 0
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n.astype(np.int64)), pa.array(signed(_set_hash(values, bounds, n)), mask=empty), pa.array(signed(_set_hash(prefix, pb, n)), mask=empty), list_array(signed(prefix), pb, pa.int64()), *[pa.array(signed(x)) for x in _sketches(values, bounds, len(WIDE)).T], *(part.column(c) for c in carried)],
                    names=["id", "n", "gid", "pg", "prefix", *WIDE, *carried],
                )

    return docs.mapInArrow(run, "id long, n long, gid long, pg long, prefix array<long>" + "".join(f", {c} long" for c in [*WIDE, *carried]))


def class_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gid, text) of one document for each class in ``wanted`` (gid, h), h being the hash of one of its texts."""
    return docs.select("h", "text").join(checked_broadcast(wanted), "h").groupBy("gid").agg(F.min("text").alias("text"))


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link; texts is (gid, text).

    b is the pivot: its text goes once to each of its salted tasks, where the
    texts of its partners stream past it.
    """
    load = pairs.groupBy("b").agg((F.count(F.lit(1)) / SALT_ROWS).cast("long").alias("salts"))
    keyed = pairs.join(load, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts") + 1).alias("salt"))
    left = keyed.join(texts, keyed["a"] == texts["gid"]).select("b", "salt", F.lit(1).alias("side"), F.col("a").alias("id"), "text")
    pivots = load.select(F.col("b"), F.explode(F.sequence(F.lit(0), F.col("salts"))).alias("salt"))
    right = pivots.join(texts, pivots["b"] == texts["gid"]).select("b", "salt", F.lit(0).alias("side"), F.col("b").alias("id"), "text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own = None, np.empty(0, np.uint64)
        for batch in batches:
            for part in slices(batch, "text"):
                values, bounds = shingle_sets(Words(part.column("text")), width)
                b, side, ids = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
                hits = []
                for i in range(part.num_rows):
                    mine = values[bounds[i] : bounds[i + 1]]
                    if not side[i]:
                        pivot, own = b[i], mine.copy()
                    elif pivot == b[i] and len(own):
                        at = np.searchsorted(own, mine)
                        both = int(np.count_nonzero(own[np.minimum(at, len(own) - 1)] == mine))
                        if 100 * both >= percent * (len(own) + len(mine) - both):
                            hits.append(i)
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[hits]), pa.array(b[hits])], names=["a", "b"])

    streams = left.union(right).repartition("b", "salt").sortWithinPartitions("b", "salt", "side")
    return streams.mapInArrow(run, "a long, b long")


def _bucket_pairs(buckets: DataFrame, percent: int, sketch: list[str]) -> DataFrame:
    """(x, y) of (members: array of (pg, n, pos, lo, hi, k, prev1..prev4, sketch)): the group pairs of a light shingle, x <= y."""
    words = len(sketch)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, bounds = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            pg, n, pos, low, high, k = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(6))
            prev = np.stack([flat.field(i).fill_null(0).to_numpy(zero_copy_only=False) for i in range(6, 10)], axis=1)
            none = np.stack([flat.field(i).is_null().to_numpy(zero_copy_only=False) for i in range(6, 10)], axis=1)
            bits = np.stack([flat.field(i).to_numpy(zero_copy_only=False) for i in range(10, 10 + words)], axis=1).view(np.uint64)
            # every place with itself and with those after it in its bucket
            more = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(pg))
            for lo in range(0, len(pg), step := max(1, PAIRS // int(max(1, more.max(initial=1))))):
                m = more[lo : lo + step]
                x = np.repeat(np.arange(lo, lo + len(m)), m)
                y = x + np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m)
                open_ = (low[x] != high[x]) | (low[y] != high[y]) | (low[x] != low[y])
                least = -(-percent * (n[x] + n[y]) // (100 + percent))
                ok = open_ & ((x != y) | (k[x] > 1)) & (n[x] - pos[x] >= least) & (n[y] - pos[y] >= least) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
                x, y, least = x[ok], y[ok], least[ok]
                # a group of one class has its class's sketch
                ok = (k[x] > 1) | (k[y] > 1) | (np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= n[x] + n[y] - 2 * least)
                x, y = x[ok], y[ok]
                shared = ((prev[x][:, :, None] == prev[y][:, None, :]) & ~none[x][:, :, None] & ~none[y][:, None, :]).any(axis=(1, 2)) & (x != y)
                x, y = x[~shared], y[~shared]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(pg[x], pg[y])), pa.array(np.maximum(pg[x], pg[y]))], names=["x", "y"])

    return buckets.select("members").mapInArrow(run, "x long, y long")


def _differ(sketch: list[str], x: str, y: str):
    return sum((F.bit_count(F.col(f"{c}{x}").bitwiseXOR(F.col(f"{c}{y}"))) for c in sketch), F.lit(0))


def _folded() -> list:
    """The 256-bit sketch out of the 1,024-bit one: bits that are equal modulo 256 are added modulo 2."""
    return [F.col(f"w{i}").bitwiseXOR(F.col(f"w{i + 4}")).bitwiseXOR(F.col(f"w{i + 8}")).bitwiseXOR(F.col(f"w{i + 12}")).alias(c) for i, c in enumerate(SKETCH)]


def _least(percent: int):
    return F.expr(f"(-1) * floor(-{percent} * (n_x + n_y) / {100 + percent}.0D)")


def _light_pairs(postings: DataFrame, groups: DataFrame, percent: int, sketch: list[str]) -> DataFrame:
    """Group pairs at light shingles of (token, pg, n, pos, prev1..prev4), where components differ."""
    member = F.struct("pg", "n", "pos", "lo", "hi", "k", "prev1", "prev2", "prev3", "prev4", *sketch)
    buckets = postings.join(groups, "pg").groupBy("token").agg(F.collect_list(member).alias("members"), F.min("lo").alias("least"), F.max("hi").alias("most")).where("least <> most")
    return _bucket_pairs(buckets, percent, sketch)


def _heavy_pairs(postings: DataFrame, groups: DataFrame, percent: int, sketch: list[str], scratch: Scratch) -> DataFrame:
    """Group pairs at heavy shingles of (token, pg, n, pos, before): groups outside the main component against all.

    A pair is made at its first heavy shingle: ``before`` has the heavy ones that precede in the prefix.
    """
    columns = ["pg", "n", "pos", "before", "lo", "hi", "k", *sketch]
    labelled = scratch.written(postings.join(groups, "pg").select("token", *columns), "heavy")
    sizes = labelled.where("lo = hi").groupBy("token", "lo").agg(F.sum("k").alias("c"))
    main = scratch.written(sizes.groupBy("token").agg(F.max_by("lo", "c").alias("main")), "main")
    every = labelled.join(main, "token", "left").withColumn("inside", (F.col("lo") == F.col("hi")) & (F.col("lo") == F.coalesce("main", F.lit(0))))
    x = every.where("not inside").select("token", *[F.col(c).alias(f"{c}_x") for c in columns])
    y = every.select("token", F.col("inside").alias("inside_y"), *[F.col(c).alias(f"{c}_y") for c in columns])
    open_ = (F.col("lo_x") != F.col("hi_x")) | (F.col("lo_y") != F.col("hi_y")) | (F.col("lo_x") != F.col("lo_y"))
    once = F.col("inside_y") | (F.col("pg_x") < F.col("pg_y")) | ((F.col("pg_x") == F.col("pg_y")) & (F.col("k_x") > 1))
    least = _least(percent)
    fits = (F.col("n_x") - F.col("pos_x") >= least) & (F.col("n_y") - F.col("pos_y") >= least) & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
    near = (F.col("k_x") > 1) | (F.col("k_y") > 1) | (_differ(sketch, "_x", "_y") <= F.col("n_x") + F.col("n_y") - 2 * least)
    first = (F.col("pg_x") == F.col("pg_y")) | ~F.arrays_overlap("before_x", "before_y")
    return x.join(y, "token").where(open_ & once & fits & near & first).select(F.least("pg_x", "pg_y").alias("x"), F.greatest("pg_x", "pg_y").alias("y"))


def _expanded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): the class pairs of group pairs (x, y) whose components differ and whose sketches allow a link."""
    x = classes.select(F.col("pg").alias("x"), *[F.col(c).alias(f"{c}_x") for c in ("gid", "n", "root", *WIDE)])
    y = classes.select(F.col("pg").alias("y"), *[F.col(c).alias(f"{c}_y") for c in ("gid", "n", "root", *WIDE)])
    apart = (F.col("root_x") != F.col("root_y")) & ((F.col("x") != F.col("y")) | (F.col("gid_x") < F.col("gid_y")))
    near = _differ(WIDE, "_x", "_y") <= F.col("n_x") + F.col("n_y") - 2 * _least(percent)
    return pairs.distinct().join(x, "x").join(y, "y").where(apart & near).select(F.least("gid_x", "gid_y").alias("a"), F.greatest("gid_x", "gid_y").alias("b")).distinct()


def _group_state(classes: DataFrame, sketch: list[str]) -> DataFrame:
    """(pg, lo, hi, k, sketch) of the classes (gid, pg, root, sketch)."""
    found = classes.groupBy("pg").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("k"), *[F.first(c).alias(c) for c in WIDE])
    return found if sketch == WIDE else found.select("pg", "lo", "hi", "k", *_folded())


def _rare_first(texts: DataFrame, width: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(postings, classes) of (gid, text), prefixes having rare shingles first: (token, df, pg, n, pos, prev1..4, before), (gid, n, pg, sketch)."""
    found = signatures(texts.select(F.col("gid").alias("id"), "text"), width, percent, common_shingles(texts, width, 10, scratch))
    classes = scratch.written(found.drop("gid").withColumnRenamed("id", "gid"), "heavy-classes")
    groups = classes.groupBy("pg", "n").agg(F.first("prefix").alias("prefix"), F.count(F.lit(1)).alias("k"))
    back = lambda k: F.when(F.col("pos") >= k, F.get("prefix", F.col("pos") - k)).alias(f"prev{k}")
    rows = scratch.written(groups.select("pg", "n", "k", F.posexplode("prefix").alias("pos", "token"), "prefix").select("token", "pg", "n", "k", F.col("pos").cast("long").alias("pos"), *[back(k) for k in (1, 2, 3, 4)]), "heavy-prefixes")
    counts = scratch.written(rows.groupBy("token").agg(F.sum("k").alias("df")).where("df > 1"), "heavy-counts")
    shared = rows.drop("k").join(counts, "token")
    ahead = Window.partitionBy("pg").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return shared.withColumn("before", F.collect_list(F.when(F.col("df") >= HEAVY, F.col("token"))).over(ahead)), classes.drop("prefix")


def _star_pairs(shared: DataFrame, classes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): each class and the first class of its groups' pivots, and of its own group, as size, position and sketch allow."""
    weight = scratch.written(shared.groupBy("pg").agg((F.sum(F.log2("df")) / F.first("n")).alias("weight")), "weights")
    pivots = shared.join(checked_broadcast(weight), "pg").groupBy("token").agg(F.max(F.struct("weight", "pg", "n", "pos")).alias("p"))
    met = shared.join(pivots, "token").where(F.col("pg") != F.col("p.pg"))
    met = met.groupBy(F.col("pg").alias("x"), F.col("n").alias("n_x"), F.col("p.pg").alias("y"), F.col("p.n").alias("n_y")).agg(F.min("pos").alias("pos_x"), F.min("p.pos").alias("pos_y"))
    fits = (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")) & (F.col("n_x") - F.col("pos_x") >= _least(percent)) & (F.col("n_y") - F.col("pos_y") >= _least(percent))
    met = met.where(fits).select("x", "y")
    multi = classes.groupBy("pg").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("pg").alias("x"), F.col("pg").alias("y"))
    columns = ["gid", "n", *WIDE]
    x = classes.select(F.col("pg").alias("x"), *[F.col(c).alias(f"{c}_x") for c in columns])
    # written, so that a pivot which many groups meet is a skewed join that Spark can split
    lead = scratch.written(classes.groupBy(F.col("pg").alias("y")).agg(F.min(F.struct(*columns)).alias("l")).select("y", *[F.col(f"l.{c}").alias(f"{c}_y") for c in columns]), "leads")
    met = scratch.written(met.union(multi).join(x, "x"), "met")
    near = _differ(WIDE, "_x", "_y") <= F.col("n_x") + F.col("n_y") - 2 * _least(percent)
    return met.join(lead, "y").where((F.col("gid_x") != F.col("gid_y")) & near).select(F.col("gid_x").alias("a"), F.col("gid_y").alias("b")).distinct()


def links(docs: DataFrame, width: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(classes, roots): (id, n, gid, h) of every document of (id, text, h), h being the text's hash, and (node, root) of the linked classes."""
    known = scratch.written(signatures(docs, width, percent, common_shingles(docs, width, 3, scratch)), "signatures")
    full = known.where("gid is not null")
    classes = scratch.written(full.groupBy("gid", "n", "pg").agg(F.min("h").alias("h"), *[F.first(c).alias(c) for c in WIDE]), "classes")
    several = scratch.written(full.groupBy("pg").agg(F.count(F.lit(1)).alias("c"), F.countDistinct("gid").alias("k"), F.min("id").alias("lead")).where("c > 1").select("pg", "lead", "k"), "several")

    leaders = full.join(checked_broadcast(several), "pg", "left").where(F.col("lead").isNull() | F.col("id").eqNullSafe(F.col("lead")))
    postings = leaders.select("pg", "n", F.coalesce("k", F.lit(1)).alias("k"), F.posexplode("prefix").alias("pos", "token"))
    counts = scratch.written(postings.groupBy("token").agg(F.sum("k").alias("df")).where("df > 1"), "counts")
    shared = scratch.written(postings.join(counts, "token").select("token", "df", "pg", "n", F.col("pos").cast("long").alias("pos")), "shared")
    hashes = classes.select("gid", "h")
    texts_of = lambda nodes, name: scratch.written(class_texts(docs, hashes.join(checked_broadcast(nodes), "gid", "left_semi")), name, compression="zstd")
    ends = lambda p: p.select(F.explode(F.array("a", "b")).alias("gid")).distinct()

    pairs = scratch.written(_star_pairs(shared, classes, percent, scratch), "star-pairs")
    found = scratch.written(verified(pairs, texts_of(ends(pairs), "star-texts"), width, percent), "star-links")
    roots = scratch.written(components(found, scratch=scratch), "star-roots")
    state = scratch.written(classes.join(roots, F.col("gid") == F.col("node"), "left").select("gid", "pg", "n", F.coalesce("root", "gid").alias("root"), *WIDE), "state")

    by_group = Window.partitionBy("pg").orderBy("pos")
    previous = [F.lag("token", k).over(by_group).alias(f"prev{k}") for k in (1, 2, 3, 4)]
    light = shared.select("token", "df", "pg", "n", "pos", *previous).where(F.col("df") < HEAVY)
    groups = scratch.written(_light_pairs(light, _group_state(state, SKETCH), percent, SKETCH), "light-pairs")
    more = [_expanded(groups, state, percent)]

    heavy = state.join(checked_broadcast(shared.where(F.col("df") >= HEAVY).select("pg").distinct()), "pg", "left_semi").select("gid")
    again, wide = _rare_first(texts_of(heavy, "heavy-texts"), width, percent, scratch)
    again = scratch.written(again, "rare-first")
    wide = scratch.written(wide.join(state.select("gid", "root"), "gid"), "heavy-state")
    groups = _light_pairs(again.where(F.col("df") < HEAVY), _group_state(wide, WIDE), percent, WIDE).union(_heavy_pairs(again.where(F.col("df") >= HEAVY), _group_state(wide, WIDE), percent, WIDE, scratch))
    more.append(_expanded(scratch.written(groups, "heavy-pairs"), wide, percent))
    flipped = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = scratch.written(more[0].union(more[1]).distinct().join(flipped, ["a", "b"], "left_anti"), "more-pairs")
    second = scratch.written(verified(rest, texts_of(ends(rest), "more-texts"), width, percent), "more-links")
    if second.limit(1).count():
        roots = scratch.written(components(found.union(second), scratch=scratch), "roots")
    return known.select("id", "n", "gid", "h"), roots


def jaccard_components(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) of every row: linked when 100|x & y| >= percent |x | y|."""
    need(df, id, text)
    body = F.col(f"`{text}`").cast("string")
    docs = df.select(F.col(f"`{id}`").cast("long").alias("id"), body.alias("text"), F.xxhash64(body).alias("h"))
    scratch = Scratch(df.sparkSession, "jaccard")
    classes, roots = links(docs, width, percent, scratch)
    rooted = scratch.written(classes.join(roots, classes["gid"] == roots["node"], "left").select("id", "n", F.coalesce("root", "gid").alias("root")), "rooted")
    label = scratch.written(rooted.where("root is not null").groupBy("root").agg(F.min("id").alias("label"), F.count(F.lit(1)).alias("c")).where("c > 1").select("root", "label"), "labels")
    joined = rooted.join(label, "root", "left").select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("label", "id").alias("component_id"))
    return scratch.done(joined)


def one_of_each(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """df with one row of each group of linked rows: the smallest id (null last), then the smallest text hash.

    A row is known by its id and the 64-bit hash of its text, so null or reused ids
    remove nothing else; rows without words are in no group.
    """
    need(df, id, text)
    body, key = F.col(f"`{text}`").cast("string"), F.col(f"`{id}`").cast("long")
    scratch = Scratch(df.sparkSession, "jaccard")
    classes, roots = links(df.select(key.alias("id"), body.alias("text"), F.xxhash64(body).alias("h")), width, percent, scratch)
    rooted = classes.where("gid is not null").join(roots, classes["gid"] == roots["node"], "left").select("id", "h", F.coalesce("root", "gid").alias("root"))
    rooted = scratch.written(rooted.groupBy("root", "id", "h").agg(F.count(F.lit(1)).alias("c")), "row-keys")
    kept = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "h")).alias("kept"), F.sum("c").alias("rows")).where("rows > 1")
    stays = F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("h") == F.col("kept.h"))
    judged = written(rooted.join(scratch.written(kept, "kept"), "root").select(F.col("id").alias("__id"), F.col("h").alias("__h"), "c", stays.alias("stays")).where("not stays or c > 1"), "copies")
    remove(df.sparkSession, scratch.root)
    gone, repeated = (judged.where(w).select("__id", "__h") for w in ("not stays", "stays"))
    same = key.eqNullSafe(F.col("__id")) & (F.xxhash64(body) == F.col("__h"))
    left = df.join(checked_broadcast(gone), same, "left_anti")
    if not repeated.limit(1).count():
        return left
    again = checked_broadcast(repeated)
    once = left.join(again, same, "left_semi").withColumns({"__id": key, "__h": F.xxhash64(body)})
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    once = once.groupBy("__id", "__h").agg(F.min(row).alias("r")).select(*[F.col("r")[c].alias(c) for c in df.columns])
    return left.join(again, same, "left_anti").union(once)
