"""Scoring with a weighted backoff automaton of all n-grams (operator 9).

The model keeps every word and every n-gram up to ``ORDER`` of the training texts,
those that occur once too, so it grows with the corpus.  Its states are the
contexts h that occur; from h an arc leads over each word w that follows, and a
failure arc of weight K / (c(h) + K) to the state of h without its first word.
The probabilities are smoothed with a Dirichlet prior of strength K,

    p(w | h) = (c(hw) + K p(w | h')) / (c(h) + K),      p(w) = (c(w) + 1) / (N + V + 1),

so each state's arcs and what passes its failure arc sum to one; the lowest
order's spare unit is the unknown word's.  An arc's weight is log10 of its
probability; it leads to the state of the longest context that its words end in.  A text is read in one
traversal from left to right that carries the state: where it has no arc for a word,
the failure arc's weight is added and its state tried, then the arc's weight is added and followed.

A chunk of texts meets a small part of the automaton only: the states and arcs
of its own n-grams.  What that part needs are counts in the whole corpus.  The texts are written once in chunks of about ``CHUNK`` bytes.  A chunk sends
its distinct n-grams, each with its occurrences in training texts, to the
parts of the key space; a part adds them up and answers each chunk with the
totals of the keys that it asked about, in the same order.  The chunk's texts and
the answers meet again (a cogroup by chunk), the chunk's part of the automaton is built and its texts
are read, many at a time; as a state is ``ORDER`` - 1 words at most, a long text is read in pieces of
``PIECE`` words, each from the state that the words before it lead to.  A key comes
at most once from each chunk, so frequent words make no hot part; the parts grow in
number with the bytes of text, and a task holds one part or one chunk.

Defined results: a null or empty text is one end token; a null id counts as the
empty string for the split; repeated rows are scored each, and tied scores stay
tied; with no training text every word is unknown; an empty table gives an empty
result; other columns are not carried.  N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import Scratch
from .rows import need
from .textkit import Words, list_array, mix64, regrouped, signed, tidy

ORDER = 3
#: Strength K of the prior, in occurrences: the best of 1, 2, 4 ... 64 on a fold of sf0.1's training texts (see the README).
PRIOR = 64.0
#: Text bytes of a chunk.
CHUNK = 8 << 20
#: Words of a text that are read in one piece.
PIECE = 256
#: Text bytes of the corpus for each part of the key space.
PART = 8 << 20


def held_out(id: Column) -> Column:
    """The test split: crc32 of the id as text leaves 2 modulo 7."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit(""))) % 7 == 2


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Key of the n-gram whose first n-1 words have the key a and last n-1 words b."""
    with np.errstate(over="ignore"):
        return mix64(mix64(a * np.uint64(0x9FB21C651E98DF25) + np.uint64(1)) + b)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every token of the texts, each followed by its end, whose key is 0."""
    w = Words(column)
    n = w.counts + 1
    key = np.zeros(int(n.sum()), dtype=np.uint64)
    inner = np.ones(len(key), dtype=bool)
    inner[np.cumsum(n) - 1] = False
    key[inner] = w.hashes
    return np.repeat(np.arange(len(n)), n), key


def grams(column: pa.Array, most: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(row of every token, for each n the places of the n-grams' last tokens and their keys)."""
    row, key = tokens(column)
    found = [(np.arange(len(row)), key)]
    for n in range(2, most + 1):
        key = pair_key(key[:-1], key[1:])
        last = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1]) + n - 1
        found.append((last, key[last - n + 1]))
    return row, found


def chunked(docs: DataFrame) -> DataFrame:
    """(chunk, bytes, id, held_out, text) of (id, held_out, text): a row a chunk, holding its documents as arrays."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for part in regrouped(batches, "text", CHUNK):
            size = int(pc.sum(pc.binary_length(part.column("text"))).as_py() or 0)
            bounds = np.array([0, part.num_rows])
            lists = [pa.ListArray.from_arrays(pa.array(bounds, type=pa.int32()), part.column(c)) for c in ("id", "held_out", "text")]
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([size]), *lists], names=["chunk", "bytes", "id", "held_out", "text"])
            chunk += 1

    return docs.mapInArrow(run, "chunk long, bytes long, id array<long>, held_out array<boolean>, text array<string>")


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of the key space, which grows with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def asked(chunks: DataFrame, orders: range, parts: int) -> DataFrame:
    """(part, n, chunk, keys, counts, more): a chunk's distinct n-grams in each part, sorted, and their training occurrences.

    A count takes a byte; where that is 127, the whole one follows in ``more``.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                texts, test = batch.column("text")[i].values, batch.column("held_out")[i].values.to_numpy(zero_copy_only=False)
                row, found = grams(texts, orders[-1])
                for n in orders:
                    last, key = found[n - 1]
                    every = np.unique(key)
                    own, times = np.unique(key[~test[row[last]]], return_counts=True)
                    counts = np.zeros(len(every), dtype=np.int64)
                    counts[np.searchsorted(every, own)] = times
                    bounds = np.searchsorted(part_of(every, parts), np.arange(parts + 1, dtype=np.uint64))
                    some = np.flatnonzero(np.diff(bounds))
                    cut = np.append(bounds[some], len(every))
                    large = np.flatnonzero(counts >= 127)
                    far = np.searchsorted(large, cut)
                    fixed = [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), n, dtype=np.int32)), pa.array(np.full(len(some), batch.column("chunk")[i].as_py()))]
                    yield pa.RecordBatch.from_arrays([*fixed, list_array(signed(every), cut, pa.int64()), list_array(np.minimum(counts, 127).astype(np.int8), cut, pa.int8()), list_array(counts[large], far, pa.int64())], names=["part", "n", "chunk", "keys", "counts", "more"])

    return chunks.select("chunk", "held_out", "text").mapInArrow(run, "part int, n int, chunk long, keys array<long>, counts array<byte>, more array<long>")


def answered(requests: DataFrame, parts: int) -> DataFrame:
    """(chunk, n, part, counts, total, types): each request's keys' totals over all chunks; total and types of a part stand in one row of it."""

    def answers(part: int, n: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        got = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        lists = got.column("keys")
        bounds = lists.offsets.to_numpy()
        keys = lists.values.to_numpy()[bounds[0] : bounds[-1]]
        own = got.column("counts").flatten().to_numpy().astype(np.int64)
        own[own == 127] = got.column("more").flatten().to_numpy()
        distinct, at = np.unique(keys, return_inverse=True)
        sums = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(sums, at, own)
        first = np.arange(got.num_rows) == 0
        total, types = np.where(first, sums.sum(), 0), np.where(first, np.count_nonzero(sums), 0)
        same = [pa.array(np.full(got.num_rows, x, dtype=np.int32)) for x in (n, part)]
        return pa.RecordBatch.from_arrays([got.column("chunk"), *same, list_array(sums[at], bounds - bounds[0], pa.int64()), pa.array(total), pa.array(types)], names=["chunk", "n", "part", "counts", "total", "types"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            part, n = batch.column("part").to_numpy(), batch.column("n").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (n[1:] != n[:-1])]) if len(part) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(part)]):
                if held and now != (part[lo], n[lo]):
                    yield answers(*now, held)
                    held = []
                now = (part[lo], n[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield answers(*now, held)

    dealt = requests.repartition(parts, "part").sortWithinPartitions("part", "n")
    return dealt.mapInArrow(run, "chunk long, n int, part int, counts array<long>, total long, types long")


@dataclass
class Automaton:
    """The states and arcs that the texts of a chunk can meet; index n of a list is for n-grams, by their number among the chunk's distinct ones.

    An n-gram that occurs in training is an arc from the state of its first n-1 words,
    of weight ``arc[n]``, and, below the highest order, a state, whose failure arc has the weight
    ``failure[n]``.  Of single words, unknown ones too are arcs of the root (state 0 of order 0).
    """

    exists: list[np.ndarray]
    arc: list[np.ndarray]
    failure: list[np.ndarray]

    def step(self, order: np.ndarray, state: np.ndarray, ends: list[np.ndarray], before: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(weight, order, state) after a word, for many readers at once.

        ``ends[n]`` and ``before[n]`` are the numbers of the n-grams that end with the word and with the one before it.
        """
        weight, n = np.zeros(len(order)), order + 1
        for k in range(len(self.exists) - 1, 1, -1):
            at = np.flatnonzero(n == k)
            fails = at[~self.exists[k][ends[k][at]]]
            weight[fails] += self.failure[k - 1][state[fails]]
            n[fails] = k - 1
            # the failure arc leads to the state without its first word
            state[fails] = before[k - 2][fails] if k > 2 else 0
        order, state = n, np.zeros_like(state)
        for k in range(1, len(self.exists)):
            at = np.flatnonzero(n == k)
            weight[at] += self.arc[k][ends[k][at]]
        top = len(self.exists) - 1
        order = np.where(n == top, top - 1, n)
        for k in range(1, top):
            at = np.flatnonzero(order == k)
            state[at] = ends[k][at]
        # an unknown word leads to the root
        lost = order == 1
        lost[lost] = ~self.exists[1][state[lost]] if top > 1 else False
        return weight, np.where(lost, 0, order), np.where(lost, 0, state)


def built(places: list[np.ndarray], counts: list[np.ndarray], total: int, types: int, prior: float) -> Automaton:
    """The automaton of a chunk: ``places[n]`` has the number of the n-gram that ends at each token (-1: none), ``counts[n - 1]`` the training occurrences by number."""
    exists, arc, failure = [np.array([True])], [np.zeros(1)], [np.zeros(1)]
    p = None
    for n, c in enumerate(counts, 1):
        if n == 1:
            p = (c + 1.0) / (total + types + 1.0)
        else:
            # any place of an n-gram tells its last n-1 words and its first ones
            at = np.zeros(len(c), dtype=np.int64)
            full = np.flatnonzero(places[n] >= 0)
            at[places[n][full]] = full
            p = (c + prior * p[places[n - 1][at]]) / (counts[n - 2][places[n - 1][at - 1]] + prior) if len(c) else np.zeros(0)
        exists.append(c > 0)
        arc.append(np.log10(p))
        failure.append(np.log10(prior / (c + prior)))
    return Automaton(exists, arc, failure)


def numbered(texts: pa.Array, counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row of every token, for each n the number of the n-gram that ends there among the sorted distinct ones, -1 for none)."""
    row, found = grams(texts, len(counts))
    places = [np.zeros(len(row), dtype=np.int64)]
    for (last, key), own in zip(found, counts):
        distinct, at = np.unique(key, return_inverse=True)
        if len(distinct) != len(own):
            raise ValueError(f"{len(own)} totals came back for {len(distinct)} n-grams")
        number = np.full(len(row), -1, dtype=np.int64)
        number[last] = at
        places.append(number)
    return row, places


def traversed(a: Automaton, row: np.ndarray, places: list[np.ndarray], rows: int) -> np.ndarray:
    """The weights of the words of every row, added up along its way through the automaton."""
    n = np.bincount(row, minlength=rows)
    text = np.cumsum(n) - n
    pieces = -(-n // PIECE)
    of = np.repeat(np.arange(rows), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = text[of] + nth * PIECE
    end = np.minimum(begin + PIECE, text[of] + n[of])
    # the longest pieces first, so that those still read are a prefix
    warm = np.where(nth > 0, len(a.exists) - 2, 0)
    turn = np.argsort(-(end - begin + warm), kind="stable")
    of, begin, end, warm = of[turn], begin[turn], end[turn], warm[turn]
    at, score = begin - warm, np.zeros(len(of))
    order, state = np.zeros(len(of), dtype=np.int64), np.zeros(len(of), dtype=np.int64)
    left = len(of)
    for k in range(int((end - at).max(initial=0))):
        left = int(np.searchsorted(-(end[:left] - (begin - warm)[:left]), -k, side="left"))
        now = at[:left]
        weight, order[:left], state[:left] = a.step(order[:left], state[:left], [p[now] for p in places], [p[now - 1] for p in places])
        score[:left] += np.where(now >= begin[:left], weight, 0.0)
        at[:left] += 1
    return np.bincount(of, score, rows)


def score_chunk(texts: pa.Array, counts: list[np.ndarray], total: int, types: int, prior: float) -> tuple[np.ndarray, ...]:
    """(tokens, known tokens, base, score) of each text, given the totals of the chunk's sorted distinct n-grams of each order."""
    rows = len(texts)
    row, places = numbered(texts, counts)
    c = counts[0][places[1]] if len(row) else np.zeros(0)
    base = np.bincount(row, np.log10((c + 1.0) / (total + types + 1.0)), rows)
    score = traversed(built(places, counts, total, types, prior), row, places, rows)
    return np.bincount(row, minlength=rows), np.bincount(row, c > 0, rows).astype(np.int64), base, score


def lm_scores(df: DataFrame, id: str = "doc_id", text: str = "text", test: Column | None = None, prior: float = PRIOR) -> DataFrame:
    """Scores of every row of df under a model of the rows where ``test`` is false."""
    need(df, id, text)
    split = held_out(F.col(f"`{id}`")) if test is None else F.coalesce(test, F.lit(False))
    docs = df.select(F.col(f"`{id}`").cast("long").alias("id"), split.alias("held_out"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    scratch = Scratch(df.sparkSession, "lm")
    chunks = scratch.written(chunked(docs), "chunks", compression="zstd")
    parts = 1 + int(chunks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]) // PART
    totals = [scratch.written(answered(asked(chunks, orders, parts), parts), f"totals-{orders[0]}") for orders in (range(1, ORDER), range(ORDER, ORDER + 1))]
    counted = totals[0].where("n = 1").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("types"), F.lit(0)).alias("types")).first()
    total, types = counted["total"], counted["types"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks().sort_by([("n", "ascending"), ("part", "ascending")])
        n = right.column("n").to_numpy()
        counts = [right.filter(pa.array(n == k)).column("counts").combine_chunks().flatten().to_numpy() for k in range(1, ORDER + 1)]
        texts = left.column("text")[0].values
        count, known, base, score = score_chunk(texts, counts, total, types, prior)
        return pa.table([left.column("id")[0].values, left.column("held_out")[0].values, pa.array(count), pa.array(known), pa.array(np.full(len(texts), total, dtype=np.int64)), pa.array(base), pa.array(score)], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    answers = totals[0].union(totals[1]).select("chunk", "n", "part", "counts")
    scored = chunks.select("chunk", "id", "held_out", "text").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scratch.done(scored.withColumnRenamed("id", id))
