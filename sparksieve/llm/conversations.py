"""Conversation structure repair by rank-convergence parallel Viterbi (operator 13).

A conversation's turns are read as an automaton's input: its states are
"nothing yet", "after system", "after user", "after assistant", and a
repaired conversation's role initials read (s?(ua)+)?.  Keeping a turn costs 0,
giving it the role user or assistant 3, deleting it 4, inserting an empty one 3,
and a truncated turn that stays 3 more; blank turns and later copies must go.
The cheapest repair is a shortest path, found from the end backwards: the
costs of finishing from each state, a vector of four numbers a turn, each the
min-plus product of the turn's matrix with the next one's vector.

Long conversations aren't walked in one piece.  The turns lie sorted in ranges;
``CHUNK`` consecutive rows of a range and conversation are a chunk, a row of
symbols.  All chunks start at once, each from a guessed vector at its end.  In a
fix-up pass a chunk gets the vector that its right neighbour came out with, less
its least entry; where that differs from the one it has used, it runs again,
until its vectors differ from the former ones by a constant only (the
product has come down to rank one), from where on nothing else changes.
Passes end when no chunk's outcome has changed but for a constant; what the
constants add up to is a sum over the chunks.  Turns that never bring two paths
together (a run of turns that must all go, or all get a new role) would need a pass
a chunk: after ``FIXUPS`` passes the rest is settled by doubling, that is by
min-plus products of the chunks' own matrices over 1, 2, 4, ... neighbours.

The stitched vectors then drive the trace, front to back: at each turn the
least letter (D, I, K, R) that stays on a cheapest path, which gives the
ASCII-least audit.  A chunk is traced from all four states; the state that it is
really entered in is found by composing these maps, again by doubling, which ends
at once where a chunk leaves in one state whatever it was entered in.

Defined results: null roles and texts are one space, null conversation ids are
one conversation, null turns come first; rows of the same turn are ordered by
the first 64 characters of the role and of the text and then by a hash of both
(equal rows are interchangeable); the role's initial decides, so that "User" or
"tool" is no role of the automaton; repeated rows are later copies; an empty table
gives an empty result; long texts move whole and only twice; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import Scratch, checked_broadcast
from .rows import need
from .textkit import tidy

#: Rows of a chunk, a power of two.
CHUNK = 128
#: Passes before the chunks that still change are settled by doubling.
FIXUPS = 4
#: States: nothing yet, after system, after user, after assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted turn or one with a new role, by the state before.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: Costs of finishing from each state when no turn is left.
END = np.array([0, 6, 3, 0])
CHANGE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAR = 1 << 40
#: Symbols are letters from "a": four initials (s, u, a, other) by four kinds.
INITIALS = "sua"
OK, CUT, BLANK, COPY = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}


def initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def codes_of(symbols: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(initials, kinds) of every chunk, a row each, padded with kind -1."""
    width = max(map(len, symbols), default=0)
    raw = np.frombuffer("".join(s.ljust(width, "`") for s in symbols).encode(), np.uint8).reshape(len(symbols), width).astype(np.int64) - ord("a")
    return np.where(raw < 0, 3, raw // 4), np.where(raw < 0, -1, raw % 4)


def kept_state(initials: np.ndarray, states: np.ndarray) -> np.ndarray:
    """The state after keeping a turn of the initial, -1 where the automaton has no such step."""
    s = np.where((initials == 0) & (states == NONE), SYSTEM, -1)
    s = np.where((initials == 1) & (states != USER), USER, s)
    return np.where((initials == 2) & (states == USER), ASSISTANT, s)


def step(initials: np.ndarray, kinds: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs of finishing before a turn of each chunk (rows) and state (columns), from those after it; insertions before the turn included."""
    states = np.broadcast_to(np.arange(4), after.shape)
    must, extra = (kinds >= BLANK)[:, None], np.where(kinds == CUT, TRUNCATED, 0)[:, None]
    to = kept_state(initials[:, None], states)
    keep = np.where((to < 0) | must, FAR, np.take_along_axis(after, np.maximum(to, 0), 1) + extra)
    change = np.where(must, FAR, after[:, NEXT] + CHANGE + extra)
    cost = np.minimum(np.minimum(after + DELETE, keep), change)
    once = cost[:, NEXT] + INSERT
    cost = np.minimum(np.minimum(cost, once), once[:, NEXT] + INSERT)
    return np.where((kinds < 0)[:, None], after, cost)


def backward(codes: tuple[np.ndarray, np.ndarray], ends: np.ndarray) -> np.ndarray:
    """Costs of finishing at every place of every chunk (place, chunk, state), from the vectors at the chunks' ends."""
    initials, kinds = codes
    n, width = kinds.shape
    out = np.empty((width + 1, n, 4), dtype=np.int64)
    out[width] = ends
    for i in range(width - 1, -1, -1):
        out[i] = step(initials[:, i], kinds[:, i], out[i + 1])
    return out


def level(v: np.ndarray) -> np.ndarray:
    """v less its least entry."""
    return v - v.min(axis=-1, keepdims=True)


def rerun(codes: tuple[np.ndarray, np.ndarray], old: np.ndarray, new: np.ndarray, outcome: np.ndarray) -> np.ndarray:
    """The chunks' outcomes for new end vectors: both runs side by side until they differ by constants, which then holds to the start."""
    initials, kinds = codes
    a, b = old, new
    for i in range(kinds.shape[1] - 1, -1, -1):
        if (level(a) == level(b)).all():
            return outcome + (b - a)[:, :1]
        a, b = step(initials[:, i], kinds[:, i], a), step(initials[:, i], kinds[:, i], b)
    return b


def traced(codes: tuple[np.ndarray, np.ndarray], costs: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(insertions before each turn, what is done to it: 0 delete, 1 keep, 2 change, -1 no turn; state at the chunk's end), by the least letters of cheapest paths."""
    initials, kinds = codes
    n, width = kinds.shape
    state, rows = entry.copy(), np.arange(n)
    inserted, done = np.zeros((n, width), dtype=np.int64), np.full((n, width), -1)
    for i in range(width):
        live, now, after = kinds[:, i] >= 0, costs[i], costs[i + 1]
        for _ in range(2):
            deletes = after[rows, state] + DELETE == now[rows, state]
            goes = live & ~deletes & (now[rows, NEXT[state]] + INSERT == now[rows, state])
            inserted[:, i] += goes
            state = np.where(goes, NEXT[state], state)
        deletes = after[rows, state] + DELETE == now[rows, state]
        to = kept_state(initials[:, i], state)
        extra = np.where(kinds[:, i] == CUT, TRUNCATED, 0)
        keeps = ~deletes & (kinds[:, i] < BLANK) & (to >= 0) & (after[rows, np.maximum(to, 0)] + extra == now[rows, state])
        done[:, i] = np.where(live, np.where(deletes, 0, np.where(keeps, 1, 2)), -1)
        state = np.where(live & ~deletes, np.where(keeps, to, NEXT[state]), state)
    return inserted, done, state


def audits(inserted: np.ndarray, done: np.ndarray, state: np.ndarray, last: np.ndarray) -> list[str]:
    """The letters of every chunk; the last one of a conversation ends with what is left to insert."""
    words = np.array([a * "I" + b for b in ("", "D", "K", "R") for a in range(3)], dtype=object)
    body = words[(done + 1) * 3 + inserted]
    return ["".join(row) + "I" * (int(END[s]) // INSERT if end else 0) for row, s, end in zip(body, state, last)]


def ints(values: np.ndarray) -> pa.Array:
    """A list column of the rows of a matrix."""
    flat = pa.array(np.ascontiguousarray(values, dtype=np.int64).reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), flat)


def rows_of(column: pa.Array, default: np.ndarray | None = None) -> np.ndarray:
    """A list column of four numbers a row (or n of them) as a matrix; null is the default."""
    if column.null_count:
        column = pa.array([default.tolist() if x is None else x for x in column.to_pylist()], column.type)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def mapped(df: DataFrame, f, schema: str) -> DataFrame:
    """df's columns replaced by those that f makes of each Arrow batch: f gives arrays, by name."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = f(batch)
                yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


@dataclass
class Repair:
    """The sorted turns (k, gid, turn, role, text) and what is done to each chunk of them (k, g, entry, last, audit, cost, counts); k holds the conversation's id."""

    scratch: Scratch
    turns: DataFrame
    chunks: DataFrame
    bits: int

    def edited(self) -> DataFrame:
        """(k, gid, seq, edit, role, text): every turn and insertion in order, deleted turns without role and text."""
        ops = self.chunks.select("k", F.col("g").alias("g"), F.shiftleft("g", self.bits).alias("gid"), F.lit(0).alias("tag"), "audit", "entry", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
        rows = self.turns.select("k", F.shiftright("gid", self.bits).alias("g"), "gid", F.lit(1).alias("tag"), F.lit(None).cast("string").alias("audit"), F.lit(None).cast("int").alias("entry"), "role", "text")
        # a chunk's rows meet in one task, after its letters
        dealt = ops.unionByName(rows).repartition("k", "g").sortWithinPartitions("k", "gid", "tag").select("k", "gid", "tag", "audit", "entry", "role", "text")
        kind = self.turns.schema["k"].dataType.simpleString()

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, audit, at, state, gid = None, "", 0, NONE, 0
            names = ["gid", "seq", "edit", "role", "text"]
            for batch in batches:
                out, of = [], []

                def insert(seq: int) -> None:
                    nonlocal state, at
                    state = int(NEXT[state])
                    out.append((gid, seq, "I", ROLES[state], ""))
                    keys.append(key)
                    at += 1

                keys: list = []
                for key_now, g, tag, letters, entry, role, text in zip(column(batch, "k"), *(column(batch, c).to_pylist() for c in ("gid", "tag", "audit", "entry", "role", "text"))):
                    if tag == 0:
                        while at < len(audit):
                            insert(10 + at)
                        key, audit, at, state = key_now.as_py(), letters, 0, entry
                        continue
                    gid, seq = g, 0
                    while audit[at] == "I":
                        insert(seq)
                        seq += 1
                    edit = audit[at]
                    at += 1
                    if edit == "D":
                        role = text = None
                    elif edit == "R":
                        state = int(NEXT[state])
                        role = ROLES[state]
                    else:
                        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
                    out.append((gid, seq, edit, role, text))
                    keys.append(key)
                of = list(zip(*out)) if out else [[]] * 5
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("k").type), *[pa.array(v, t) for v, t in zip(of, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()))]], names=["k", *names])
            rest: list = []
            while at < len(audit):
                state = int(NEXT[state])
                rest.append((gid, 10 + at, "I", ROLES[state], ""))
                at += 1
            if rest:
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(rest), batch.schema.field("k").type), *[pa.array(v, t) for v, t in zip(zip(*rest), (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()))]], names=["k", *names])

        return dealt.mapInArrow(run, f"k {kind}, gid long, seq int, edit string, role string, text string")

    def digests(self) -> DataFrame:
        """(k, audit, repaired_sha256): the letters of a conversation and the digest of its repaired turns.

        A digest goes through its bytes one after the other, so a
        conversation's turns stream through one task, which holds a hash state and the
        letters, never the turns.
        """
        piece = F.when(F.col("edit") != "D", F.concat("role", F.lit(":"), "text"))
        dealt = self.edited().select("k", "gid", "seq", "edit", piece.alias("piece")).repartition("k").sortWithinPartitions("k", "gid", "seq").select("k", "edit", "piece")
        kind = self.turns.schema["k"].dataType.simpleString()

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, state, letters, empty = None, hashlib.sha256(), [], True
            for batch in batches:
                done = []
                keys = column(batch, "k")
                for now, edit, piece in zip(keys.to_pylist(), column(batch, "edit").to_pylist(), column(batch, "piece").to_pylist()):
                    if now != key:
                        if key is not None:
                            done.append((key, "".join(letters), state.hexdigest()))
                        key, state, letters, empty = now, hashlib.sha256(), [], True
                    letters.append(edit)
                    if piece is not None:
                        state.update((piece if empty else "\n" + piece).encode("utf-8", "surrogatepass"))
                        empty = False
                if done:
                    k, a, h = zip(*done)
                    yield pa.RecordBatch.from_arrays([pa.array(k, keys.type), pa.array(a), pa.array(h)], names=["k", "audit", "repaired_sha256"])
            if key is not None:
                yield pa.RecordBatch.from_arrays([pa.array([key], keys.type), pa.array(["".join(letters)]), pa.array([state.hexdigest()])], names=["k", "audit", "repaired_sha256"])

        return dealt.mapInArrow(run, f"k {kind}, audit string, repaired_sha256 string")

    def report(self, conversations: DataFrame) -> DataFrame:
        """A row for each distinct k of ``conversations``: gaps, faults, cost, audit and digest; the scratch tables go."""
        sums = self.chunks.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")])
        turns = self.turns.groupBy("k", "turn").agg(F.lit(1).alias("one")).groupBy("k").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
        joined = conversations.select("k").distinct().join(sums, "k", "left").join(turns, "k", "left").join(self.digests(), "k", "left")
        numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        none = hashlib.sha256().hexdigest()
        return self.scratch.done(joined.select("k.conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256")))


def sorted_turns(s: Scratch, rows: DataFrame) -> DataFrame:
    """rows (k, turn, role, text) in order, written: ``gid`` numbers them within a range and, ranges being dealt in order, overall."""
    # a tie-breaker deals out equal rows, however many there are
    keyed = rows.withColumns({"__h": F.xxhash64("role", "text"), "__r": F.left("role", F.lit(64)), "__t": F.left("text", F.lit(64)), "__i": F.monotonically_increasing_id()})
    order = ["k", F.col("turn").asc_nulls_first(), "__r", "__t", "__h", "__i"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("gid", F.monotonically_increasing_id())
    seen = r"[^\x20\x09-\x0D]"
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    kind = F.when(~F.col("text").rlike(seen), BLANK).when(~last.isin(".", "!", "?"), CUT).otherwise(OK)
    return s.written(dealt.select("k", "gid", "turn", "role", "text", F.col("__h").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2"), initial(F.col("role")).alias("i"), kind.alias("kind")), "turns")


def chunked(s: Scratch, turns: DataFrame, bits: int) -> DataFrame:
    """(k, g, c, last, symbols): the chunks of every conversation, c their number from 0."""
    light = turns.select("k", "gid", "h1", "h2", "i", "kind")
    # equal turns of a conversation: the first one's place, where there are several
    first = s.written(light.where(F.col("kind") != BLANK).groupBy("k", "h1", "h2").agg(F.min("gid").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "copies")
    known = light.join(checked_broadcast(first, 200_000), ["k", "h1", "h2"], "left")
    kind = F.when((F.col("kind") != BLANK) & (F.col("gid") > F.col("first")), COPY).otherwise(F.col("kind"))
    letter = F.char(F.lit(ord("a")) + F.col("i") * 4 + kind)
    # a group is CHUNK rows at most
    symbols = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gid", letter.alias("letter")))), lambda x: x["letter"]), "")
    whole = s.written(known.groupBy("k", F.shiftright("gid", bits).alias("g")).agg(symbols.alias("symbols")), "symbols")
    # chunks of a range follow each other; a row a conversation and range says what its ranges before hold
    part = F.shiftright("g", 33 - bits)
    from pyspark.sql import Window

    per = whole.groupBy("k", part.alias("part")).agg(F.min("g").alias("lo"), (F.max("g") - F.min("g") + 1).alias("n"))
    over = Window.partitionBy("k")
    before = F.sum("n").over(over.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("k", "part", "lo", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(over).alias("all"))
    many = s.written(per.where("all > 1"), "ranges")
    joined = whole.withColumn("part", part).join(many, ["k", "part"], "left")
    c = F.coalesce(F.col("g") - F.col("lo") + F.col("before"), F.lit(0))
    return s.written(joined.select("k", "g", c.alias("c"), (c == F.coalesce("all", F.lit(1)) - 1).alias("last"), F.col("all").isNotNull().alias("many"), "symbols"), "chunks")


def settled(s: Scratch, chunks: DataFrame, fixups: int) -> DataFrame:
    """(k, c, g, last, symbols, edge, v, w): the chunks of conversations of several, with the true vectors at their ends, but for constants, and what these give at their starts."""
    kind = chunks.schema["k"].dataType.simpleString()
    schema = f"k {kind}, c long, g long, last boolean, symbols string, edge int, v array<long>, w array<long>, moved boolean"

    def guess(b: pa.RecordBatch) -> dict[str, pa.Array]:
        symbols = column(b, "symbols").to_pylist()
        v = np.tile(END, (len(symbols), 1))
        w = backward(codes_of(symbols), v)[0]
        moved = pa.array(column(b, "c").to_numpy() > 0)
        return {n: column(b, n) for n in ("k", "c", "g", "last", "symbols")} | {"edge": pa.array(np.zeros(len(symbols), np.int32)), "v": ints(v), "w": ints(w), "moved": moved}

    def again(b: pa.RecordBatch) -> dict[str, pa.Array]:
        symbols, v, w = column(b, "symbols").to_pylist(), rows_of(column(b, "v")).copy(), rows_of(column(b, "w")).copy()
        come = column(b, "come")
        new = level(rows_of(come, np.zeros(4, np.int64)))
        differs = (new != v).any(axis=1) & come.is_valid().to_numpy(zero_copy_only=False)
        moved, at = np.zeros(len(symbols), bool), np.flatnonzero(differs)
        if len(at):
            out = rerun(codes_of([symbols[i] for i in at]), v[at], new[at], w[at])
            moved[at] = (level(out) != level(w[at])).any(axis=1)
            v[at], w[at] = new[at], out
        # the pair of initials across the border, seen in the first pass
        ahead = column(b, "ahead").to_pylist()
        edge = [e if a is None else int(illegal_pair((ord(x[-1]) - ord("a")) // 4, (ord(a) - ord("a")) // 4)) for e, a, x in zip(column(b, "edge").to_pylist(), ahead, symbols)]
        return {n: column(b, n) for n in ("k", "c", "g", "last", "symbols")} | {"edge": pa.array(edge, pa.int32()), "v": ints(v), "w": ints(w), "moved": pa.array(moved)}

    runs = s.written(mapped(chunks.where("many").select("k", "c", "g", "last", "symbols"), guess, schema), "runs")
    for _ in range(fixups):
        if runs.where("moved").isEmpty():
            break
        come = runs.where("moved").select("k", (F.col("c") - 1).alias("c"), F.col("w").alias("come"), F.substring("symbols", 1, 1).alias("ahead"))
        runs = s.written(mapped(runs.join(come, ["k", "c"], "left"), again, schema), "runs")
    if not runs.where("moved").isEmpty():
        runs = s.written(mapped(runs.join(doubled(s, runs), ["k", "c"], "left").withColumn("ahead", F.lit(None).cast("string")), again, schema), "runs")
    return runs


def illegal_pair(a: int, b: int) -> bool:
    return (a, b) not in ((0, 1), (1, 2), (2, 1))


def doubled(s: Scratch, runs: DataFrame) -> DataFrame:
    """(k, c, come): the true vector at each chunk's end, by products of the matrices of 1, 2, 4, ... chunks, for conversations in which vectors still change."""
    open_ = runs.where("moved").select("k").distinct()
    kind = runs.schema["k"].dataType.simpleString()
    schema = f"k {kind}, c long, m array<long>, done boolean"

    def matrices(b: pa.RecordBatch) -> dict[str, pa.Array]:
        codes, last = codes_of(column(b, "symbols").to_pylist()), column(b, "last").to_numpy(zero_copy_only=False)
        n = len(last)
        m = np.empty((n, 4, 4), dtype=np.int64)
        for t in range(4):
            end = np.full((n, 4), FAR)
            end[:, t] = 0
            m[:, :, t] = np.minimum(backward(codes, end)[0], FAR)
        vector = (m + END).min(axis=2)
        m[last] = vector[last][:, :, None]
        return {"k": column(b, "k"), "c": column(b, "c"), "m": ints(m.reshape(n, 16)), "done": pa.array(last)}

    def product(b: pa.RecordBatch) -> dict[str, pa.Array]:
        m = rows_of(column(b, "m")).reshape(-1, 4, 4).copy()
        done = column(b, "done").to_numpy(zero_copy_only=False).copy()
        at = np.flatnonzero(~done)
        right = rows_of(column(b, "m2"), np.zeros(16, np.int64)).reshape(-1, 4, 4)
        m[at] = np.minimum((m[at][:, :, :, None] + right[at][:, None, :, :]).min(axis=2), FAR)
        done[at] = np.array(column(b, "done2").to_pylist(), dtype=object)[at].astype(bool)
        return {"k": column(b, "k"), "c": column(b, "c"), "m": ints(m.reshape(len(m), 16)), "done": pa.array(done)}

    spans, k = s.written(mapped(runs.join(open_, "k", "left_semi").select("k", "c", "last", "symbols"), matrices, schema), "spans"), 1
    while not spans.where("not done").isEmpty():
        partner = spans.select("k", (F.col("c") - k).alias("c"), F.col("m").alias("m2"), F.col("done").alias("done2")).where("c >= 0")
        spans, k = s.written(mapped(spans.join(partner, ["k", "c"], "left"), product, schema), "spans"), 2 * k
    # a finished span's columns are all the true vector at its start: the one at the end of the chunk before
    return spans.where("c > 0").select("k", (F.col("c") - 1).alias("c"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("m")[i * 4]).alias("come"))


def entries(s: Scratch, runs: DataFrame) -> DataFrame:
    """(k, c, entry): the state in which each chunk after the first is entered."""
    kind = runs.schema["k"].dataType.simpleString()
    schema = f"k {kind}, c long, f array<long>"

    def maps(b: pa.RecordBatch) -> dict[str, pa.Array]:
        codes = codes_of(column(b, "symbols").to_pylist())
        costs = backward(codes, rows_of(column(b, "v")))
        f = np.stack([traced(codes, costs, np.full(costs.shape[1], e))[2] for e in range(4)], axis=1)
        first = column(b, "c").to_numpy() == 0
        f[first] = f[first][:, :1]
        return {"k": column(b, "k"), "c": column(b, "c"), "f": ints(f)}

    found, k = s.written(mapped(runs.select("k", "c", "symbols", "v"), maps, schema), "maps"), 1
    varies = F.size(F.array_distinct("f")) > 1
    while not found.where(varies).isEmpty():
        partner = found.select("k", (F.col("c") + k).alias("c"), F.col("f").alias("f0"))
        composed = F.when(varies, F.transform("f0", lambda x: F.col("f")[x.cast("int")])).otherwise(F.col("f"))
        found, k = s.written(found.join(partner, ["k", "c"], "left").select("k", "c", composed.alias("f")), "maps"), 2 * k
    return found.select("k", (F.col("c") + 1).alias("c"), F.col("f")[0].cast("int").alias("entry"))


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK, fixups: int = FIXUPS) -> Repair:
    """The cheapest repair of every conversation of df."""
    need(df, conv, turn, role, text)
    if chunk < 1 or chunk & (chunk - 1):
        raise ValueError(f"chunk must be a power of two, not {chunk}")
    bits, s = chunk.bit_length() - 1, Scratch(df.sparkSession, "conversations")
    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = df.select(F.struct(F.col(f"`{conv}`").alias("conv_id")).alias("k"), F.col(f"`{turn}`").cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text"))
    turns = sorted_turns(s, rows)
    chunks = chunked(s, turns, bits)
    runs = settled(s, chunks, fixups)
    kind = chunks.schema["k"].dataType.simpleString()

    def finish(b: pa.RecordBatch) -> dict[str, pa.Array]:
        symbols = column(b, "symbols").to_pylist()
        codes, entry, last = codes_of(symbols), column(b, "entry"), column(b, "last").to_numpy(zero_copy_only=False)
        start = np.array([x or 0 for x in entry.to_pylist()], dtype=np.int64)
        costs = backward(codes, rows_of(column(b, "v"), END))
        inserted, done, state = traced(codes, costs, start)
        head = column(b, "c").to_numpy() == 0
        cost = np.where(head, costs[0][:, NONE], costs[0].min(axis=1))
        initials, kinds = codes
        pairs = (kinds[:, 1:] >= 0) & ~((initials[:, :-1] == 0) & (initials[:, 1:] == 1) | (initials[:, :-1] == 1) & (initials[:, 1:] == 2) | (initials[:, :-1] == 2) & (initials[:, 1:] == 1))
        edge = np.array([x or 0 for x in column(b, "edge").to_pylist()])
        count = lambda what: pa.array((kinds == what).sum(axis=1))
        return {"k": column(b, "k"), "g": column(b, "g"), "entry": pa.array(start.astype(np.int32)), "audit": pa.array(audits(inserted, done, state, last), pa.string()), "cost": pa.array(cost), "blank": count(BLANK), "duplicate": count(COPY), "truncated": count(CUT), "illegal": pa.array(pairs.sum(axis=1) + edge)}

    known = runs.select("k", "c", "v", "edge").join(entries(s, runs), ["k", "c"], "left")
    done = mapped(chunks.select("k", "c", "g", "last", "symbols").join(known, ["k", "c"], "left"), finish, f"k {kind}, g long, entry int, audit string, cost long, blank long, duplicate long, truncated long, illegal long")
    return Repair(s, turns, s.written(done, "done"), bits)


def repair_report(df: DataFrame, of: DataFrame | None = None, conv: str = "conv_id", **options) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of ``of``, or else of df."""
    known = (df if of is None else of).select(F.struct(F.col(f"`{conv}`").alias("conv_id")).alias("k"))
    return repair(df, conv=conv, **options).report(known)


def repaired_turns(df: DataFrame, conv: str = "conv_id", **options) -> DataFrame:
    """conv_id, position, edit, role, text of every turn and insertion in order; deleted turns have no role and text."""
    fixed = repair(df, conv=conv, **options)
    return fixed.scratch.done(fixed.edited().select("k.conv_id", F.struct("gid", "seq").alias("position"), "edit", "role", "text"))
