"""Sampled SentencePiece segmentations without replacement, and decoding (operator 4).

A text's lattice has an arc for every vocabulary piece at every place.  No piece
crosses from a word into the space before the next one, or a line end, so
the lattice is a chain of small lattices, one for each distinct chunk of a slice
of rows; those are built together with NumPy: pieces are looked up by rolling
hash, and one backward pass gives every node's log-sum over its completions, so
each arc has its conditional probability q.

Gumbel top-k by perturbed A-star search: a search node stands for the
segmentations that share a prefix and avoid some arcs after it, and its key
is the largest Gumbel-perturbed log-probability among them, drawn top-down from a
truncated Gumbel whose location is the exact log-mass of the node.  Popping the
best node follows its best path to the end (one more sample, distinct from
all before it); every place along that path leaves a node of the
alternatives there, bounded by the key.  All rows of a slice pop in lockstep.  A
sample's inclusion score is log(1 - exp(-exp(logp - kappa))), kappa being the
best key left after k samples, or minus infinity where there are no more.

Piece log-probabilities: a unigram model's scores as they are; a BPE model has
ranks only, so its pieces get Zipf-Mandelbrot weights -log(rank + 2.7),
normalised.  A character that is no piece costs its byte pieces, each below the
rarest piece.  Draws come from a counter-based generator seeded by row key and
seed, so results do not depend on partitioning.

Defined results: a null or empty text has one segmentation, the empty one, whose
log-probability is 0; fewer than k segmentations give all of them; repeated
rows get equal samples, null keys count as 0; the character U+2581 in a text is
a space, as in the library; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import need, others, spare
from .textkit import _powers, list_array, mix64, raw_bytes, regrouped, tidy

#: Text bytes of the rows that are segmented together; a worker takes some 150 times as much for a slice.
SLICE = 1 << 19
#: Bytes of distinct chunks whose lattices are built at once.
BLOCK = 96 << 10
SAMPLE = T.StructType(
    [T.StructField("sample", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("log_prob", T.DoubleType()), T.StructField("key", T.DoubleType()), T.StructField("log_inclusion", T.DoubleType())]
)


def slots_of(h: np.ndarray) -> np.ndarray:
    """The table slot, below 2**16, of rolling hashes."""
    with np.errstate(over="ignore"):
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.intp)


def head_codes(buf: np.ndarray) -> np.ndarray:
    """A 16-bit code of the three bytes from each place on (zeros beyond the end)."""
    b = np.zeros(len(buf) + 2, dtype=np.uint32)
    b[: len(buf)] = buf
    return ((b[:-2] * 40503 + b[1:-1] * 31153 + b[2:] * 24821) >> 3 & 0xFFFF).astype(np.uint16)


class Pieces:
    """A vocabulary by byte length and hash, spaces standing for U+2581."""

    def __init__(self, path: str, theta: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        text = [model.id_to_piece(i).replace("▁", " ").encode() for i in plain]
        if any(b" " in t.lstrip(b" ") or b"\n" in t for t in text):
            raise ValueError("the vocabulary has pieces that cross a space or a line end")
        score = np.array([model.get_score(i) for i in plain])
        if np.all(score == np.round(score)):
            rank = np.where(score > -1e8, -score, len(score))
            weight = 1 / (rank + 2.7)
            score = np.log(weight / weight.sum())
        self.byte_cost = theta * (score.min() - 1.0)
        self.byte_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        self.single = np.zeros(0x110000, dtype=bool)
        up, _ = _powers(64)
        by: dict[int, list[int]] = {}
        for k, t in enumerate(text):
            by.setdefault(len(t), []).append(k)
        self.by_length = {}
        with np.errstate(over="ignore"):
            for size, members in sorted(by.items()):
                raw = np.frombuffer(b"".join(text[k] for k in members), dtype=np.uint8).reshape(-1, size)
                h = ((raw.astype(np.uint64) + np.uint64(1)) * up[:size]).sum(axis=1, dtype=np.uint64)
                slot = slots_of(h)
                order = np.argsort(slot, kind="stable")
                begin = np.full(65537, -1, dtype=np.int32)
                begin[slot[order][::-1]] = np.arange(len(order), dtype=np.int32)[::-1]
                gate = np.full(65536, size < 3)
                gate[head_codes(raw.reshape(-1))[::size]] = True
                # one entry more, of no piece, ends the last slot
                self.by_length[size] = (np.append(h[order], [np.uint64(0)]), np.append(slot[order], [65536]), np.array([plain[k] for k in members], dtype=np.int32)[order], theta * score[members][order], begin, gate)
        out = [b""] * n
        for i, t in zip(plain, text):
            out[i] = t
        for b in range(256):
            out[self.byte_id[b]] = bytes([b])
        self.start = np.concatenate([[0], np.cumsum([len(t) for t in out])])
        self.bytes = np.frombuffer(b"".join(out), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of a flat run of ids, and the place of each id in them."""
        size = (self.start[1:] - self.start[:-1])[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.start[ids] - (ends - size), size) + np.arange(int(size.sum()))
        return self.bytes[at], np.concatenate([[0], ends])


@lru_cache(maxsize=2)
def pieces(path: str, theta: float = 1.0) -> Pieces:
    return Pieces(path, theta)


class Lattices:
    """Arcs of the lattices of distinct chunks: by state, with conditional probabilities."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray, vocabulary: Pieces):
        self.buf, parts, base = buf, [], 0
        size = np.diff(bounds)
        self.first = np.zeros(len(size), dtype=np.int32)
        self.last = np.zeros(len(size), dtype=np.int32)
        at = 0
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK, side="right")) - 1)
            lo, n = int(bounds[at]), size[at:to]
            own = bounds[at : to + 1] - lo
            shift = base + np.arange(to - at)
            self.first[at:to], self.last[at:to] = own[:-1] + shift, own[1:] + shift
            parts.append(list(self._block(buf[lo : int(bounds[to])], own, n, vocabulary, base, lo)))
            base += int(own[-1]) + to - at
            at = to
        # a block's arrays go as they are joined, so that no more than one of them is there twice
        join = lambda kind: np.concatenate([p.pop(0) for p in parts]) if parts else np.empty(0, kind)
        self.state, self.size, self.piece, self.place = (join(np.int32) for _ in range(4))
        self.q, self.cdf, self.rest = (join(np.float64) for _ in range(3))
        self.range = np.searchsorted(self.state, np.arange(base + 1, dtype=np.int32)).astype(np.int32)

    @staticmethod
    def _block(buf, own, n, vocabulary, base, lo):
        up, down = _powers(len(buf) + 1)
        chunk = np.repeat(np.arange(len(n)), n)
        left = own[1:][chunk] - np.arange(len(buf))
        lead = (buf & 0xC0) != 0x80
        sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        found = []
        with np.errstate(over="ignore"):
            np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
            every, codes = np.flatnonzero(lead), head_codes(buf)
            for size, (h, slots, ids, score, begin, gate) in vocabulary.by_length.items():
                every = every[left[every] >= size]
                if not len(every):
                    break
                idx = every[gate[codes[every]]]
                v = (sums[idx + size] - sums[idx]) * down[idx]
                slot = slots_of(v)
                k = begin[slot]
                some = np.flatnonzero(k >= 0)
                k, v, slot = k[some], v[some], slot[some]
                while len(some):
                    hit = h[k] == v
                    place = idx[some[hit]]
                    found.append((place, np.full(len(place), size), ids[k[hit]], score[k[hit]]))
                    more = ~hit & (slots[k + 1] == slot)
                    some, k, v, slot = some[more], k[more] + 1, v[more], slot[more]
        width = np.where(buf < 0x80, 1, np.where(buf < 0xE0, 2, np.where(buf < 0xF0, 3, 4)))
        known = np.zeros(len(buf), dtype=bool)
        for place, size, _, _ in found:
            known[place[size == width[place]]] = True
        bare = np.flatnonzero(lead & ~known)
        found.append((bare, np.minimum(width[bare], left[bare]), np.full(len(bare), -1, dtype=np.int32), vocabulary.byte_cost * np.minimum(width[bare], left[bare])))
        # longest pieces, mostly the likely ones, come first within a place
        place, size, piece, score = (np.concatenate(x) for x in zip(*found[::-1]))
        order = np.argsort(place, kind="stable")
        place, size, piece, score = place[order], size[order], piece[order], score[order]
        state = place + chunk[place]
        beta = np.zeros(len(buf) + len(n))
        togo = left[place]
        if len(togo) and togo.max() < 1 << 16:
            togo = togo.astype(np.uint16)  # a radix sort
        by = np.argsort(togo, kind="stable")
        cuts = np.searchsorted(togo[by], np.arange(1, int(togo.max(initial=0)) + 2))
        for d in range(len(cuts) - 1):
            a = by[cuts[d] : cuts[d + 1]]
            if not len(a):
                continue
            s = state[a]
            v = score[a] + beta[s + size[a]]
            begin = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            top = np.maximum.reduceat(v, begin)
            runs = np.diff(np.r_[begin, len(s)])
            beta[s[begin]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, runs)), begin))
        q = np.minimum(np.exp(score + beta[state + size] - beta[state]), 1.0)
        cdf = np.cumsum(q)
        if len(state):
            begin = np.flatnonzero(np.r_[True, state[1:] != state[:-1]])
            runs = np.diff(np.r_[begin, len(state)])
            cdf -= np.repeat(cdf[begin] - q[begin], runs)
            cdf[begin + runs - 1] = 1.0
        # the mass of a place's other arcs, added up and not subtracted, so that very small ones count
        rest = np.zeros(len(q))
        for k in range(1, int(runs.max()) if len(state) else 0):
            at = np.flatnonzero(state[k:] == state[:-k])
            rest[at] += q[at + k]
            rest[at + k] += q[at]
        return (state + base).astype(np.int32), size.astype(np.int32), piece, (place + lo).astype(np.int32), q, cdf, rest


class Draws:
    """Uniform numbers by (row seed, counter)."""

    def __init__(self, seeds: np.ndarray):
        self.seeds, self.used = mix64(seeds + np.uint64(0x632BE59BD9B4E019)), np.zeros(len(seeds), dtype=np.uint64)

    def take(self, row: np.ndarray) -> np.ndarray:
        """A number for each entry of row, which is sorted."""
        begin = np.searchsorted(row, np.arange(len(self.seeds), dtype=row.dtype))
        n = np.diff(np.append(begin, len(row)))
        k = (np.arange(len(row)) - begin[row]).astype(np.uint64) + self.used[row]
        self.used += n.astype(np.uint64)
        with np.errstate(over="ignore"):
            x = mix64(self.seeds[row] + k * np.uint64(0x9E3779B97F4A7C15))
        return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Search:
    """Lockstep perturbed A-star over the rows of a slice."""

    def __init__(self, lattices: Lattices, chunks: np.ndarray, bounds: np.ndarray, seeds: np.ndarray, k: int):
        self.l, self.chunks, self.k = lattices, chunks, k
        self.row = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
        self.bounds, self.rows = bounds, len(bounds) - 1
        self.draws = Draws(seeds)
        self.logq = np.log(lattices.q)
        self.pool: list[list[tuple]] = [[] for _ in range(self.rows)]
        self.spines: list[tuple] = []

    def _finish(self, occ: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best paths from the given states to the ends of their chunks: (occurrence, arc), by step."""
        got_o, got_a = [], []
        live = state < self.l.last[self.chunks[occ]]
        occ, state = occ[live], state[live]
        while len(occ):
            u = self.draws.take(self.row[occ])
            arc = self.l.range[state]
            on = np.flatnonzero(u > self.l.cdf[arc])
            while len(on):
                arc[on] += 1
                on = on[u[on] > self.l.cdf[arc[on]]]
            got_o.append(occ)
            got_a.append(arc)
            state = state + self.l.size[arc]
            live = state < self.l.last[self.chunks[occ]]
            occ, state = occ[live], state[live]
        return (np.concatenate(got_o), np.concatenate(got_a)) if got_o else (np.empty(0, np.int32), np.empty(0, np.int32))

    def _leave(self, rows: np.ndarray, arcs: np.ndarray, start: np.ndarray, bound: np.ndarray, gone: dict[int, tuple], first: np.ndarray) -> None:
        """Put the alternatives along new paths into the pool; gone: row -> arcs excluded at its first place, where ``first`` is the others' mass."""
        logq = self.logq[arcs]
        total = np.concatenate([[0.0], np.cumsum(logq)])
        begin = self.spines[-1][2]
        before = total[:-1] - total[begin[rows]]
        rest = self.l.rest[arcs]
        again = np.array(list(gone), dtype=np.int64)
        rest[start[again]] = first[again]
        at = np.arange(len(arcs))
        ok = (rest > 0) & (at >= start[rows])
        with np.errstate(divide="ignore", over="ignore"):
            mass = before + np.log(rest)
            e = -np.log(self.draws.take(rows))
            key = np.where(ok, mass - np.log(np.exp(np.minimum(mass - bound[rows], 700.0)) + e), -np.inf)
        index = len(self.spines) - 1
        some = np.flatnonzero(np.diff(np.append(begin, len(rows))) > 0)
        for _ in range(self.k):
            if not len(some):
                break
            top = np.maximum.reduceat(key, begin[some])
            some, top = some[top > -np.inf], top[top > -np.inf]
            if not len(some):
                break
            whole = np.full(self.rows, np.inf)
            whole[some] = top
            best = np.flatnonzero(key == whole[rows])
            for r, j, g in zip(rows[best].tolist(), best.tolist(), key[best].tolist()):
                self.pool[r].append((g, index, j, gone.get(r, ()) if j == start[r] else ()))
            key[best] = -np.inf

    def run(self) -> list[tuple]:
        """Rounds of (rows with a sample, their keys, arcs, row of each arc)."""
        occ = np.arange(len(self.chunks), dtype=np.int32)
        o, a = self._finish(occ, self.l.first[self.chunks])
        order = np.argsort(o, kind="stable")
        o, a = o[order], a[order]
        have = np.arange(self.rows)
        key = -np.log(-np.log(self.draws.take(have)))
        self.spines.append((o, a, np.searchsorted(self.row[o], np.arange(self.rows, dtype=np.int32))))
        rounds = [(have, key.copy(), o, a)]
        self._leave(self.row[o], a, np.zeros(self.rows, dtype=np.int64), key, {}, np.empty(0))
        for _ in range(1, self.k):
            rows = np.array([r for r in range(self.rows) if self.pool[r]], dtype=np.int64)
            if not len(rows):
                break
            # the best node of each row: its key, spine, place on it, and arcs excluded there
            best = [pool.pop(max(range(len(pool)), key=lambda i: pool[i][0])) for pool in (self.pool[r] for r in rows.tolist())]
            key = np.full(self.rows, -np.inf)
            key[rows] = [b[0] for b in best]
            spine = np.array([b[1] for b in best])
            base = np.concatenate([[0], np.cumsum([len(x[0]) for x in self.spines])])
            so, sa = (np.concatenate([x[i] for x in self.spines]) for i in (0, 1))
            begin = base[spine] + np.array([self.spines[i][2][r] for i, r in zip(spine.tolist(), rows.tolist())])
            j = base[spine] + np.array([b[2] for b in best])
            taken = sa[j]
            low = self.l.range[self.l.state[taken]].astype(np.int64)
            width = self.l.range[self.l.state[taken] + 1] - low
            head = np.cumsum(width) - width
            p = self.l.q[np.repeat(low - head, width) + np.arange(int(width.sum()))]
            p[head + taken - low] = 0.0
            for n, b in enumerate(best):
                for x in b[3]:
                    p[head[n] + x - low[n]] = 0.0
            c = np.cumsum(p)
            before = c[head] - p[head]
            aim = before + self.draws.take(rows) * (c[head + width - 1] - before)
            pick = np.add.reduceat((c <= np.repeat(aim, width)).astype(np.int64), head)
            arc = (low + np.minimum(pick, width - 1)).astype(np.int32)
            p[head + arc - low] = 0.0
            first = np.zeros(self.rows)
            first[rows] = np.add.reduceat(p, head)
            gone = {r: (*b[3], int(t)) for r, b, t in zip(rows.tolist(), best, taken.tolist())}
            lengths = np.zeros(self.rows, dtype=np.int64)
            lengths[rows] = j - begin
            path = np.repeat(begin - (np.cumsum(j - begin) - (j - begin)), j - begin) + np.arange(int((j - begin).sum()))
            after = self.bounds[rows + 1] - so[j] - 1
            rest = (np.repeat(so[j] + 1 - (np.cumsum(after) - after), after) + np.arange(int(after.sum()))).astype(np.int32)
            occ = np.concatenate([so[j], rest])
            state = np.concatenate([self.l.state[arc] + self.l.size[arc], self.l.first[self.chunks[rest]]])
            order = np.argsort(occ, kind="stable")
            o, a = self._finish(occ[order], state[order])
            o, a = np.concatenate([so[path], so[j], o]), np.concatenate([sa[path], arc, a])
            order = np.argsort(o, kind="stable")
            o, a = o[order], a[order]
            self.spines.append((o, a, np.searchsorted(self.row[o], np.arange(self.rows, dtype=np.int32))))
            rounds.append((rows, key, o, a))
            self._leave(self.row[o], a, self.spines[-1][2] + lengths, key, gone, first)
        return rounds

    def left(self) -> np.ndarray:
        return np.array([max((n[0] for n in p), default=-np.inf) for p in self.pool])


_CHUNK = r" *[^ \n]+| +|\n"


def chunked(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the distinct chunks, their bounds, chunk of each occurrence, bounds of the rows)."""
    import re

    find = re.compile(_CHUNK).findall
    lists = [find(" " + t.replace("▁", " ")) if t else [] for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    codes = pa.array([c for x in lists for c in x], type=pa.large_string()).dictionary_encode()
    return *raw_bytes(codes.dictionary), codes.indices.to_numpy().astype(np.int32), bounds


def samples(texts: list[str], seeds: np.ndarray, k: int, vocabulary: Pieces) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each round: (rows, ids, bounds of the ids by row, log_prob, key, log_inclusion)."""
    buf, bounds, chunks, rows = chunked(texts)
    lattices = Lattices(buf, bounds, vocabulary)
    search = Search(lattices, chunks, rows, seeds, k)
    rounds = search.run()
    kappa = search.left()
    for have, key, o, a in rounds:
        row = search.row[o]
        logp = np.bincount(row, search.logq[a], len(texts))
        piece, size = lattices.piece[a], lattices.size[a]
        n = np.where(piece >= 0, 1, size)
        ids = np.repeat(piece, n)
        bare = np.flatnonzero(ids < 0)
        if len(bare):
            offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            ids[bare] = vocabulary.byte_id[buf[np.repeat(lattices.place[a], n)[bare] + offset[bare]]]
        of = np.repeat(row, n)
        cuts = np.searchsorted(of, np.append(have, len(texts)))
        x = logp[have] - kappa[have]
        with np.errstate(over="ignore", divide="ignore"):
            inclusion = np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 700.0)))))
        yield have, ids.astype(np.int32), cuts, logp[have], key[have], inclusion


def sample_segmentations(df: DataFrame, model: str, k: int = 3, id: str = "doc_id", text: str = "text", theta: float = 1.0, seed: int = 0, check: bool = False, keep: list[str] | None = None) -> DataFrame:
    """df, a row for each of its up to k distinct samples, with the columns of SAMPLE.

    ``model`` is the path of a SentencePiece file, which the executors read;
    ``theta`` sharpens (above 1) or flattens the distribution; ``check`` adds
    ``round_trip``: do the ids decode to the text; ``keep`` names the columns of df
    that go along, all by default.
    """
    need(df, id, text)
    names = [*SAMPLE.names, *["round_trip"] * check]
    need(df, *keep or [])
    kept, body, of = [c for c in others(df, *names) if keep is None or c in keep], spare(df, "text"), spare(df, "seed")
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.xxhash64(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("0")), F.lit(seed)).alias(of), F.col(f"`{text}`").cast("string").alias(body))
    schema = T.StructType([*df.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, *SAMPLE.fields, *[T.StructField("round_trip", T.BooleanType())] * check])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model, theta)
        for part in regrouped(batches, body, SLICE):
            texts = pc.fill_null(part.column(body), "").to_pylist()
            seeds = part.column(of).to_numpy().view(np.uint64)
            for n, (rows, ids, cuts, logp, key, inclusion) in enumerate(samples(texts, seeds, k, vocabulary)):
                take = pa.array(rows)
                own = [part.column(i).take(take) for i in range(len(kept))]
                columns = [pa.array(np.full(len(rows), n + 1, dtype=np.int32)), list_array(ids, cuts, pa.int32()), pa.array(logp), pa.array(key), pa.array(inclusion)]
                if check:
                    back = decoded_texts(vocabulary, ids, cuts)
                    columns.append(pa.array([b == texts[r].replace("▁", " ") for b, r in zip(back, rows)], type=pa.bool_()))
                yield pa.RecordBatch.from_arrays([*own, *columns], names=[*kept, *names])

    return source.mapInArrow(run, schema)


def decoded_texts(vocabulary: Pieces, ids: np.ndarray, cuts: np.ndarray) -> Iterator[str]:
    """The text of each run of ids between the cuts, without the space that encoding puts first."""
    data, places = vocabulary.decode(ids)
    raw, at = data.tobytes(), places[cuts]
    return (raw[a:b].decode("utf-8", "replace")[1:] for a, b in zip(at[:-1], at[1:]))


def decode_ids(df: DataFrame, model: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """df and the text that the ids stand for, without the space that encoding puts first."""
    need(df, ids)
    kept = [c for c in df.columns if c != output]
    schema = T.StructType([*df.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, T.StructField(output, T.StringType())])
    at = kept.index(ids)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = part.column(at)
                flat = lists.flatten()
                cuts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
                texts = list(decoded_texts(vocabulary, flat.to_numpy(zero_copy_only=False), cuts))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(kept))], pa.array(texts, mask=lists.is_null().to_numpy(zero_copy_only=False), type=pa.string())], names=[*kept, output])

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)
