"""Vectorised text primitives shared by the corpus operators.

Everything here works on one Arrow column of strings at a time and is bounded
by the bytes of one slice (or of one document, when a single document is
longer than the slice).  Words are the maximal runs of bytes other than
space and 0x09-0x0D; hashes are 64 bits wide, so a wrong answer needs two
different words or shingles *of the compared texts* to collide
(about n*m / 2**64 for texts of n and m words).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: Odd multipliers of two independent rolling hashes.
_BASES = (0x9E3779B97F4A7C15, 0xC6BC279692B5C323)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a multiplier and of its inverse modulo 2**64, n of each at least."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size, out = max(n, SLICE_BYTES + 1), []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(p))
        have = _POWERS[which] = (out[0], out[1])
    return have


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each byte span, the first or the second; works through the spans in bounded blocks."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, lo + SLICE_BYTES, side="right")))
        hi = int(ends[to - 1])
        up, down = _powers(hi - lo + 1, which)
        with np.errstate(over="ignore"):
            sums = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum((buf[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
            s, e = starts[at:to] - lo, ends[at:to] - lo
            out[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        at = to
    return mix64(out)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch of about ``limit`` text bytes, one row at least."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(total[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def regrouped(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of about ``limit`` text bytes, small batches put together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if size >= limit:
            yield from slices(pa.Table.from_batches(held).combine_chunks().to_batches()[0], column, limit)
            held, size = [], 0
    if held and (rest := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield from slices(rest[0], column, limit)


def tidy(run):
    """run, a function of Arrow batches, that gives freed memory back when its task ends.

    Python workers outlive their tasks; without this each keeps its largest
    task's memory while it waits.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the row offsets into them; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    big = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return buf, offsets - offsets[0]


def spans(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where ``inside`` holds, cut at row starts."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    rows = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[rows] = inside[rows]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = rows[rows > 0] - 1
    last[cut] = inside[cut]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Words:
    """The words of every row of a string column: spans, hashes, row bounds."""

    inside = _IS_WORD

    def __init__(self, column: pa.Array, lower: bool = True):
        self.raw, self.offsets = raw_bytes(column)
        self.buf = _LOWER[self.raw] if lower else self.raw
        self.starts, self.ends = spans(self.buf, self.offsets, self.inside[self.buf])
        self.bounds = np.searchsorted(self.starts, self.offsets).astype(np.int64)
        self.counts = np.diff(self.bounds)
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = hash_spans(self.buf, self.starts, self.ends)
        return self._hashes

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def text(self, i: int) -> str:
        return self.buf[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def combine(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive entries (len - width + 1 of them)."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = mix64(out * np.uint64(0x9FB21C651E98DF25) + hashes[k : k + n] + np.uint64(k + 1))
    return out


def sequence_hash(hashes: np.ndarray) -> int:
    """Hash of a whole short sequence."""
    return int(combine(hashes, len(hashes))[0])


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every row, as one array sorted within rows, and row bounds.

    A row with fewer words than ``width`` has its whole sequence as one
    shingle; a row without words has none.
    """
    h, bounds = words.hashes, words.bounds
    rows = len(words.counts)
    n = np.where(words.counts >= width, words.counts - width + 1, words.counts > 0).astype(np.int64)
    ends = np.cumsum(n)
    full = words.counts >= width
    values = np.empty(int(ends[-1]) if rows else 0, dtype=np.uint64)
    every = combine(h, width)
    m = np.where(full, n, 0)
    values[np.repeat(full, n)] = every[np.repeat(bounds[:-1] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
    for r in np.flatnonzero(n * ~full):
        values[ends[r] - 1] = sequence_hash(h[bounds[r] : bounds[r + 1]])
    for lo, hi in zip((ends - n).tolist(), ends.tolist()):
        values[lo:hi].sort()
    row = np.repeat(np.arange(rows), n)
    if len(values):
        keep = np.ones(len(values), dtype=bool)
        keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
        values, row = values[keep], row[keep]
    return values, np.searchsorted(row, np.arange(rows + 1))


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as the int64 of the same bits, Spark's long."""
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)


def list_array(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Arrow list column out of flat values and row bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, type=kind))
