"""Benchmark decontamination by SimHash windows (operator 2).

Every benchmark item has a 64-bit SimHash of its word pairs.  A window of a
document has as many words as the item, or what the text's ends leave of it; its
fingerprint comes from running sums of the 64 bits.  The fingerprint is cut into
four blocks of 16 bits; a window is a candidate when one block is within
``reach`` bits of the same block of an item of its size, looked up in a bit table of 65,536
entries, which by the pigeonhole principle misses no fingerprint within
4 * reach + 3 bits.  Candidates within that radius are verified by the exact
weighted similarity of their word shingles, sum of min(weights) / sum of
max(weights), a shingle's weight being its number of occurrences.

A window that is to be verified shares a shingle with its item, so windows are
only laid where a shingle of some item stands, and for the items that have it;
this loses nothing.  The default radius of 19 bits misses one edited passage of similarity
0.8 in some thousands (the test measures it); 15 bits missed one in sixty.

The documents are only mapped: no shuffle, and no row limit.  Items are
broadcast in blocks of at most ``BLOCK_BYTES`` of text on average, one pass over
the documents for each block, so many items cost time and not memory.

Words are runs of ASCII letters and digits and of bytes from 0x80 up, in lower
case, so that punctuation and spacing don't hide a passage.

Defined results: null and empty texts have no window; items of fewer words than
a shingle match nothing, since they can't be told from chance; repeated items are
reported each; of equally similar windows of an item the first counts; repeated rows are judged
alike; empty tables give no hits; an input column named ``hits`` is replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import aside, need, others, spare
from .textkit import Words, combine, slices, tidy

#: Text bytes of the items that are broadcast at once.
BLOCK_BYTES = 8 << 20
#: Words of a SimHash feature.
FEATURE = 2
#: Windows, and words of a region, that are worked on at once.
STRIDE = 1 << 14
HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("similarity", T.DoubleType())]))
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class LooseWords(Words):
    """Words of letters and digits only, in lower case."""

    inside = _ALNUM


def running_sums(hashes: np.ndarray) -> np.ndarray:
    """Row i: how many of the first i hashes have each of the 64 bits."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(hashes) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
    return sums


def fingerprints(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """SimHash of the features from each begin to before its end, by the running sums."""
    more = 2 * (sums[end] - sums[begin]) > (end - begin)[:, None]
    return np.packbits(more.reshape(-1), bitorder="little").view(np.uint64)


def simhash(features: np.ndarray) -> np.uint64:
    """SimHash of one sequence of feature hashes."""
    return fingerprints(running_sums(features), np.array([0]), np.array([len(features)]))[0]


class Items:
    """The items of one block: by size, fingerprints and block tables; by shingle, the items that have it."""

    def __init__(self, rows: list[tuple[int, str]], width: int, reach: int):
        self.reach, self.width = reach, width
        words = LooseWords(pa.array([t or "" for _, t in rows], type=pa.large_string()))
        used = [i for i, n in enumerate(words.counts) if n >= width]
        hashes = [words.hashes[words.bounds[i] : words.bounds[i + 1]] for i in used]
        self.ids = [rows[i][0] for i in used]
        self.sizes = np.array([len(h) for h in hashes], dtype=np.int64)
        self.prints = np.array([simhash(combine(h, FEATURE)) for h in hashes], dtype=np.uint64)
        self.weights = [np.unique(combine(h, width), return_counts=True) for h in hashes]
        near = [sum(1 << b for b in bits) for k in range(reach + 1) for bits in combinations(range(16), k)]
        near_bits = np.array(near, dtype=np.uint16)
        self.tables: dict[int, np.ndarray] = {}
        for m in np.unique(self.sizes).tolist():
            tables = np.zeros((4, 65536), dtype=bool)
            for k in range(4):
                block = ((self.prints[self.sizes == m] >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.uint16)
                for value in np.unique(block):
                    tables[k][value ^ near_bits] = True
            self.tables[m] = np.packbits(tables, axis=1, bitorder="little")
        keys = np.concatenate([w[0] for w in self.weights]) if used else np.empty(0, np.uint64)
        own = np.repeat(np.arange(len(used)), [len(w[0]) for w in self.weights])
        order = np.argsort(keys, kind="stable")
        self.shingles = np.unique(keys)
        self.first = np.append(np.searchsorted(keys[order], self.shingles), len(keys))
        self.having = own[order]

    @property
    def radius(self) -> int:
        return 4 * self.reach + 3

    def near(self, m: int, prints: np.ndarray) -> np.ndarray:
        """Which fingerprints have a block near one of the items of m words."""
        blocks = prints.view(np.uint16).reshape(-1, 4)
        tables = self.tables[m]
        found = np.zeros(len(prints), dtype=bool)
        for k in range(4):
            found |= (tables[k][blocks[:, k] >> 3] >> (blocks[:, k] & 7).astype(np.uint8) & 1).astype(bool)
        return found

    def sharing(self, places: np.ndarray) -> np.ndarray:
        """The items that have one of the shingles at the places of the sorted shingles."""
        return np.unique(np.concatenate([self.having[self.first[p] : self.first[p + 1]] for p in np.unique(places)]))


def weighted_similarity(shingles: np.ndarray, begin: np.ndarray, end: np.ndarray, item: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sum of min(weights) / sum of max(weights) of each run of shingles with an item's (shingles, weights)."""
    keys, weights = item
    size = end - begin
    out = np.zeros(len(begin))
    step = max(1, (1 << 20) // int(max(len(keys), size.max(initial=1))))
    for at in range(0, len(begin), step):
        b, n = begin[at : at + step], size[at : at + step]
        run = np.repeat(np.arange(len(b)), n)
        own = shingles[np.repeat(b - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        inside = keys[place] == own
        counts = np.bincount(run[inside] * len(keys) + place[inside], minlength=len(b) * len(keys)).reshape(len(b), len(keys))
        both = np.minimum(counts, weights).sum(axis=1)
        out[at : at + step] = both / (n + weights.sum() - both)
    return out


def _regions(words: Words, shingles: np.ndarray, items: Items) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, words where a shingle of an item begins, its place among the items' shingles), for hits near to each other."""
    if not len(items.shingles) or not len(shingles):
        return
    rows, most = words.rows, int(items.sizes.max())
    place = np.minimum(np.searchsorted(items.shingles, shingles), len(items.shingles) - 1)
    at = np.flatnonzero((items.shingles[place] == shingles) & (rows[: len(shingles)] == rows[items.width - 1 :]))
    row = rows[at]
    cut = np.flatnonzero((row[1:] != row[:-1]) | (at[1:] - at[:-1] > most) | (at[1:] // STRIDE != at[:-1] // STRIDE)) + 1
    for lo, hi in zip([0, *cut], [*cut, len(at)]):
        if hi > lo:
            yield int(row[lo]), at[lo:hi], place[at[lo:hi]]


def find(words: Words, items: Items, percent: int) -> dict[int, list[tuple[int, int, float]]]:
    """Row -> the best window (item id, first word, similarity) of each item that it contains."""
    shingles, features = combine(words.hashes, items.width), combine(words.hashes, FEATURE)
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for row, at, place in _regions(words, shingles, items):
        lo, hi = int(words.bounds[row]), int(words.bounds[row + 1])
        wanted = items.sharing(place)
        most = int(items.sizes[wanted].max())
        left, right = max(lo, int(at[0]) - most), min(hi, int(at[-1]) + most + items.width)
        sums = running_sums(features[left : right - FEATURE + 1])
        for m in np.unique(items.sizes[wanted]).tolist():
            # fewer words than these can't be similar enough
            least = -(-percent * (m - items.width + 1) // 100) + items.width - 1
            start = np.arange(max(int(at[0]) - m + items.width, lo - m + least), min(int(at[-1]), hi - least) + 1)
            begin, end = np.maximum(start, lo), np.minimum(start + m, hi)
            ok = end - begin >= least
            begin, end = begin[ok], end[ok]
            for x in range(0, len(begin), STRIDE):
                b, e = begin[x : x + STRIDE], end[x : x + STRIDE]
                prints = fingerprints(sums, b - left, e - left - FEATURE + 1)
                some = np.flatnonzero(items.near(m, prints))
                for j in wanted[items.sizes[wanted] == m].tolist():
                    i = some[np.bitwise_count(prints[some] ^ items.prints[j]) <= items.radius]
                    if not len(i):
                        continue
                    similarity = weighted_similarity(shingles, b[i], e[i] - items.width + 1, items.weights[j])
                    k = int(similarity.argmax())
                    if 100 * similarity[k] >= percent and similarity[k] > best.get((row, j), (0.0, 0))[0]:
                        best[row, j] = (float(similarity[k]), int(b[i[k]] - lo))
    out: dict[int, list[tuple[int, int, float]]] = defaultdict(list)
    for (row, j), (similarity, start) in sorted(best.items()):
        out[row].append((items.ids[j], start, similarity))
    return out


def _pass(df: DataFrame, columns: list[str], text: str, items: Items, percent: int, more: bool) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(items)
    kept = [*columns, *["hits"] * more]
    body = spare(df, "text")
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(body))
    schema = T.StructType([*df.select(*[F.col(f"`{c}`") for c in columns]).schema.fields, T.StructField("hits", HITS)])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("similarity", pa.float64())]))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, body):
                found = find(LooseWords(part.column(body)), shared.value, percent)
                before = part.column("hits").to_pylist() if more else [[]] * part.num_rows
                hits = [before[i] + [{"item_id": a, "start": b, "similarity": c} for a, b, c in found.get(i, [])] for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in range(len(columns))], pa.array(hits, type=kind)], names=[*columns, "hits"])

    return source.mapInArrow(run, schema)


def with_hits(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, percent: int = 80, reach: int = 4) -> DataFrame:
    """df and ``hits``: the items found in each text, with the best window's first word and similarity."""
    need(df, text)
    need(items, item_id, item_text)
    listed = items.select(F.col(f"`{item_id}`").cast("long").alias("id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    size = listed.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = 1 + int(size) // BLOCK_BYTES
    columns = others(df, "hits")
    for b in range(blocks):
        rows = listed.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()
        df = _pass(df, columns, text, Items([(r["id"], r["text"]) for r in rows], width, reach), percent, b > 0)
    return df


def decontaminated(df: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of df without a hit, with all of df's columns."""
    safe, back = aside(df, "hits")
    return back(with_hits(safe, items, **options).where(F.size("hits") == 0))
