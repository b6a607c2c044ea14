"""Line dedup by overlapping three-line windows (operator 1).

Every run of three consecutive non-blank lines is hashed, twice and independently,
to 128 bits; windows found more
than once in the corpus are resolved globally: the first occurrence by
(document id, position) stays, and the lines that any later occurrence covers
are removed, overlapping occurrences being merged.

Counting the windows keeps one row a distinct window and task, so a window in a
third of all documents is no hot key; the join back of the repeated windows
is an ordinary shuffle join whose skewed side AQE can split.

Defined results: lines are compared as they stand, blank lines (only white
space) are no part of a window and stay; a text with fewer than three
non-blank lines has no window; a null text stays null and an empty one empty;
null document ids come first in the order; rows equal in id and text are one
occurrence and are treated alike; an empty table gives an empty result; input
columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .durable import written
from .rows import need, others, spare
from .textkit import combine, hash_spans, raw_bytes, signed, slices, spans, tidy, _IS_WORD

_WINDOWS = T.StructType([T.StructField("id", T.LongType()), T.StructField("row", T.LongType()), T.StructField("h", T.LongType()), T.StructField("g", T.LongType()), T.StructField("pos", T.IntegerType())])


def _lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each non-blank line: its row, its number among its row's non-blank lines, and two hashes."""
    buf, offsets = raw_bytes(column)
    starts, ends = spans(buf, offsets, buf != 0x0A)
    word = np.concatenate([[0], np.cumsum(_IS_WORD[buf])])
    full = word[ends] > word[starts]
    starts, ends = starts[full], ends[full]
    row = np.searchsorted(offsets, starts, side="right") - 1
    number = np.arange(len(row)) - np.searchsorted(row, row)
    return row, number, hash_spans(buf, starts, ends), hash_spans(buf, starts, ends, 1)


def windows(docs: DataFrame, width: int = 3) -> DataFrame:
    """(id, row, h, g, pos) of every window of (id, row, text); (h, g) stand for its lines."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, number, h, g = _lines(part.column("text"))
                n = max(0, len(row) - width + 1)
                at = np.flatnonzero(row[:n] == row[width - 1 :][:n])
                rows = pa.array(row[at])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(rows), part.column("row").take(rows), pa.array(signed(combine(h, width)[at])), pa.array(signed(combine(g, width)[at])), pa.array(number[at].astype(np.int32))],
                    schema=pa.schema([("id", pa.int64()), ("row", pa.int64()), ("h", pa.int64()), ("g", pa.int64()), ("pos", pa.int32())]),
                )

    return docs.mapInArrow(run, _WINDOWS)


def removed_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """(id, row, gone): the starts of the later occurrences of repeated windows, a row a document."""
    found = windows(docs, width)
    repeated = written(
        found.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "pos", "row")).alias("first")).where("n > 1").select("h", "g", "first"),
        "windows",
    )
    later = found.join(repeated, ["h", "g"]).where(~F.struct("id", "pos", "row").eqNullSafe(F.col("first")))
    return later.groupBy("id", "row").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def strip_lines(text: str, gone: list[int], width: int) -> tuple[str, int]:
    """text without the non-blank lines that the windows starting at ``gone`` cover, and their number."""
    covered = {p + k for p in gone for k in range(width)}
    kept, number = [], -1
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            number += 1
            if number in covered:
                continue
        kept.append(line)
    return "\n".join(kept), len(covered)


def line_dedup(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """df with its text stripped of repeated passages, and n_removed_lines.

    A text of which nothing but blank lines is left becomes what is left; the
    caller decides whether such a row stays.
    """
    need(df, id, text)
    out = others(df, "n_removed_lines")
    own, hash_, gone_id, gone_hash, starts = (spare(df, n) for n in ("id", "key", "gid", "grow", "gone"))
    key, of = F.xxhash64(F.col(f"`{text}`")), F.col(f"`{id}`").cast("long")
    gone = removed_lines(df.select(of.alias("id"), key.alias("row"), F.col(f"`{text}`").alias("text")), width).select(F.col("id").alias(gone_id), F.col("row").alias(gone_hash), F.col("gone").alias(starts))
    rows = df.select(*[F.col(f"`{c}`") for c in out], of.alias(own), key.alias(hash_))
    joined = rows.join(gone, F.col(own).eqNullSafe(F.col(gone_id)) & (F.col(hash_) == F.col(gone_hash)), "left").select(*[F.col(f"`{c}`") for c in out], starts)
    schema = T.StructType([*df.select(*[F.col(f"`{c}`") for c in out]).schema.fields, T.StructField("n_removed_lines", T.LongType())])
    at = out.index(text)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(len(out))]
            removed = np.zeros(batch.num_rows, dtype=np.int64)
            lists = batch.column(len(out))
            hit = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                texts = columns[at].to_pylist()
                for i in hit:
                    texts[i], removed[i] = strip_lines(texts[i], lists[int(i)].as_py(), width)
                columns[at] = pa.array(texts, type=columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed)], names=[*out, "n_removed_lines"])

    return joined.mapInArrow(run, schema)
