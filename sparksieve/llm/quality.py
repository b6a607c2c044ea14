"""Quality rules with host-level verdicts (operator 10).

Per-document rules are counted in Arrow batches.  Failures are then
aggregated by host (one row a host and task after the partial aggregation, so
a host with a third of all rows is no hot key), the rates are shrunk with a
beta prior fitted to the hosts by the method of moments, and the verdicts go
back to the documents by a join on the host.

Defined results: a null or empty text has no words and fails; null hosts form
one host of their own; repeated rows count each; an empty table gives an empty
result; input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import BROADCAST_ROWS, written
from .rows import need, others, spare
from .textkit import Words, hash_spans, mix64, slices, spans, tidy

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OUTPUTS = (*COUNTS, "base_failed", "host_rate", "host_rejected", "kept")
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur elsewhere too; does it occur before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later = np.zeros(len(keys), dtype=bool)
    later[order[1:]] = same
    anywhere = later.copy()
    anywhere[order[:-1]] |= same
    return anywhere, later


def rule_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The rule counts of every text of a column."""
    w = Words(column, lower=False)
    n = len(w.counts)
    bound = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    in_row = lambda sums: sums[w.offsets[1:]] - sums[w.offsets[:-1]]
    lead = (w.buf & 0xC0) != 0x80
    chars = bound(lead)
    word_chars = bound(chars[w.ends] - chars[w.starts]) if len(w.starts) else np.zeros(1, np.int64)
    out = {"n_words": w.counts, "word_chars": word_chars[w.bounds[1:]] - word_chars[w.bounds[:-1]], "n_symbols": in_row(bound(_SYMBOL[w.buf]))}

    starts, ends = spans(w.buf, w.offsets, w.buf != 0x0A)
    if len(starts):
        at = np.searchsorted(w.starts, starts)
        full = (at < len(w.starts)) & (w.starts[np.minimum(at, len(w.starts) - 1)] < ends) if len(w.starts) else np.zeros(len(starts), bool)
        starts, ends = starts[full], ends[full]
    row = np.searchsorted(w.offsets, starts, side="right") - 1
    with np.errstate(over="ignore"):
        keys = mix64(hash_spans(w.buf, starts, ends) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out["n_dup_lines"] = np.bincount(row[_again(keys)[1]], minlength=n) if len(keys) else np.zeros(n, np.int64)

    rows, h = w.rows, w.hashes
    covered = np.zeros(len(h), dtype=bool)
    if len(h) >= 3:
        with np.errstate(over="ignore"):
            keys = mix64(mix64(mix64(h[:-2] + rows[:-2].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) + h[1:-1]) * np.uint64(3) + h[2:])
        at = np.flatnonzero(rows[:-2] == rows[2:])
        hit = at[_again(keys[at])[0]]
        for k in range(3):
            covered[hit + k] = True
    out["n_repeat_words"] = np.bincount(rows[covered], minlength=n)
    return {k: out[k].astype(np.int64) for k in COUNTS}


def with_rule_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df and the five rule counts of its text column, in one pass without a shuffle."""
    need(df, text)
    kept, body = others(df, *COUNTS), spare(df, "text")
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(body))
    schema = df.select(*[F.col(f"`{c}`") for c in kept], *[F.lit(0).cast("long").alias(c) for c in COUNTS]).schema

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, body):
                counts = rule_counts(part.column(body))
                columns = [part.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(counts[c]) for c in COUNTS]], names=[*kept, *COUNTS])

    return source.mapInArrow(run, schema)


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    """The document rules: too short, or mostly repeated three-word windows."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def host_verdicts(per_host: DataFrame, reject_rate: float = 0.5) -> DataFrame:
    """Shrunk failure rate and verdict of every row of (host, host_n, host_failures).

    The beta prior has the mean m and variance v of the hosts' raw rates
    (unweighted); its strength m(1-m)/v - 1 is held within [1, 1e6], and is 1e6
    when the rates do not vary.  A host is rejected when its shrunk rate
    (failures + strength*m) / (n + strength) is above ``reject_rate``.
    """
    rate = F.col("host_failures") / F.col("host_n")
    prior = per_host.agg(F.avg(rate).alias("__m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("__v"))
    spread = F.col("__m") * (1 - F.col("__m"))
    strength = F.when(F.col("__v") <= spread / 1e6, F.lit(1e6)).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(1e6), spread / F.col("__v") - 1)))
    shrunk = (F.col("host_failures") + strength * F.col("__m")) / (F.col("host_n") + strength)
    # the prior is an aggregate of one row: its size is proven
    return per_host.join(F.broadcast(prior)).select("host", "host_n", "host_failures", shrunk.alias("host_rate"), (shrunk > reject_rate).alias("host_rejected"))


def quality_rules(df: DataFrame, host: str | Column = "source", text: str = "text", reject_rate: float = 0.5) -> DataFrame:
    """df with the rule counts, base_failed, host_rate, host_rejected and kept.

    The verdicts are broadcast only while a count shows that the hosts are
    few; beyond that the join shuffles, and AQE splits a hot host.
    """
    need(df, text)
    of_host = (F.col(f"`{host}`") if isinstance(host, str) else host).cast("string")
    columns, own, other = others(df, *OUTPUTS), spare(df, "host"), spare(df, "of")
    flags = with_rule_counts(df.select(of_host.alias("__host"), F.col(f"`{text}`").alias("__t")), "__t").withColumn("f", base_failed())
    per_host = written(flags.groupBy(F.col("__host").alias("host")).agg(F.count(F.lit(1)).alias("host_n"), F.sum(F.col("f").cast("long")).alias("host_failures")), "hosts")
    verdict = host_verdicts(per_host, reject_rate).select(F.col("host").alias(other), "host_rate", "host_rejected")
    if per_host.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        verdict = F.broadcast(verdict)
    kept_text = [c for c in columns if c != text]
    counted = with_rule_counts(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept_text, text])], of_host.alias(own)), text).withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False))
    joined = counted.join(verdict, F.col(own).eqNullSafe(F.col(other)), "left")
    return joined.select(*[F.col(f"`{c}`") for c in columns], *COUNTS, "base_failed", "host_rate", "host_rejected", kept.alias("kept"))
