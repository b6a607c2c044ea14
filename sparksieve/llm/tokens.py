"""Token counts without the tokens (operator 5).

An Arrow function cuts every text at safe boundaries, encodes each distinct
segment of a byte-balanced batch once with the tokenizer's own
``encode_batch``, and returns lengths only: no ids cross to the JVM, and there
is no shuffle.

Safe boundaries.  The byte-level pre-tokenizer never lets a token run from a
non-space character into a following space, and a single look-ahead decides
only about runs of white space; so a cut before a space that follows a
non-space character leaves every token as it is.  A text is cut at every such
place, so even a very long text reaches the tokenizer in small segments.  A
tokenizer of another kind (``split=False``) gets whole texts.

Defined results: null and empty texts have 0 bytes and 0 tokens; a special
token's string inside a text counts as the library counts it by default;
repeated rows count each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import need, others, spare
from .textkit import regrouped, tidy

#: Distinct segments a worker remembers (the first it meets, so the frequent ones), and the longest; about 100 MB.
MEMO, MEMO_CHARS = 600_000, 48
#: Text bytes of a slice, within which a segment is encoded once.
SLICE = 12 << 20
#: Segments handed to the library at once.
BATCH_BYTES = 256 << 10
_ODD = r"  |\s [^ ]|^ "


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return lambda texts: [len(x.ids) for x in loaded.encode_batch_fast(texts, add_special_tokens=False)]


def segments(text: str) -> list[str]:
    """text cut before every space that follows a non-space character."""
    return re.split(r"(?<=\S)(?= )", text)


def encoded_lengths(texts: list[str], path: str) -> list[int]:
    """Token counts of the texts, encoded in batches of about BATCH_BYTES."""
    encode, out, at = _tokenizer(path), [], 0
    while at < len(texts):
        to, room = at, BATCH_BYTES
        while to < len(texts) and (to == at or room > 0):
            room -= len(texts[to])
            to += 1
        out += encode(texts[at:to])
        at = to
    return out


class Counter:
    """Counts tokens of Arrow string columns, remembering the segments seen."""

    def __init__(self, path: str, split: bool):
        self.path, self.split, self.memo = path, split, {}

    def _lookup(self, distinct: list[str]) -> np.ndarray:
        known = [self.memo.get(x, -1) for x in distinct]
        out = np.array(known, dtype=np.int64)
        at = np.flatnonzero(out < 0)
        new = [distinct[i] for i in at]
        out[at] = lengths = encoded_lengths(new, self.path)
        room = max(0, MEMO - len(self.memo))
        self.memo.update((x, n) for x, n in zip(new[:room], lengths[:room]) if len(x) <= MEMO_CHARS)
        return out

    def __call__(self, column: pa.Array) -> np.ndarray:
        texts = pc.fill_null(column, "")
        if not self.split:
            return np.array(encoded_lengths(texts.to_pylist(), self.path), dtype=np.int64)
        # texts with single inner spaces only are cut in C++; the others by the regular expression
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        out = np.zeros(len(texts), dtype=np.int64)
        plain = texts.filter(pa.array(~odd))
        if len(plain):
            parts = pc.split_pattern(plain, " ")
            bounds = parts.offsets.to_numpy()
            codes = parts.flatten().dictionary_encode()
            words = codes.dictionary.to_pylist()
            at = codes.indices.to_numpy()
            spaced = self._lookup([f" {w}" for w in words])[at]
            first = bounds[:-1]
            heads = self._lookup(list(dict.fromkeys(lead := [words[i] for i in at[first - bounds[0]]])))
            of = dict(zip(dict.fromkeys(lead), heads))
            spaced[first - bounds[0]] = [of[x] for x in lead]
            out[~odd] = np.add.reduceat(spaced, first - bounds[0])
        for i in np.flatnonzero(odd):
            cut = segments(texts[int(i)].as_py())
            each = dict(zip(distinct := list(dict.fromkeys(cut)), self._lookup(distinct)))
            out[i] = sum(int(each[x]) for x in cut)
        return out


def with_token_counts(df: DataFrame, tokenizer: str, text: str = "text", split: bool | None = None, over: int = 512) -> DataFrame:
    """df with n_bytes, n_tokens and over_limit (n_tokens > ``over``).

    ``tokenizer`` is the path of a .json or .model file; the executors read it.
    ``split`` defaults to true for .json files, whose pre-tokenizer must be the
    byte-level one.
    """
    need(df, text)
    split = tokenizer.endswith(".json") if split is None else split
    kept, body = others(df, "n_bytes", "n_tokens", "over_limit"), spare(df, "text")
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(body))
    schema = df.select(*[F.col(f"`{c}`") for c in kept], F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens"), F.lit(True).alias("over_limit")).schema

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer, split)
        for part in regrouped(batches, body, SLICE):
            texts = part.column(body)
            tokens = counter(texts)
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(kept))], size, pa.array(tokens), pa.array(tokens > over)], names=[*kept, "n_bytes", "n_tokens", "over_limit"])

    return source.mapInArrow(run, schema)
