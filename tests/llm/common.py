"""Texts that every operator must stand, and brute-force helpers."""

import re

SCHEMA = "doc_id long, text string, source string, __x int, hits int, kept string, n_tokens int"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
BASE = " ".join(f"alpha{i}" for i in range(60))

#: Nulls in every column, empty and very long texts, repeated rows, repeated ids.
ROWS = [
    (1, BASE, "a", 1, 1, "x", 1),
    (2, BASE, "a", None, None, None, None),
    (2, BASE, "a", None, None, None, None),
    (3, None, "a", 1, 1, "x", 1),
    (None, "one two three", None, 1, 1, "x", 1),
    (None, None, None, None, None, None, None),
    (4, "", "b", 1, 1, "x", 1),
    (5, " \n\t ", "b", 1, 1, "x", 1),
    (6, LONG, "b", 1, 1, "x", 1),
    (7, "x" * 200_000, "b", 1, 1, "x", 1),
    (8, "ÄÖ é  ₿ ▁ \r\n tab\there", "c", 1, 1, "x", 1),
    (9, BASE + " tail", "c", 1, 1, "x", 1),
    (10, "same\nsame\nsame\nsame", "c", 1, 1, "x", 1),
    (7, "another text under an id that is taken", "c", 1, 1, "x", 1),
]


def hard(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, n=5):
    w = words(lower(text))
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
