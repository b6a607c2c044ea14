"""Conversation repair against a search over all edits, and its parallel parts against walks in one piece."""

import hashlib
import re
import zlib
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparksieve.llm import conversations as cv
from sparksieve.llm import queries

SEEN = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        role, text = show(role), show(text)
        k = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out += [(conv, turn, role, text)] * (2 if k == 3 else 1)
    return out


def faults(rows):
    """ok, truncated, blank or duplicate, of a conversation's (role, text) in order."""
    out, seen = [], set()
    for role, text in rows:
        if not SEEN.search(text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("ok" if SEEN.findall(text)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def best(rows):
    """(cost, audit, repaired turns) of the cheapest repair with the least audit, by recursion over all edits, at most three insertions at a place."""
    kinds = faults(rows)
    ends = {"", "s", "u", "a"}

    def after(state, c):
        if c == "s":
            return "s" if state == "" else None
        if c == "u":
            return "u" if state in ("", "s", "a") else None
        return "a" if c == "a" and state == "u" else None

    @cache
    def go(i, state, room):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        if room:
            for c, name in (("u", "user"), ("a", "assistant")):
                if (to := after(state, c)) is not None and (r := go(i, to, room - 1)):
                    found.append((r[0] + 3, "I" + r[1], (f"{name}:", *r[2])))
        if i < len(rows):
            role, text = rows[i]
            if r := go(i + 1, state, 3):
                found.append((r[0] + 4, "D" + r[1], r[2]))
            if kinds[i] in ("ok", "truncated"):
                more = 3 * (kinds[i] == "truncated")
                if (to := after(state, role[:1])) is not None and (r := go(i + 1, to, 3)):
                    found.append((r[0] + more, "K" + r[1], (f"{role}:{text}", *r[2])))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if (to := after(state, c)) is not None and (r := go(i + 1, to, 3)):
                        found.append((r[0] + more + 3, "R" + r[1], (f"{name}:{text}", *r[2])))
        return min(found) if found else None

    assert ends
    for i in range(len(rows), -1, -1):  # shallow recursion
        for s in ("", "s", "u", "a"):
            for room in range(4):
                go(i, s, room)
    return go(0, "", 3)


def brute(rows, originals):
    out = []
    for conv in {r[0] for r in originals}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2][:64], r[3][:64]))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        kinds = faults([(r[2], r[3]) for r in own])
        firsts = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
        cost, audit, turns = best([(r[2], r[3]) for r in own])
        out.append((conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest()))
    return out


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    return sorted(([r[n] for n in NAMES] for r in rows), key=str)


def test_query_equals_brute_force(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert plain(queries.op13_conversation_repair(spark, data).collect()) == sorted(map(list, brute(damaged(rows), rows)), key=str)


def hard_rows():
    rng = np.random.default_rng(1)
    rows = [(None, None, None, None)] * 3 + [(None, 1, "user", "Hi."), (1, None, "user", "A?"), (1, 5, "assistant", "B!"), (1, 5, "assistant", "B!"), (1, 9, "", "text"), (2, 1, "system", ""), (3, 1, "tool", "x" * 200_000 + ".")]
    rows += [(4, t, ["user", "assistant", "system", "tool", "User"][rng.integers(5)], ["Yes.", "No", " \n", "Well?", f"{t}."][rng.integers(5)]) for t in range(60)]
    rows += [(5, t, "tool", f"t{t}.") for t in range(45)]  # no two paths ever meet
    rows += [(6, t, ["user", "assistant"][t % 2], f"t{t}.") for t in range(70)]
    rows += [(7, t, "user", " ") for t in range(40)] + [(8, t, "user", f"u{t}.") for t in range(33)]
    return rows


@pytest.mark.parametrize("chunk, fixups", [(1, 1), (2, 2), (4, 40), (128, 4)])
def test_chunks_are_stitched(spark, chunk, fixups):
    rows = hard_rows()
    want = sorted(map(list, brute([tuple(" " if x is None and i > 1 else x for i, x in enumerate(r)) for r in rows], rows)), key=str)
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", audit int").repartition(3)
    assert plain(cv.repair_report(df, chunk=chunk, fixups=fixups).collect()) == want


def test_turns_are_the_repaired_conversation(spark):
    rows = [(1, 0, "assistant", "No."), (1, 1, "user", "Hm?"), (1, 2, "user", ""), (2, 0, "system", "S."), (2, 1, "user", "cut")]
    got = [(r.conv_id, r.edit, r.role, r.text) for r in cv.repaired_turns(spark.createDataFrame(rows, SCHEMA), chunk=2).orderBy("conv_id", "position").collect()]
    for conv in (1, 2):
        own = [(r[2], r[3]) for r in rows if r[0] == conv]
        cost, audit, turns = best(own)
        assert "".join(e for c, e, _, _ in got if c == conv) == audit
        assert tuple(f"{r}:{t}" for c, e, r, t in got if c == conv and e != "D") == turns


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert not cv.repair_report(none).collect() and not cv.repaired_turns(none).collect()
    got = cv.repair_report(none, of=spark.createDataFrame([(1, 1, "user", "x")], SCHEMA)).first()
    assert tuple(got) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


symbol = st.tuples(st.integers(0, 3), st.integers(0, 3)).map(lambda p: chr(ord("a") + p[0] * 4 + p[1]))


@settings(max_examples=200, deadline=None)
@given(st.lists(symbol, min_size=1, max_size=30).map("".join), st.lists(st.integers(0, 9), min_size=4, max_size=4))
def test_rerun_equals_a_fresh_run(symbols, end):
    codes, old, new = cv.codes_of([symbols]), cv.END[None, :], np.array([end])
    assert (cv.rerun(codes, old, new, cv.backward(codes, old)[0]) == cv.backward(codes, new)[0]).all()


def test_ranks_converge():
    """Alternating turns bring the paths together at once: the outcome of another end vector differs by a constant only."""
    codes = cv.codes_of(["ei" * 20])
    outcomes = [cv.level(cv.backward(codes, np.array([v]))[0]).tolist() for v in ([0, 6, 3, 0], [0, 0, 0, 0], [5, 1, 0, 7])]
    assert outcomes[0] == outcomes[1] == outcomes[2]
