"""The backoff automaton of operator 9: its states, arcs, failure weights and traversal, against counts by plain Python."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparksieve.llm import lm

TRAIN = ["a b a b c", "b a b", "c c a b a", "", "a"]
ASK = [*TRAIN, "a b x b a", "x y", "c a b c b a a b", "b b b b c c c a a", "y"]
PRIOR = 3.0
END = "</s>"


def words(text):
    return [*text.split(), END]


def counted():
    """Training occurrences of every n-gram."""
    return Counter(tuple(w[i : i + n]) for w in map(words, TRAIN) for n in (1, 2, 3) for i in range(len(w) - n + 1))


def chunk():
    """(row, places, counts, names) of the automaton over ASK: names[n] has the n-gram of each number."""
    texts = pa.array(ASK)
    row, found = lm.grams(texts, 3)
    flat = [w for t in ASK for w in words(t)]
    c, counts, names = counted(), [], [[()]]
    for n, (last, key) in enumerate(found, 1):
        distinct, first = np.unique(key, return_index=True)
        own = [tuple(flat[i - n + 1 : i + 1]) for i in last[first]]
        names.append(own)
        counts.append(np.array([c[g] for g in own], dtype=np.int64))
    return texts, counts, names


def size(c):
    return sum(v for g, v in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)


def probability(c, g):
    total, types = size(c)
    if len(g) == 1:
        return (c[g] + 1) / (total + types + 1)
    return (c[g] + PRIOR * probability(c, g[1:])) / (c[g[:-1]] + PRIOR)


def automaton():
    texts, counts, names = chunk()
    _, places = lm.numbered(texts, counts)
    return lm.built(places, counts, *size(counted()), PRIOR), places, names


def test_states_arcs_and_failure_weights():
    a, _, names = automaton()
    c = counted()
    for n in (1, 2, 3):
        assert a.exists[n].tolist() == [c[g] > 0 for g in names[n]]
        for i, g in enumerate(names[n]):
            if a.exists[n][i] or n == 1:
                assert abs(a.arc[n][i] - math.log10(probability(c, g))) < 1e-12
            if n < 3 and a.exists[n][i]:
                assert abs(a.failure[n][i] - math.log10(PRIOR / (c[g] + PRIOR))) < 1e-12


def test_arcs_and_what_passes_the_failure_arc_sum_to_one():
    """From every state: the words with an arc, and the others by way of the failure arcs."""
    a, _, names = automaton()
    c = counted()
    vocabulary = [g[0] for g in c if len(g) == 1]
    number = [{g: i for i, g in enumerate(own)} for own in names]

    def leaves(h, w):
        """log10 p of a word from a state, by arcs and failure arcs alone."""
        if h + (w,) in number[len(h) + 1] and c[h + (w,)]:
            return a.arc[len(h) + 1][number[len(h) + 1][h + (w,)]]
        if not h:
            return -math.log10(sum(size(c)) + 1)
        return a.failure[len(h)][number[len(h)][h]] + leaves(h[1:], w)

    states = [h for n in (1, 2) for h in names[n] if c[h] and END not in h]
    assert len(states) == 8
    for h in [(), *states]:
        # one unknown word has what is left
        assert abs(sum(10 ** leaves(h, w) for w in [*vocabulary, "unknown"]) - 1) < 1e-12


def walk(text):
    """log10 p by carrying the longest context that occurs."""
    c, total, h = counted(), 0.0, ()
    for w in words(text):
        total += math.log10(probability(c, (*h, w)))
        h = (*h, w)[-2:]
        while h and not c[h]:
            h = h[1:]
    return total


@pytest.mark.parametrize("piece", [1, 2, 3, 256])
def test_traversal_equals_a_walk_and_pieces_change_nothing(monkeypatch, piece):
    monkeypatch.setattr(lm, "PIECE", piece)
    texts, counts, _ = chunk()
    n, known, base, score = lm.score_chunk(texts, counts, *size(counted()), PRIOR)
    assert n.tolist() == [len(words(t)) for t in ASK]
    assert np.allclose(score, [walk(t) for t in ASK], atol=1e-12)
    c = counted()
    assert known.tolist() == [sum(c[(w,)] > 0 for w in words(t)) for t in ASK]
    assert np.allclose(base, [sum(math.log10(probability(c, (w,))) for w in words(t)) for t in ASK], atol=1e-12)
