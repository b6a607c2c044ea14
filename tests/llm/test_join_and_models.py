"""Jaccard join, language model, WARC, segmentation, licences, toxicity."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparksieve.llm import jaccard, lm, queries
from sparksieve.llm.components import components
from sparksieve.llm.durable import scratch_path
from sparksieve.llm.jaccard import jaccard_components
from sparksieve.llm.licenses import TEMPLATES, TRIGGER, license_scan
from sparksieve.llm.segment import decode_ids, pieces, sample_segmentations, samples
from sparksieve.llm.toxicity import toxicity
from sparksieve.llm.warc import captures, deduplicate_archive, parse, read_archive, write_archive

from .common import BASE, ROWS, empty, hard, lower, shingles, words


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        least[r] = min([x for x in (least.get(r), k) if x is not None], default=None)
    return sorted(((k, len(s), least[find(i)] if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def family(seed, size, length, edits):
    rng = np.random.default_rng(seed)
    base = [f"b{seed}w{i}" for i in range(length)]
    out = []
    for c in range(size):
        w = list(base)
        for p in rng.integers(0, length, rng.integers(0, edits + 1)):
            w[p] = f"e{c}x{p}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("heavy", [3, 64])
def test_jaccard_components_match_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(jaccard, "HEAVY", heavy)
    monkeypatch.setattr(jaccard, "OFTEN", heavy)
    texts = family(1, 40, 120, 8) + family(2, 25, 60, 3) + family(3, 12, 300, 12) + [f"u{i} " * 3 + "common passage of words that many texts share here" for i in range(15)]
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(r[0], r[1]) for r in ROWS]
    got = [tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()]
    assert sorted(got, key=str) == brute_components(rows)


def test_jaccard_empty(spark):
    assert jaccard_components(empty(spark)).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100


def brute_scores(texts, train, prior):
    """id -> (tokens, known, base, score) by dictionaries of counts; the model's p(history, word); the training tokens."""
    counts = Counter(tuple(texts[k][i : i + n]) for k in train for n in (1, 2, 3) for i in range(len(texts[k]) - n + 1))
    total = sum(x for g, x in counts.items() if len(g) == 1)
    types = sum(len(g) == 1 for g in counts)

    def p(h, w):
        if not h:
            return (counts[w,] + 1) / (total + types + 1)
        return (counts[*h, w] + prior * p(h[1:], w)) / (counts[h] + prior)

    out = {}
    for k, t in texts.items():
        out[k] = (len(t), sum(counts[w,] > 0 for w in t), sum(math.log10(p((), w)) for w in t), sum(math.log10(p(tuple(t[max(0, i - 2) : i]), w)) for i, w in enumerate(t)))
    return out, p, total, counts


@pytest.mark.parametrize("chunk, part", [(1 << 12, 1 << 13), (4 << 20, 8 << 20)])
def test_language_model(spark, data, monkeypatch, chunk, part):
    """Equal to counts in dictionaries, however the texts and the keys are cut."""
    monkeypatch.setattr(lm, "CHUNK", chunk)
    monkeypatch.setattr(lm, "PART", part)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(90001, None), (90002, ""), (90003, "Unseen Word")], "doc_id long, text string"))
    rows = {r.doc_id: r for r in lm.lm_scores(docs).collect()}
    texts = {r.doc_id: [*words(lower(r.text)), "</s>"] for r in docs.collect()}
    assert rows.keys() == texts.keys()
    train = [k for k in texts if zlib.crc32(str(k).encode()) % 7 != 2]
    want, p, total, counts = brute_scores(texts, train, lm.PRIOR)
    for k, (n, known, base, score) in want.items():
        r = rows[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (k not in train, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    vocabulary = [g[0] for g in counts if len(g) == 1]
    h = next(g for g, x in counts.items() if len(g) == 2 and x > 1 and g[1] != "</s>")
    unknown = p(h, "a word that is in no text")
    assert sum(p(h, w) for w in vocabulary) + unknown == pytest.approx(1.0)


def test_language_model_edges(spark):
    assert lm.lm_scores(hard(spark)).count() == len(ROWS)
    assert lm.lm_scores(empty(spark)).count() == 0


def test_warc_round_trip_and_revisits(spark, tmp_path):
    rows = [(3, "http://a/x y", "same"), (1, "http://b/\n", "same"), (2, None, None), (5, "http://c", ""), (4, "http://d", "é" * 300_000), (6, "http://e", "WARC/1.1\r\n\r\nnot a record"), (7, "http://f", "same"), (None, "http://g", "same"), (1, "http://b/\n", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    raw, out = scratch_path(spark, "raw"), scratch_path(spark, "out")
    write_archive(captures(pages), raw, max_records=2)
    back = {r.page_id: bytes(r.payload) for r in read_archive(spark, raw).collect()}
    assert back[4] == ("é" * 300_000).encode() and back[6] == rows[5][2].encode() and back[2] == b""
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in deduplicate_archive(spark, raw, out).collect()), key=str)
    assert got == sorted([(1, "response", None, 4), (1, "response", None, 4), (3, "revisit", 1, 4), (7, "revisit", 1, 4), (None, "revisit", 1, 4), (2, "response", None, 0), (5, "revisit", 2, 0), (4, "response", None, 600_000), (6, "response", None, 24)], key=str)
    again = scratch_path(spark, "again")
    third = {(r.page_id, r.record_type, r.refers_to) for r in deduplicate_archive(spark, out, again).collect()}
    assert third == {x[:3] for x in got}, "resolving an archive that has revisits already changes nothing"


def test_warc_parse_rejects_cut_records():
    with pytest.raises(ValueError):
        list(parse(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))
    with pytest.raises(ValueError):
        list(parse(b"nonsense\r\n"))


def test_warc_empty(spark):
    raw, out = scratch_path(spark, "raw"), scratch_path(spark, "out")
    write_archive(captures(spark.createDataFrame([], "page_id long, url string, html string")), raw)
    assert deduplicate_archive(spark, raw, out).count() == 0


def test_segmentations_round_trip_and_are_distinct(spark):
    model = queries.tokenizer_path("piece_bpe_32k.model")
    out = decode_ids(sample_segmentations(hard(spark), model, k=3), model).collect()
    for r in out:
        assert r.decoded == (r.text or "").replace("▁", " ")
        assert r.log_inclusion <= 1e-12
    by = Counter((r.doc_id, r.text) for r in out)
    assert by[(4, "")] == 1 and by[(9, BASE + " tail")] == 3
    assert len({(r.doc_id, tuple(r.ids)) for r in out if r.doc_id == 9}) == 3
    assert sample_segmentations(empty(spark), model).count() == 0
    a, b = (sorted(tuple(r.ids) for r in sample_segmentations(hard(spark).repartition(n), model, k=2).collect()) for n in (1, 4))
    assert a == b, "samples do not depend on partitioning"


def test_segmentation_frequencies_follow_the_lattice():
    """First samples have the lattice's probabilities; small lattices are used up; inclusion scores add up."""
    v = pieces(queries.tokenizer_path("piece_bpe_32k.model"))
    n = 4000
    seen, prob, inclusion = Counter(), {}, Counter()
    for k, (rows, ids, cuts, logp, key, inc) in enumerate(samples(["ab in"] * n, np.arange(n, dtype=np.uint64) + np.uint64(7), 2, v)):
        for i in range(len(rows)):
            s = tuple(ids[cuts[i] : cuts[i + 1]])
            prob[s] = math.exp(logp[i])
            if k == 0:
                seen[s] += 1
            inclusion[s] += 1 / math.exp(inc[i])
    assert sum(prob.values()) == pytest.approx(1.0, abs=0.01)
    for s, p in prob.items():
        if p > 0.02:
            assert seen[s] / n == pytest.approx(p, abs=4 * math.sqrt(p / n))
            assert inclusion[s] / n == pytest.approx(1.0, abs=0.15), "each segmentation's inclusion weights average to one"
    few = list(samples(["in"], np.array([3], dtype=np.uint64), 50, v))
    assert sum(math.exp(r[3][0]) for r in few if len(r[0])) == pytest.approx(1.0)


def test_segmentation_takes_little_memory_beside_a_full_heap(spark):
    """Nearly 4 MB of different words are segmented in well under 150 MB, slice by slice; texts that nobody asked for don't come back."""
    import tracemalloc

    import pyarrow as pa

    from sparksieve.llm import segment
    from sparksieve.llm.textkit import regrouped

    model = queries.tokenizer_path("piece_bpe_32k.model")
    v, syllable = pieces(model), ["ab", "ing", "ter", "on", "the", "re", "is", "al", "co", "men"]
    word = lambda n: "".join(syllable[int(c)] for c in str(n))
    texts = [" ".join(word((i * 600 + k) * 7919 % 99991) for k in range(600)) for i in range(500)]
    batches = [pa.RecordBatch.from_pydict({"text": texts[k : k + 50]}) for k in range(0, 500, 50)]
    assert 3.8e6 < sum(map(len, texts))
    tracemalloc.start()
    try:
        n = sum(len(r[0]) for part in regrouped(iter(batches), "text", segment.SLICE) for r in samples(part.column("text").to_pylist(), np.arange(part.num_rows, dtype=np.uint64), 2, v))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 1000 and peak < 150e6, f"{peak / 1e6:.0f} MB"
    out = sample_segmentations(hard(spark), model, k=2, check=True, keep=["doc_id"])
    assert out.columns == ["doc_id", *segment.SAMPLE.names, "round_trip"]
    whole = sample_segmentations(hard(spark), model, k=2, check=True).select(out.columns)
    assert sorted(map(str, out.collect())) == sorted(map(str, whole.collect()))


def test_licences(spark):
    assert all(__import__("re").search(TRIGGER, t) for texts in TEMPLATES.values() for t in texts)
    rows = [
        ("p/LICENSE", "Licensed under the Apache License, Version 2.0."), ("p/a.txt", "plain words"), ("p/q/b.txt", "plain"), ("p/q/c.txt", "Header\nReleased under the MIT License.\nbody"),
        ("r/d.txt", "nothing"), (None, "nothing"), ("p/q/e.txt", None), ("p/q/f.txt", "the license of the driver was lost"), ("pp/g.txt", "not below p"), ("p/a.txt", "plain words"),
    ]
    df = spark.createDataFrame([(p, t, 1) for p, t in rows], "path string, text string, license int")
    got = sorted(((r.path or "", r.text or "", r.license, r.license_from) for r in license_scan(df).collect()), key=str)
    apache = ("Apache-2.0", "p/LICENSE")
    want = [("p/LICENSE", rows[0][1], "Apache-2.0", "own"), ("p/a.txt", "plain words", *apache), ("p/a.txt", "plain words", *apache), ("p/q/b.txt", "plain", *apache), ("p/q/c.txt", rows[3][1], "MIT", "own"), ("r/d.txt", "nothing", None, None), ("", "nothing", None, None), ("p/q/e.txt", "", *apache), ("p/q/f.txt", rows[7][1], *apache), ("pp/g.txt", "not below p", None, None)]
    assert got == sorted(want, key=str)
    assert license_scan(df.limit(0)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    test = labels.where("doc_id % 5 = 0").select("doc_id", F.col("toxic").alias("truth"))
    rows = toxicity(docs, labels.where("doc_id % 5 <> 0")).join(test, "doc_id").select("truth", "p_toxic", "expected_severity").collect()
    bad, good = ([r.p_toxic for r in rows if r.truth == t] for t in (1, 0))
    assert np.mean([a > b for a in bad for b in good]) > 0.97
    assert np.mean([r.expected_severity for r in rows if r.truth]) > 1.5 and all(0 <= r.expected_severity <= 3 for r in rows)
    # calibration: the share of toxic rows grows with the expected severity
    ordered = [r.truth for r in sorted(rows, key=lambda r: r.expected_severity)]
    shares = [np.mean(part) for part in np.array_split(np.array(ordered, dtype=float), 4)]
    assert shares == sorted(shares) and shares[-1] > shares[0]


def test_grades_come_from_models_that_have_not_seen_the_row():
    """Toxic rows are graded by tertiles of out-of-fold scores, so stronger ones get higher grades."""
    from sparksieve.llm.toxicity import cross_fitted_grades

    rng = np.random.default_rng(0)
    n = 600
    toxic = (np.arange(n) % 3 == 0).astype(np.int64)
    strength = np.where(toxic == 1, rng.integers(1, 9, n), 0)  # how many of ten toxic terms
    row = np.concatenate([np.repeat(np.arange(n), strength), np.arange(n)])
    term = np.concatenate([rng.integers(0, 10, strength.sum()), 10 + rng.integers(0, 10, n)])
    grade = cross_fitted_grades(row, term, np.ones(len(row)), toxic, np.arange(n) % 2 == 0, np.arange(20, dtype=np.uint64))
    assert (grade[toxic == 0] == 0).all() and set(grade[toxic == 1]) == {1, 2, 3}
    means = [strength[grade == g].mean() for g in (1, 2, 3)]
    assert means == sorted(means) and means[2] > means[0] + 2


def test_segmentations_equal_an_enumeration_of_the_lattice():
    """All segmentations of short texts, each once, with the probabilities that the pieces' weights give."""
    v = pieces(queries.tokenizer_path("piece_bpe_32k.model"))
    cost = {}
    for h, _, ids, score, *_ in v.by_length.values():
        cost |= dict(zip(ids.tolist(), score[: len(ids)].tolist()))
    text_of = {i: v.bytes[v.start[i] : v.start[i + 1]].tobytes() for i in cost}
    by_text = {}
    for i, t in text_of.items():
        by_text[t] = (i, cost[i])

    def ways(raw):
        if not raw:
            return [((), 0.0)]
        out = []
        for k in range(1, len(raw) + 1):
            if raw[:k] in by_text:
                i, c = by_text[raw[:k]]
                out += [((i, *rest), c + x) for rest, x in ways(raw[k:])]
        return out

    for seed, text in enumerate(["in", "at the", "a b", "note", "to be", "an ant"]):
        whole = {s: math.exp(x) for s, x in ways((" " + text).encode())}
        # pieces don't cross into the next word's space, so the lattice has the products of the words' segmentations
        whole = {s: p for s, p in whole.items() if all(b" " not in text_of[i].lstrip(b" ") for i in s)}
        total = sum(whole.values())
        got = {}
        for rows, ids, cuts, logp, key, _ in samples([text], np.array([seed], dtype=np.uint64), len(whole) + 5, v):
            if len(rows):
                s = tuple(ids[cuts[0] : cuts[1]].tolist())
                assert s not in got, "distinct"
                got[s] = math.exp(logp[0])
        assert got.keys() == whole.keys()
        assert all(p == pytest.approx(whole[s] / total, rel=1e-6) for s, p in got.items())


def test_licence_texts_of_a_family_are_told_apart(spark):
    """Versions, titles, wrapped headers and the clauses that licences share."""
    wrapped = "Licensed under the Apache License, Version 2.0 (the License);\n" + "\n".join("you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0".split(" "))
    cases = {
        "GNU General Public License, version 2": "GPL-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/": "Apache-2.0",
        "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "GPL-3.0",
        "All rights reserved.": None,
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "BSD-2-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "BSD-3-Clause",
        wrapped: "Apache-2.0",
    }
    filler = [(f"b/{i}.txt", f"the work and use of this or that is in a name {i} no with all version") for i in range(200)]
    df = spark.createDataFrame([*[(f"a{i}/x.txt", t) for i, t in enumerate(cases)], *filler], "path string, text string")
    got = {r.text: r.license for r in license_scan(df).where("path like 'a%'").collect()}
    assert got == cases


def test_licences_stand_empty_long_and_tied_texts(spark):
    line = "Released under the MIT License."
    rows = [("d/LICENSE", ""), ("d/LICENSE.txt", line), ("d/COPYING", line), ("d/a.txt", None), ("d/e/b.txt", "word " * 100_000), ("d/e/c.txt", "\n".join(["x"] * 5000 + [line]))]
    got = {r.path: (r.license, r.license_from) for r in license_scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["d/a.txt"] == ("MIT", "d/COPYING"), "of equal licence files the first name counts"
    assert got["d/e/b.txt"] == ("MIT", "d/COPYING") and got["d/e/c.txt"] == ("MIT", "own") and got["d/LICENSE"] == ("MIT", "d/COPYING")


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (9, 1)], "doc_id long, toxic int")
    assert toxicity(hard(spark), labels).count() == len(ROWS)
    assert toxicity(hard(spark), labels.limit(0)).count() == len(ROWS)
    assert toxicity(empty(spark), labels).count() == 0


def test_language_model_keeps_every_ngram(spark):
    """A rare sentence seen once is predicted by its trigrams, however many other words there are."""
    filler = [(i, " ".join(f"w{j}" for j in range(i * 500, i * 500 + 1000))) for i in range(70)]
    rare = "quartz violin jumps over seventeen sleepy marmots"
    mixed = " ".join(reversed(rare.split()))
    docs = spark.createDataFrame([*filler, (-1, rare), (1000, rare), (1001, mixed)], "doc_id long, text string")
    rows = {r.doc_id: r for r in lm.lm_scores(docs, test=F.col("doc_id") >= 1000).collect()}
    assert rows[1000].base_score == pytest.approx(rows[1001].base_score)
    assert rows[1000].score > rows[1001].score + 5


def test_licences_weigh_every_term_by_all_texts(spark):
    """Frequent words outside of the templates weigh little, and a licence without a match is not taken for another."""
    line = "It was released under the MIT License."
    rows = [("a/1.txt", line), ("a/2.txt", "SPDX-License-Identifier: ISC"), ("a/3.txt", "SPDX-License-Identifier: WTFPL"), ("a/4.txt", "Licensed under the GNU General Public License, version 1."), ("a/5.txt", "Licensed under the Apache License, Version 2.0.")]
    rows += [(f"b/{i}.txt", f"it was a day of version 2.0 and {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: r for r in license_scan(df).where("path like 'a/%'").collect()}
    assert [got[f"a/{i}.txt"].license for i in range(1, 6)] == ["MIT", "ISC", None, None, "Apache-2.0"]
    n = len(rows)
    df_of = lambda t: sum(t in re.findall(r"[^\W_]+(?:\.[0-9]+)*", x.lower()) for _, x in rows)
    vector = lambda text: {t: math.log((1 + n) / (1 + df_of(t))) + 1 for t in text.lower().strip(".").split()}
    a, b = vector(line), vector("released under the mit license")
    assert got["a/1.txt"].license_score == pytest.approx(sum(a[t] * b[t] for t in b) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())))
