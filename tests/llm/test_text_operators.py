"""Quality rules, token counts, line dedup, decontamination against brute force."""

from collections import Counter

import pytest

from sparksieve.llm import queries
from sparksieve.llm.decontam import Items, LooseWords, decontaminated, find, with_hits
from sparksieve.llm.linededup import line_dedup
from sparksieve.llm.quality import quality_rules
from sparksieve.llm.tokens import segments, with_token_counts

from .common import BASE, ROWS, empty, hard, words


def brute_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_match_brute_force(spark):
    got = [tuple(r) for r in quality_rules(hard(spark)).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()]
    assert sorted(got) == sorted(brute_counts(r[1]) for r in ROWS)


def test_quality_keeps_columns_and_replaces_outputs(spark):
    out = quality_rules(hard(spark))
    assert out.columns.count("kept") == 1 and dict(out.dtypes)["kept"] == "boolean"
    assert {"__x", "hits"} <= set(out.columns)
    assert out.count() == len(ROWS) and quality_rules(empty(spark)).count() == 0


def test_host_verdict_rejects_bad_hosts_only(spark):
    rows = [(i, "short", "bad") for i in range(40)] + [(100, BASE, "bad")] + [(200 + i, BASE + f" {i}", f"h{i % 4}") for i in range(80)]
    out = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not out[100].kept and out[100].host_rejected
    assert all(out[200 + i].kept for i in range(80))


def test_token_counts_equal_the_library(spark, data):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    odd = ["a  b", " lead", "trail ", "a\n b", "a \n b", "x<|endoftext|>y <|endoftext|>", "it's  they'll\t\tgo", "   x", "a\x1c b", "  ", "\n\n", "ß 12 3.4"]
    rows = [(i, t) for i, t in enumerate([*odd, *[r[1] for r in ROWS]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"))
    got = with_token_counts(docs, path).collect()
    for r in got:
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids), r.text
        assert r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 512)
    assert with_token_counts(empty(spark), path).count() == 0


def test_sentencepiece_counts(spark):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t for t in (r[1] for r in ROWS) if t is None or len(t) < 10_000]
    got = with_token_counts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), path).collect()
    assert all(r.n_tokens == len(library.encode(r.text or "")) for r in got)


@pytest.mark.parametrize("text", ["", "a", "a b", "a  b", " a b "])
def test_segments_join_to_the_text(text):
    assert "".join(segments(text)) == text


def test_line_dedup_small_cases(spark):
    body = "l one\nl two\nl three\nl four"
    rows = [(1, body), (2, "head\n" + body + "\ntail"), (3, None), (4, ""), (5, "l one\nl two"), (6, "p\np\np\np\np"), (7, "l two\n\nl three\n \nl four")]
    out = {r.doc_id: (r.text, r.n_removed_lines) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == (body, 0) and out[2] == ("head\ntail", 4)
    assert out[3] == (None, 0) and out[4] == ("", 0) and out[5] == ("l one\nl two", 0)
    assert out[6] == ("p", 4), "the first window stays but for the lines that later ones cover"
    assert out[7] == ("\n ", 3)


def test_line_dedup_stands_hard_rows(spark):
    out = line_dedup(hard(spark))
    assert out.count() == len(ROWS) and {"__x", "hits", "kept"} <= set(out.columns)
    assert line_dedup(empty(spark)).count() == 0


def test_decontamination_finds_what_brute_force_finds(spark):
    item = " ".join(f"w{i}" for i in range(50))
    edited = item.replace("w20 ", "zzz ")
    far = item.replace("w20 ", "zzz ").replace("w35 ", "yyy ")
    lead = " ".join(f"q{i}" for i in range(30))
    docs = [(1, f"{lead} {item} {lead}"), (2, f"{lead}\n{edited.upper()}, {lead}"), (3, f"{lead} {far}"), (4, lead), (5, None), (6, ""), (7, item), (8, "w1 w2 w3")]
    items = [(1, item), (2, "too short"), (3, None), (4, ""), (None, lead)]
    found = with_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    hits = {r.doc_id: {h.item_id: round(h.similarity, 3) for h in r.hits} for r in found}
    assert hits[1] == {1: 1.0, None: 1.0} and hits[7] == {1: 1.0} and hits[4] == {None: 1.0}
    assert hits[2] == {1: round(41 / 51, 3), None: 1.0}
    assert 1 not in hits[3] and hits[5] == {} and hits[6] == {} and hits[8] == {}


def test_decontamination_recall_on_the_tables(spark, data):
    """Brute force over all item-sized windows finds no item that the operator misses."""
    import pyarrow as pa

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    got = {(r.doc_id, h.item_id) for r in with_hits(docs, items).collect() for h in r.hits}

    def tokens(text):
        w = LooseWords(pa.array([text]))
        return [w.text(i) for i in range(len(w.starts))]

    want = set()
    known = [(r.item_id, tokens(r.text)) for r in items.collect()]
    for r in docs.collect():
        w = tokens(r.text)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        index = set(grams)
        for item, t in known:
            own = Counter(tuple(t[i : i + 5]) for i in range(len(t) - 4))
            if not index & set(own):
                continue
            for i in range(5 - len(t), len(w) - 4):  # windows that the text's ends cut too
                win = Counter(grams[max(i, 0) : max(i + len(t) - 4, 0)])
                both = sum((win & own).values())
                if 100 * both >= 80 * (sum(win.values()) + sum(own.values()) - both):
                    want.add((r.doc_id, item))
    assert want and got == want


def test_decontamination_edges(spark):
    items = spark.createDataFrame([(1, BASE)], "item_id long, text string")
    out = with_hits(hard(spark), items)
    assert out.count() == len(ROWS) and out.columns.count("hits") == 1
    assert {r.doc_id for r in out.where("size(hits) > 0").collect()} == {1, 2, 9}
    assert decontaminated(hard(spark), items).count() == len(ROWS) - 4
    assert with_hits(empty(spark), items).count() == 0
    assert with_hits(hard(spark), items.limit(0)).where("size(hits) > 0").count() == 0


def test_decontamination_radius_covers_edited_and_cut_passages():
    """Of passages edited, or cut by the text's end, to a similarity of 0.8 to 0.83, hardly any is missed by the radius."""
    import numpy as np
    import pyarrow as pa

    rng, missed, tried = np.random.default_rng(5), 0, 0
    for n in (22, 31, 45, 59, 120):
        for _ in range(60):
            item = [f"w{x}" for x in rng.integers(0, 10**9, n)]
            items = Items([(1, " ".join(item))], 5, 4)
            most = int((n - 4) / 9)  # changed shingles at similarity 0.8
            edge = [*item[: n - most], *[f"x{x}" for x in rng.integers(0, 10**9, most)]]
            cut = item[: n - max(1, int(0.19 * (n - 4)))]
            lead = [f"l{x}" for x in rng.integers(0, 10**9, 40)]
            for text in ([*lead, *edge, *lead], [*lead, *cut], cut, [*edge[::-1][:0], *edge]):
                got = find(LooseWords(pa.array([" ".join(text)], type=pa.large_string())), items, 80)
                tried += 1
                missed += not got
    assert tried == 1200 and missed <= 3


def test_operators_stand_columns_named_like_their_own(spark):
    """Columns that operators might use inside, or that differ from an output in case only, pass through or are replaced."""
    from sparksieve.llm.licenses import license_scan
    from sparksieve.llm.segment import sample_segmentations
    from sparksieve.llm.toxicity import toxicity

    names = ["__text", "__text_", "__seed", "__host", "__of", "__t", "__h", "__dir", "__file", "__key", "__near", "ids", "sample", "key", "f", "Hits", "N_WORDS"]
    df = spark.createDataFrame([(i, BASE, "h", "a/b.txt", *[1] * len(names)) for i in range(3)], "doc_id long, text string, source string, path string, " + ", ".join(f"`{n}` int" for n in names))
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, BASE)], "item_id long, text string")
    piece = queries.tokenizer_path("piece_bpe_32k.model")
    outs = [with_hits(df, items), with_token_counts(df, piece), quality_rules(df), sample_segmentations(df, piece, k=1), toxicity(df, labels), license_scan(df)]
    for out in outs:
        assert out.count() == 3 and {"__text", "__host", "__seed"} <= set(out.columns)
        assert len({c.lower() for c in out.columns}) == len(out.columns)
