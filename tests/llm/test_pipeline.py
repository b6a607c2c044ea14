"""The registered queries and the pipeline over small tables, and SQL where there is some."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparksieve.llm import queries

from .common import BASE, ROWS, SCHEMA, hard, lower, shingles, words
from .test_text_operators import brute_counts

TABLES = ["documents", "pages", "benchmark", "labels"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, data)
    names = sorted(got.columns)
    assert sorted(want.columns) == names
    key = lambda rows: sorted(map(str, rows))
    assert key(tuple(r[n] for n in names) for r in got.collect()) == key(tuple(r[want.columns.index(n)] for n in names) for r in want.fetchall())


def test_stages(spark, data):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "decontamination", "segmentation"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    left = corpus_pipeline.run(spark, data).select("doc_id").distinct().count()
    assert 0 < left < docs.count()


def test_stages_return_document_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()


def brute_stage(name, rows, items):
    """(doc_id, text) that a stage keeps of (doc_id, text, source) rows, by plain Python."""
    if name == "quality_rules":
        failed = [n < 50 or 100 * rep > 50 * n for n, _, _, _, rep in (brute_counts(t) for _, t, _ in rows)]
        hosts = {h: [f for f, (_, _, x) in zip(failed, rows) if x == h] for h in {r[2] for r in rows}}
        rates = [sum(v) / len(v) for v in hosts.values()]
        mean = sum(rates) / len(rates)
        var = sum((r - mean) ** 2 for r in rates) / len(rates)
        strength = 1e6 if var <= mean * (1 - mean) / 1e6 else max(1.0, min(1e6, mean * (1 - mean) / var - 1))
        bad = {h for h, v in hosts.items() if (sum(v) + strength * mean) / (len(v) + strength) > 0.5}
        return [(i, t) for f, (i, t, h) in zip(failed, rows) if not f and h not in bad]
    if name == "line_dedup":
        order = sorted({(r[0] is not None, r[0] or 0, r[1]) for r in rows if r[1]})
        seen, gone = {}, {}
        for key in order:
            lines = [x for x in key[2].split("\n") if words(x)]
            for p in range(len(lines) - 2):
                if seen.setdefault(tuple(lines[p : p + 3]), (key[:2], p)) != (key[:2], p):
                    gone.setdefault(key, set()).update({p, p + 1, p + 2})
        out = []
        for i, t, _ in rows:
            drop, n, kept = gone.get((i is not None, i or 0, t), set()), -1, []
            for line in (t or "").split("\n"):
                n += bool(words(line))
                if not (words(line) and n in drop):
                    kept.append(line)
            out.append((i, "\n".join(kept) if t is not None else None))
        return out
    grams = lambda t: {tuple(w[k : k + 5]) for w in [re.findall(r"[a-z0-9\x80-\U0010ffff]+", lower(t))] for k in range(len(w) - 4)}
    return [(i, t) for i, t, _ in rows if not any(len(grams(t) & grams(x)) == len(grams(x)) for x in items)]


@pytest.mark.parametrize("name", ["quality_rules", "line_dedup", "decontamination"])
def test_stages_match_brute_force_on_hard_rows(spark, data, name, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, clashing columns: each stage on its own input, against plain Python."""
    extra = [(20 + i, BASE + f"\nline one of {i % 2}\nline two\nline three\nline four {i}", "a", 1, 1, "x", 1) for i in range(4)]
    df = hard(spark).union(spark.createDataFrame(extra, SCHEMA)).select("*", F.lit(1).alias("__text"), F.lit(1).alias("__key"))
    spark.createDataFrame([(1, BASE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = dict(corpus_pipeline.STAGES)[name](spark, df, str(tmp_path))
    assert out.columns == df.columns
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(brute_stage(name, rows, [BASE]), key=str)
    assert dict(corpus_pipeline.STAGES)[name](spark, df.limit(0), str(tmp_path)).count() == 0


def test_last_stage_on_hard_rows(spark):
    df = hard(spark).select("*", F.lit(1).alias("__text"), F.lit(1).alias("ids"), F.lit(1).alias("key"))
    got = corpus_pipeline.segmentation_stage(spark, df, "").collect()
    assert all(r.round_trip for r in got)
    assert {r.doc_id for r in got} == {r[0] for r in ROWS} and corpus_pipeline.segmentation_stage(spark, df.limit(0), "").count() == 0


def test_jaccard_stage_on_hard_rows(spark):
    """Exactly one row of each group of copies stays, whatever its ids; rows without copies all stay."""
    df = hard(spark).union(spark.createDataFrame([(None, BASE + " other tail", "n", 0, 0, "", 0), (None, None, None, 0, 0, "", 0), (11, "unrelated " * 3, "n", 0, 0, "", 0), (9, "unrelated to its id's other text", "n", 0, 0, "", 0), (None, "copies all have no id", "n", 0, 0, "", 0), (None, "copies all have no id", "n", 0, 0, "", 0), (12, "row twice", "n", 0, 0, "", 0), (12, "row twice", "n", 0, 0, "", 0)], df_schema := hard(spark).schema))
    assert df_schema == df.schema
    rows = [(r.doc_id, r.text) for r in df.collect()]
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    group[i] = group[j] = min(group[i], group[j])
    want = []
    for g in set(group):
        want.append(min((rows[i] for i in range(len(rows)) if group[i] == g), key=lambda r: (r[0] is None, r[0] or 0)))
    out = corpus_pipeline.jaccard_stage(spark, df, "")
    assert out.columns == df.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
