"""Every registered query runs, and equals its SQL where it has some."""

import math

import duckdb
import pytest

from sparksieve.plans import all_queries

QUERIES, SQL = all_queries()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v if isinstance(v, int) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    df = QUERIES[name](spark, data)
    names = sorted(df.columns)
    rows = [tuple(plain(r[n]) for n in names) for r in df.collect()]
    if name not in SQL:
        assert rows
        return
    want = con.sql(SQL[name])
    assert sorted(want.columns) == names
    other = [tuple(plain(r[want.columns.index(n)]) for n in names) for r in want.fetchall()]
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    assert len(rows) == len(other)
    for a, b in zip(sorted(rows, key=key), sorted(other, key=key)):
        assert all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) < 1e-4) for x, y in zip(a, b)), (a, b)


def test_entry():
    import __spark_entry__

    assert len(__spark_entry__.queries()) >= len(QUERIES) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_forest_searches_below_the_first_level(spark, data):
    """Each tree makes the reference's 1,000 iterations, of which opening the root takes at most 64."""
    assert all(r.nodes > 500 for r in QUERIES["ucb_forest"](spark, data).collect())


def test_resampling_has_the_reference_number_of_rounds(spark, data):
    """10,000 rounds each: a strong effect's p can be far under 1/51, and the interval is that of the normal approximation."""
    import math

    from pyspark.sql import functions as F

    from sparksieve.operators import evaluation as ev

    assert {r.rounds for r in QUERIES["bootstrap_intervals"](spark, data).collect()} == {10_000}
    rows = spark.range(400).select("id", F.lit("x").alias("g"), (F.pmod("id", F.lit(7)) + 1.0).alias("a"), F.lit(0.0).alias("b"), F.pmod("id", F.lit(2)).cast("double").alias("even"))
    p = ev.permutation_test(rows, ["g"], "id", "a", "b", 10_000).first()
    assert p.p == 1 / 10_001
    assert 0.9 < ev.permutation_test(rows.withColumn("a", F.col("even") * 2 - 1), ["g"], "id", "a", "b", 10_000).first().p <= 1
    r = ev.bootstrap(rows, ["g"], "id", "even", 10_000).first()
    half = 1.96 * 0.5 / math.sqrt(400)
    assert abs(r.ci_low - (0.5 - half)) < 0.005 and abs(r.ci_high - (0.5 + half)) < 0.005
