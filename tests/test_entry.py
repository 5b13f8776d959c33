"""The registry: names, columns and results against SQL, on the smallest tables where they are there."""

import os

import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"
CHECKED = ["search_hybrid", "phrase_search", "near_search", "coauthors", "resolve_metadata", "route_questions", "consistency"]


def test_every_sql_has_a_query():
    queries = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(queries) and len(queries) > 40


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for f in os.listdir(SMALL):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    want = db.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    assert sorted(plain(r) for r in got.select(*columns).collect()) == sorted(plain(r) for r in want.project(", ".join(columns)).fetchall())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_paper_filter_stays_above_the_rank(spark):
    """The optimizer must not move the filter below the window that ranks the whole corpus."""
    from lexarium.operators import lexical

    chunks = spark.createDataFrame([("a-c0", "a", "graph search"), ("b-c0", "b", "graph model")], "chunk_id string, paper_id string, text string")
    q = spark.createDataFrame([(1, "graph search")], "query_id int, query string")
    only = spark.createDataFrame([(1, "b")], "query_id int, paper_id string")
    found = lexical.search(lexical.weighted(chunks), q, 5, "hybrid", chunks, only)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") < plan.index("Window", plan.index("LeftSemi"))
    assert [r.chunk_id for r in found.collect()] == ["b-c0"]
