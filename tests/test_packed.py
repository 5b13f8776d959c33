"""Searches over an index of a row for each chunk give what the scores of all postings give, and move no row for a hit."""

import random

import pytest
from pyspark.sql import functions as F

from lexarium.operators import evaluation, graph, lexical, packed, retrieval


@pytest.fixture(scope="module")
def corpus(spark):
    """Chunks of three languages, with copies, blank ones and words of one text alone."""
    draw = random.Random(3)
    words = [[f"{lang}{i}" for i in range(60)] + [f"w{i}" for i in range(8)] for lang in ("de", "en", "fr")]
    rows = []
    for i in range(400):
        own = words[i % 3]
        text = " ".join(draw.choices(own, weights=[1 / (j + 1) for j in range(len(own))], k=draw.randint(1, 40))) + f" only{i}"
        rows.append((f"p{i:03d}", f"p{i:03d}-c0", 0, rows[i - 3][3] if i % 7 == 3 else "  " if i == 50 else text, 1, 1, "", "reference" if i % 10 == 0 else "full", ("de", "en", "fr")[i % 3]))
    return spark.createDataFrame(rows, "paper_id string, chunk_id string, row_index int, text string, page_number int, page_end int, section_title string, document_kind string, lang string").persist()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "de0 de1 de0 w1"), (2, "en3 w0 w1 w2 fr5"), (3, "fr0 fr1 fr2 only9"), (4, "nothing known"), (5, "w0")], "query_id long, query string")


def rows(df, digits=8):
    return sorted(tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_scores_ranks_and_the_best_of_groups_equal_those_of_all_postings(spark, corpus, queries, monkeypatch):
    monkeypatch.setattr(packed, "MARKS", 16)
    monkeypatch.setattr(packed, "BLOCK", 37)
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 150)  # most terms aren't common
    index, weights = packed.pack(corpus), lexical.weighted(corpus).persist()
    want = lexical.scores(weights, queries).persist()
    assert rows(lexical.scores(index, queries)) == rows(want)
    fused = lexical.hybrid(want).persist()
    assert rows(packed.fused(index, queries).drop("own")) == rows(fused)
    for scoring in lexical.SCORINGS:
        assert rows(lexical.search(index, queries, 4, scoring, corpus)) == rows(lexical.search(weights, queries, 4, scoring, corpus, scored=want))
    only = corpus.filter("lang = 'de'").select("paper_id")
    assert rows(lexical.search(index, queries, 4, "hybrid", corpus, only)) == rows(lexical.search(weights, queries, 4, "hybrid", corpus, only, scored=want))
    members = graph.numbered_communities(corpus.select("paper_id", F.col("lang").alias("community"))).withColumns({"centrality": F.lit(0.0)})
    old, new = (retrieval.Index(corpus, w, members=members) for w in (weights, index))
    assert rows(retrieval.rank_communities(new, queries, 2), 11) == rows(retrieval.rank_communities(old, queries, 2), 11)
    assert rows(retrieval.search_drift(new, queries, 6, 1)) == rows(retrieval.search_drift(old, queries, 6, 1))
    assert rows(lexical.scores_by_paper(index, queries, corpus).withColumn("scores", F.get("scores", F.lit(0)))) == rows(lexical.scores_by_paper(weights, queries, corpus).withColumn("scores", F.get("scores", F.lit(0))))


def test_queries_in_blocks_are_all_answered(spark, corpus, queries, monkeypatch):
    monkeypatch.setattr(packed, "QUERIES", 2)
    index, weights = packed.pack(corpus), lexical.weighted(corpus)
    assert rows(lexical.search(index, queries, 3, "hybrid", corpus)) == rows(lexical.search(weights, queries, 3, "hybrid", corpus))


def test_no_scored_row_moves_for_the_scores(spark, corpus, queries):
    plan = lexical.scores(packed.pack(corpus), queries)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_texts_stay_where_they_lie_for_evidence(spark, corpus):
    hits = spark.createDataFrame([(1, 1, "p003-c0", 0.5)], "query_id long, rank int, chunk_id string, score double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = retrieval.cited(retrieval.Index(corpus, None), hits)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_coverage_has_no_row_for_a_question_and_a_paper(spark):
    """Papers in two chosen communities count once; sizes are counted by the communities that papers are in."""
    members = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 2), ("d", 3)], "paper_id string, community_id long")
    chosen = spark.createDataFrame([("x", "q1", 1), ("x", "q1", 2), ("x", "q2", 3)], "strategy string, qid string, community_id long")
    expected = spark.createDataFrame([("q1", "b"), ("q1", "d"), ("q2", "a")], "qid string, paper_id string")
    asked = spark.createDataFrame([("q1",), ("q2",)], "qid string")
    out = evaluation.coverage_stats(chosen, members, expected, asked, 4)
    got = out.first()
    assert (got.coverage, got.selectivity) == (0.25, 0.5)
    shown = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set(community_id" in shown


def test_keywords_of_communities_equal_those_of_vectors(spark, corpus, monkeypatch):
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 150)
    member = graph.numbered_communities(corpus.select("paper_id", F.col("lang").alias("community")))
    vectors = graph.paper_vectors(graph.paper_documents(corpus), ["w1"])
    assert rows(graph.keywords_of(corpus, member, ["w1"])) == rows(graph.community_keywords(vectors, member))


def test_neighbours_and_edges_of_a_few_equal_those_of_all(spark, corpus, monkeypatch):
    monkeypatch.setattr(packed, "BLOCK", 37)
    monkeypatch.setattr(packed, "SEEDS", 40)  # several passes
    copies = corpus.limit(6).withColumns({"paper_id": F.concat(F.lit("z"), "paper_id"), "chunk_id": F.concat(F.lit("z"), "chunk_id")})
    both = corpus.unionByName(copies).persist()
    seeds = both.select(F.col("chunk_id").alias("seed_id")).filter(F.pmod(F.xxhash64("seed_id"), F.lit(4)) == 0)
    assert rows(lexical.chunk_neighbors(packed.pack(both), seeds, 3)) == rows(lexical.chunk_neighbors(lexical.weighted(both), seeds, 3))
    some = both.select("paper_id").distinct().filter(F.pmod(F.xxhash64("paper_id"), F.lit(5)) == 0)
    want = graph.similarity_edges(graph.paper_vectors(graph.paper_documents(both), ["the"]), 3)
    around = want.join(some, F.col("paper_id").isin(F.col("source"), F.col("target")), "left_semi").persist()
    got = graph.edges_around(graph.packed_papers(both, ["the"]), some, 3)
    assert around.count() and rows(got.join(some, F.col("paper_id").isin(F.col("source"), F.col("target")), "left_semi")) == rows(around)
    assert graph.edges_around(graph.packed_papers(both), some.limit(0)).isEmpty()


def test_scores_by_paper_move_as_packed_ranges(spark, corpus, queries, monkeypatch):
    for name, value in (("MARKS", 64), ("RANGE", 40), ("SPREAD", 50)):  # several ranges and blocks
        monkeypatch.setattr(packed, name, value)
    shared = corpus.withColumn("paper_id", F.concat(F.lit("x"), F.substring("paper_id", 4, 1)))  # papers of many chunks, not in their order
    index, want = packed.pack(shared), lexical.hybrid(lexical.scores(lexical.weighted(shared), queries)).persist()
    assert rows(packed.fused(index, queries).drop("own"), 12) == rows(want, 12)
    got = lexical.scores_by_paper(index, queries, shared)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan  # a scored row is never one that moves
    papers = want.join(shared.select("chunk_id", "paper_id"), "chunk_id").groupBy("query_id", "paper_id").agg(F.sort_array(F.collect_list("score"), False).alias("scores"))
    assert sorted(map(str, got.collect())) == sorted(map(str, papers.select(*got.columns).collect()))
    for x in ([5], [0, 255, 7], [10**12, 3, 3], [7, 70_000, 2**31]):
        assert packed._whole(packed._fewer(packed.np.array(x))).tolist() == x
        assert packed._whole(packed._fewer(packed.np.array(sorted(x)), True), True).tolist() == sorted(x)
