import random

import pytest
from pyspark.sql import functions as F

from lexarium.errors import DomainError
from lexarium.operators import evaluation, graph, lexical, packed, retrieval
from lexarium.plans import evaluate, snapshot


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(80)]
    rows = [(f"p{i:03d}", f"p{i:03d}-c0", 0, f"topic{i % 6} " + " ".join(rng.choices(words[(i % 6) * 10 : (i % 6) * 10 + 30], k=25)), 1, 1, "References" if i % 4 == 0 else "Methods", "full") for i in range(90)]
    chunks = spark.createDataFrame(rows, "paper_id string, chunk_id string, row_index int, text string, page_number int, page_end int, section_title string, document_kind string").persist()
    base = f"file://{tmp_path_factory.mktemp('index')}"
    weights = lexical.weighted(chunks).persist()
    snapshot.write_postings(weights, f"{base}/postings", 1)
    snapshot.write_forward(lexical.forward(weights), f"{base}/forward", 1)
    member = chunks.select((F.substring("paper_id", 2, 3).cast("int") % 6).alias("community_id"), "paper_id", F.lit(1.0).alias("centrality"), F.lit(False).alias("is_representative"))
    edges = [(f"p{i:03d}", f"p{j:03d}", round(1 / (1 + abs(i - j)), 6)) for i in range(90) for j in range(i + 1, 90) if (j - i) % 6 == 0 and j - i < 40]
    edges = spark.createDataFrame(edges, "source string, target string, weight double")
    return retrieval.Index(chunks, spark.read.parquet(f"{base}/postings"), edges, member, forward=spark.read.parquet(f"{base}/forward"))


@pytest.fixture(scope="module")
def gold(spark):
    rng = random.Random(5)
    asked = [(f"q{i}", f"topic{i % 6} w{rng.randint(0, 79)} w{rng.randint(0, 79)}", ["fact", "concept"][i % 2]) for i in range(4)] + [("q7", "nothing known", "fact"), ("q8", "topic1 topic2", "fact")]
    expected = [(f"q{i}", f"p{rng.randint(0, 14) * 6 + (i % 6 if i != 3 else 0):03d}") for i in range(4) for _ in range(4)] + [("q7", "p001"), ("q8", "p050")]
    return spark.createDataFrame(asked, "qid string, query string, kind string"), spark.createDataFrame(sorted(set(expected)), "qid string, paper_id string")


def one_by_one(spark, index, asked, expected):
    """Each question through each mode on its own, as a client would ask."""
    wanted, member = {}, {r.paper_id: r.community_id for r in index.members.collect()}
    for r in expected.collect():
        wanted.setdefault(r.qid, set()).add(r.paper_id)
    out = {}
    paper = lambda chunk: chunk.split("-")[0]
    for q in asked.collect():
        one = spark.createDataFrame([(q.qid, q.query)], "query_id string, query string")
        first = lambda entries: next(((i, part) for i, (p, part) in enumerate(entries, 1) if p in wanted[q.qid]), (None, None))  # noqa: B023, E731
        ranked = lambda df: [(paper(r.chunk_id), None) for r in df.orderBy("rank").collect()]
        out["basic", q.qid] = out["primitive", q.qid] = first(ranked(retrieval.search_basic(index, one, 5)))
        parts = retrieval.search_local(index, one)
        fan = sorted(parts["fan_out"].collect(), key=lambda r: (-r.weight, r.neighbor))
        out["local", q.qid] = first([(p, "seed") for p, _ in ranked(parts["seeds"])] + [(p, "neighborhood") for p, _ in ranked(parts["neighborhood"])] + [(r.neighbor, "fan_out") for r in fan])
        chosen = [r.community_id for r in retrieval.rank_communities(index, one, 2).orderBy("rank").collect()]
        right = [i for i, c in enumerate(chosen, 1) if any(member[p] == c for p in wanted[q.qid])]
        out["global", q.qid] = (right[0] if right else None, "in_community" if right else "community_missed" if chosen else "no_community")
        hits = retrieval.search_drift(index, one, 6, 2).orderBy("rank").collect()
        fell = any(h.fallback for h in hits)
        out["drift", q.qid] = (first([(paper(h.chunk_id), None) for h in hits])[0], "fallback" if fell else "in_community" if right else "community_missed")
        lexical.let_go()
    return out


def test_all_labels_at_once_are_each_question_alone(spark, index, gold):
    asked, expected = gold
    got = {(r.label, r.qid): (r["rank"], r.diagnosis) for r in evaluate.evaluate_all(index, asked, expected, communities=2).collect()}
    want = one_by_one(spark, index, asked, expected)
    assert got == want and len(got) == 30
    assert {d for (label, _), (_, d) in got.items() if label == "global"} == {"in_community", "community_missed", "no_community"}
    with pytest.raises(DomainError):
        evaluate.evaluate_all(index, asked, expected, labels=("other",))
    lexical.let_go()


def test_drift_diagnoses_reach_all_values(spark):
    hits = spark.createDataFrame([("a", 1, "p1", False), ("b", 1, "p2", False), ("c", 1, "p1", True)], "qid string, rank int, paper_id string, fallback boolean")
    chosen = spark.createDataFrame([("a", 1, 0), ("b", 1, 1)], "qid string, rank int, community_id int")
    members = spark.createDataFrame([(0, "p1"), (1, "p2")], "community_id int, paper_id string")
    expected = spark.createDataFrame([("a", "p1"), ("b", "p1"), ("c", "p1")], "qid string, paper_id string")
    questions = expected.select("qid")
    got = {r.qid: (r["rank"], r.diagnosis) for r in evaluation.drift_scores(hits, chosen, members, expected, questions).collect()}
    assert got == {"a": (1, "in_community"), "b": (None, "community_missed"), "c": (1, "fallback")}


def test_five_levels(spark, index):
    asked = spark.createDataFrame([("C01", "p006", ["p000", "p012", "p018"], "cited 3-4", "Which papers build on topic0 w5?", "Which papers build on w1, w7?"), ("C02", "p089", ["p001"], "cited 3-4", "x", "y")], "qid string, anchor_paper_id string, expected array<string>, kind string, query_title string, query_topic string")
    got = {(r.level, r.qid): (r["rank"], r.component) for r in evaluate.evaluate_multihop(index, asked).collect()}
    assert set(got) == {(level, q) for level in evaluation.LEVELS for q in ("C01", "C02")}
    assert got["graph", "C01"] == (1, "neighbor") and got["basic_title", "C02"] == (None, None)
    one = spark.createDataFrame([("q", "Which papers build on topic0 w5?")], "query_id string, query string")
    hits = [r.chunk_id[:4] for r in retrieval.search_basic(index, one, 5).orderBy("rank").collect() if r.chunk_id[:4] != "p006"]
    right = [i for i, p in enumerate(hits, 1) if p in {"p000", "p012", "p018"}]
    section = "ref" if right and int(hits[right[0] - 1][1:]) % 4 == 0 else "body"
    assert got["basic_title", "C01"] == ((right[0], f"chunk:{section}") if right else (None, None))
    shares = {r.strategy: (r.coverage, r.selectivity, r.lift) for r in evaluate.graph_coverage(index.edges, index.chunks, asked).collect()}
    assert shares["graph"][0] == pytest.approx((3 / 3 + 0) / 2) and shares["chance"][0] == pytest.approx(5 / 89) and shares["chance"][1] == pytest.approx(5 / 90)
    lexical.let_go()


def test_table_functions(spark, index):
    from lexarium.plans import table_functions

    assert table_functions.register(spark, index, "t_") == ["t_search_bm25", "t_neighbors_of", "t_topic_of"]
    one = spark.createDataFrame([("q", "topic1 w3 w14")], "query_id string, query string")
    want = [(r["rank"], r.chunk_id, r.chunk_id[:4], r.score) for r in lexical.search(index.weights, one, 4, "bm25").orderBy("rank").collect()]
    assert [tuple(r) for r in spark.sql("SELECT * FROM t_search_bm25('topic1 w3 w14', 4) ORDER BY rank").collect()] == want and len(want) == 4
    spark.createDataFrame([(1, "topic1 w3 w14"), (2, "unheard"), (3, None), (4, "topic1 w3 w14")], "id int, q string").createOrReplaceTempView("asked")
    rows = spark.sql("SELECT a.id, s.rank, n.neighbor, p.community_id FROM asked a, LATERAL t_search_bm25(a.q, 1) s, LATERAL t_neighbors_of(s.paper_id, 2) n, LATERAL t_topic_of(n.neighbor) p ORDER BY 1, n.rank").collect()
    near = graph.neighbors(index.edges, want[0][2]).limit(2).collect()
    assert [(r.id, r.neighbor, r.community_id) for r in rows] == [(i, n.neighbor, int(n.neighbor[1:]) % 6) for i in (1, 4) for n in near]
    assert [f.simpleString() for f in spark.sql("SELECT * FROM t_neighbors_of('p000', 3)").schema.fields] == ["rank:int", "neighbor:string", "weight:double"]


def test_over_a_packed_index_all_labels_are_the_same_without_all_edges(spark, index, gold, monkeypatch):
    asked, expected = gold
    papers = graph.packed_papers(index.chunks, ["w1"])
    edges = graph.similarity_edges(graph.paper_vectors(graph.paper_documents(index.chunks), ["w1"]))
    old = retrieval.Index(index.chunks, index.weights, edges, index.members, forward=index.forward)
    new = retrieval.Index(index.chunks, packed.pack(index.chunks), members=index.members, counted=papers)
    want = sorted(map(str, evaluate.evaluate_all(old, asked, expected, communities=2).collect()))
    monkeypatch.setattr(lexical, "scores", None)  # no scored row is made
    monkeypatch.setattr(graph, "similarity_edges", None)
    assert sorted(map(str, evaluate.evaluate_all(new, asked, expected, communities=2).collect())) == want
