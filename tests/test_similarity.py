import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexarium.operators import graph, similarity


@pytest.fixture(scope="module")
def vectors(spark):
    """Papers of four vocabularies with common words, a third of them nearly one text, some empty or alone."""
    rng = random.Random(5)
    words = [[f"v{v}w{i}" for i in range(40)] for v in range(4)]
    common = ["also", "both", "each"]
    docs = []
    for i in range(240):
        if i % 3 == 0:
            text = [f"hot{j}" for j in range(12)] + [rng.choice(words[0]) for _ in range(2)]
        else:
            text = [rng.choice(rng.choice(words) if rng.random() < 0.1 else words[i % 4]) for _ in range(rng.randint(3, 30))] + rng.choices(common, k=4)
        docs.append((f"p{rng.randint(0, 9)}{i:03d}", " ".join(text)))
    docs += [("e1", ""), ("e2", "unheard"), ("t1", "same words here"), ("t2", "same words here"), ("t3", "same words here")]
    return graph.paper_vectors(spark.createDataFrame(docs, "paper_id string, text string"), ["of"]).persist()


@pytest.fixture(scope="module")
def pairs(vectors):
    """All pairs, one by one."""
    own = defaultdict(dict)
    for r in vectors.collect():
        own[r.paper_id][r.term] = r.w
    ids = sorted(own)
    return {(a, b): s for i, a in enumerate(ids) for b in ids[i + 1 :] if (s := round(sum(w * own[b].get(t, 0.0) for t, w in own[a].items()), 9)) >= 0.1}


@pytest.fixture(params=[(1024, 16), (16, 4)], ids=["one panel", "many panels"])
def sizes(request, monkeypatch):
    monkeypatch.setattr(similarity, "PANEL", request.param[0])
    monkeypatch.setattr(similarity, "DENSE", request.param[1])
    monkeypatch.setattr(similarity, "CELLS", 1000)


def test_all_pairs(vectors, pairs, sizes):
    got = {(r.a, r.b): r.similarity for r in graph.similarities(vectors).collect()}
    assert got == pytest.approx(pairs, abs=2e-9) and len(pairs) > 1000


def test_mutual_edges_without_the_list_of_pairs(spark, vectors, pairs, sizes):
    frame = spark.createDataFrame([(*k, s) for k, s in pairs.items()], "a string, b string, similarity double")
    want = {(r.source, r.target) for r in graph.mutual_edges(frame, 3).collect()}
    assert {(r.source, r.target) for r in graph.similarity_edges(vectors, 3).collect()} == want


def test_panels_that_hold_no_match_are_not_visited(spark, vectors, sizes):
    rows = similarity.panels(vectors)
    n, every = rows.count(), rows.select("panel").distinct().count()
    asked = similarity.visits(rows, rows.select("paper_id", F.lit(0.5).alias("floor")))
    assert asked.count() == asked.select("paper_id", "panel").distinct().count() <= n * every
    assert every == 1 or asked.count() < 0.8 * n * every


def test_empty(spark):
    none = spark.createDataFrame([], "paper_id string, term string, df long, w double")
    assert graph.similarities(none).collect() == [] and graph.similarity_edges(none).collect() == []


def test_papers_move_once_for_each_row_or_column_of_the_grid(spark, vectors, pairs, monkeypatch):
    """Some papers against all, groups and panels of a few, copies that tie: against all pairs one by one; no pair moves, and no paper once for each panel."""
    monkeypatch.setattr(similarity, "PANEL", 8)
    monkeypatch.setattr(similarity, "GROUP", 60)
    monkeypatch.setattr(similarity, "CELLS", 100)
    rows = similarity._keep(similarity.as_rows(vectors))
    probes, n = rows.filter("paper_id < 'p3'"), rows.count()
    near = {}
    for (a, b), s in pairs.items():
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, []).append((-s, y))
    got = {}
    for r in similarity.nearest_of(rows, probes, 5, 0.1, n, probes.count()).orderBy("r").collect():
        got.setdefault(r.a, []).append((-r.similarity, r.b))
    asked = {r.paper_id for r in probes.select("paper_id").collect()}
    assert set(got) == asked & set(near) and len(got) > 20
    for a, own in got.items():
        assert [s for s, _ in own] == pytest.approx([s for s, _ in sorted(near[a])[:5]], abs=2e-9)
    for n_rows, n_probes in ((50_000, 50_000), (500_000, 500_000), (500_000, 25_000), (500_000, 200), (0, 0)):
        groups, slices = similarity._grid(n_rows, n_probes, 12)
        assert groups * similarity.GROUP >= n_rows and groups * slices >= 12
    monkeypatch.undo()
    assert similarity._grid(50_000, 50_000, 12) in ((3, 4), (4, 3)) and similarity._grid(500_000, 200, 12) == (12, 1)


@pytest.mark.parametrize("common", [200_000, 20])
def test_coded_vectors_are_small_and_give_the_same_edges(spark, monkeypatch, common):
    """A paper is a row of a few bytes a term, whether all numbers of terms are broadcast or a part comes by a join; copies tie."""
    monkeypatch.setattr(similarity, "COMMON", common)
    monkeypatch.setattr(similarity, "PANEL", 16)
    monkeypatch.setattr(similarity, "CELLS", 400)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(150)]
    docs = [(f"p{i:03d}", i % 2, " ".join(rng.choices(words, weights=[1 / (1 + j) for j in range(150)], k=rng.randint(1, 40)) + [f"own{i}"] * (i % 3))) for i in range(120)]
    docs += [(f"q{i}", 0, docs[7][2]) for i in range(12)] + [("r1", 0, "unheard"), ("r2", 0, " "), ("r3", 0, "of"), ("r4", 0, "w1 " * 300)]
    chunks = spark.createDataFrame(docs, "paper_id string, row_index int, text string")
    vectors = graph.paper_vectors(graph.paper_documents(chunks), ["of"])
    coded = graph.coded_papers(chunks, ["of"])
    assert coded.rows.columns == ["paper_id", "norm", "lead", "codes", "tfs"]
    n = coded.rows.selectExpr("sum(length(codes) + length(tfs)) AS bytes").first().bytes
    assert n < 3.2 * vectors.filter("df > 1").count()
    plain = lambda rows: {(r.source, r.target): round(r.weight, 8) for r in rows.collect()}
    want = plain(graph.similarity_edges(vectors, 3))
    assert plain(graph.coded_edges(coded, k=3)) == want and len(want) > 30
    some = spark.createDataFrame([("p007",), ("q3",), ("r2",)], "paper_id string")
    around = plain(graph.coded_edges(coded, some, 3))
    assert around == {k: w for k, w in want.items() if {"p007", "q3"} & {*k}} and around


def test_numbers_as_bytes():
    import numpy as np

    x, sizes = np.array([0, 1, 127, 128, 16383, 16384, 2**31 - 1, 5]), np.array([0, 3, 0, 4, 1, 0])
    got, offsets = similarity._spelled(similarity._spell(x, sizes))
    assert got.tolist() == x.tolist() and offsets.tolist() == [0, 0, 3, 3, 7, 8, 8]
    part, offsets = similarity._spelled(similarity._spell(x, sizes).slice(3, 2))
    assert part.tolist() == x[3:].tolist() and offsets.tolist() == [0, 4, 5]


def test_rounds_of_communities_leave_no_tables(spark, tmp_path, monkeypatch):
    """What a round writes goes with it: two rings of papers, held together by one weak edge."""
    from lexarium import shared

    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}")
    edges = [(f"{r}{i}", f"{r}{j}", 1.0) for r in "ab" for i in range(5) for j in range(i + 1, 5)] + [("a0", "b0", 0.1)]
    nodes = spark.createDataFrame([(f"{r}{i}",) for r in "ab" for i in range(5)] + [("z",)], "paper_id string")
    member = graph.louvain(nodes, spark.createDataFrame(edges, "source string, target string, weight double"), shared.keep)
    got = {r.paper_id: r.community for r in member.collect()}
    assert len({got[f"a{i}"] for i in range(5)}) == len({got[f"b{i}"] for i in range(5)}) == 1 and len({*got.values()}) == 3
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("kept-")]) <= 2
