import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from lexarium.errors import DomainError
from lexarium.operators import evaluation, extraction, graph, lexical, metadata, persons, retrieval, routing


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    vocabulary = ["graph", "search", "model", "index", "token", "query", "rank", "of", "the"]
    return [(f"p{i:03d}-c0000", f"p{i:03d}", " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12)))) for i in range(n)]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(corpus(), "chunk_id string, paper_id string, text string").withColumn("document_kind", F.when(F.col("paper_id") < "p010", "reference").otherwise("full"))


def plain_bm25(rows, query):
    docs = {c: t.split() for c, _, t in rows if t.strip()}
    avg = sum(map(len, docs.values())) / len(docs)
    out = {}
    for c, words in docs.items():
        tf, score = collections.Counter(words), 0.0
        for term in query.split():
            n = sum(term in w for w in docs.values())
            if tf[term]:
                score += math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) * tf[term] * 2.5 / (tf[term] + 1.5 * (0.25 + 0.75 * len(words) / avg))
        if score > 0:
            out[c] = score
    return out


def test_bm25_equals_the_formula(spark, chunks):
    q = spark.createDataFrame([(1, "graph search graph"), (2, "unknown")], "query_id int, query string")
    got = {r.chunk_id: r.score_bm25 for r in lexical.scores(lexical.weighted(chunks), q).collect()}
    want = plain_bm25(corpus(), "graph search graph")
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-8 for c in want)


@pytest.mark.parametrize("k", [1, 3, 10])
def test_fused_top_k_equals_full_fusion(spark, chunks, k):
    q = spark.createDataFrame([(1, "graph search"), (2, "token of the index")], "query_id int, query string")
    scored = lexical.scores(lexical.weighted(chunks), q).persist()
    top = lambda df: sorted((r.query_id, -r.score, r.chunk_id) for r in df.collect())
    cut = lambda rows: [x for i in (1, 2) for x in [r for r in rows if r[0] == i][:k]]
    assert cut(top(lexical.hybrid(scored, k))) == cut(top(lexical.hybrid(scored)))


def test_filter_comes_after_ranks_and_references_go_last(spark, chunks):
    q = spark.createDataFrame([(1, "graph search model")], "query_id int, query string")
    w = lexical.weighted(chunks).persist()
    full = {r.chunk_id: r.score for r in lexical.hybrid(lexical.scores(w, q)).collect()}
    only = chunks.filter("paper_id like 'p00%'").select(F.lit(1).alias("query_id"), "paper_id")
    got = lexical.search(w, q, 5, "hybrid", chunks, only).collect()
    assert got and all(abs(r.score - full[r.chunk_id]) < 1e-9 for r in got)
    hits = lexical.search(w, q, 10, "hybrid", chunks).orderBy("rank").collect()
    kinds = [r.chunk_id < "p010" for r in hits]
    assert kinds == sorted(kinds)
    with pytest.raises(DomainError):
        lexical.search(w, q, 5, "other")


def test_phrase_prefix_near(spark):
    rows = spark.createDataFrame([("a", "The café of the north"), ("b", "of north the"), ("c", "cafeteria of x the")], "chunk_id string, text string")
    pos = lexical.positions(rows)
    ids = lambda df: sorted(r.chunk_id for r in df.collect())
    assert ids(lexical.phrase_hits(pos, "CAFE of")) == ["a"]
    assert ids(lexical.phrase_hits(pos, "cafe", prefix=True)) == ["a", "c"]
    assert ids(lexical.near_hits(pos, ["of", "the"], 0)) == ["a"]
    assert ids(lexical.near_hits(pos, ["of", "the"], 1)) == ["a", "b", "c"]


def test_communities_of_two_cliques(spark, tmp_path):
    edges = [(a, b, 1.0) for g in ("abcd", "wxyz") for i, a in enumerate(g) for b in g[i + 1 :]] + [("d", "w", 0.1)]
    nodes = spark.createDataFrame([(x,) for x in "abcdwxyzq"], "paper_id string")
    n = iter(range(10_000))

    def keep(df):
        path = f"file://{tmp_path}/{next(n)}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    e = spark.createDataFrame(edges, "source string, target string, weight double")
    member = graph.numbered_communities(graph.louvain(nodes, e, keep))
    got = {r.paper_id: r.community_id for r in member.collect()}
    assert [got[x] for x in "abcd"] == [0] * 4 and [got[x] for x in "wxyz"] == [1] * 4 and got["q"] == 2
    m = {r.paper_id: r for r in graph.community_members(e, member).collect()}
    assert m["a"].centrality == 3.0 and m["q"].centrality == 0.0 and m["q"].is_representative


def test_mutual_edges(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.8), ("b", "c", 0.7)], "a string, b string, similarity double")
    assert [tuple(r) for r in graph.mutual_edges(pairs, 1).collect()] == [("a", "b", 0.9)]


def test_citations_by_precedence(spark):
    keys = spark.createDataFrame([("p1", "doi", "10.1145/1234"), ("p1", "title", "a very long title of this paper"), ("p2", "arxiv", "2404.16130"), ("p3", "title", "another long title about graphs and search")], "paper_id string, method string, pattern string")
    refs = spark.createDataFrame([("p1", "self 10.1145/1234"), ("p9", "see 10.1145/12345 A very long title: of this paper; arXiv:2404.16130v2 and Another long title about graphs and search!")], "paper_id string, text string")
    got = sorted(map(tuple, graph.citation_edges(refs, keys).collect()))
    assert got == [("p9", "p1", "doi"), ("p9", "p2", "arxiv"), ("p9", "p3", "title")]


def test_routing(spark):
    q = [(1, "Compare A versus B"), (2, "What is the accuracy?"), (3, "Which papers build on X? overall"), (4, "hello"), (5, "biometrika"), (6, "Wie zitieren sich diese Arbeiten?")]
    got = {r.query_id: (r.mode, r.confidence, r.signals) for r in routing.route(spark.createDataFrame(q, "query_id int, query string")).collect()}
    assert got[1] == ("drift", "strong", ["versus", "compare"]) and got[2] == ("basic", "none", ["accuracy"])
    assert got[3][:2] == ("basic", "weak") and got[4] == ("basic", "none", []) and got[5][2] == [] and got[6][0] == "local"
    assert routing.signal_table(spark).count() == 69


def test_modes_and_answers(spark, chunks):
    full = chunks.withColumns({"row_index": F.lit(0), "page_number": F.lit(1), "page_end": F.lit(2), "section_title": F.lit("")})
    vectors = graph.paper_vectors(graph.paper_documents(full), ["of", "the"])
    edges = graph.similarity_edges(vectors).persist()
    member = full.select("paper_id", F.pmod(F.crc32("paper_id"), F.lit(3)).cast("int").alias("community_id"))
    members = graph.community_members(edges, member).persist()
    index = retrieval.Index(full, lexical.weighted(full).persist(), edges, members, graph.community_table(members, graph.community_keywords(vectors, member), full))
    q = spark.createDataFrame([(1, "graph search")], "query_id int, query string")
    assert retrieval.search_drift(index, q, 4, 1).filter("not fallback").count() == 4
    local = retrieval.search_local(index, q, 3, 2, 2)
    seeds = {r.chunk_id for r in local["seeds"].collect()}
    assert len(seeds) == 2 and not seeds & {r.chunk_id for r in local["neighborhood"].collect()}
    assert local["fan_out"].count() <= 2
    out = retrieval.answer_question(index, "overall landscape of graph search", provider=lambda t: t.upper())
    assert out["mode"] == "global" and out["generated"] and out["evidence"][0]["n"] == 1
    assert retrieval.answer_question(index, "zzz")["evidence"] == []
    with pytest.raises(DomainError):
        retrieval.get_paper(index, "nope")
    assert retrieval.get_paper(index, "p011").first().n_chunks == 1


def test_chunks_and_sections(spark):
    body = "\n\n".join(f"Paragraph {i} of the body text with words. " * 8 for i in range(6))
    pages = spark.createDataFrame([("p", 1, f"Title\n\nAbstract\n\n{'An abstract sentence here. ' * 12}\n\n1 Introduction\n\n{body}"), ("p", 2, "2 Tiny\n\nshort\n\nReferences\n\n[1] A. Author. 2 Some title. 2020."), ("q", 1, "")], "paper_id string, page_number int, text string")
    got = extraction.chunks_of(pages).filter("paper_id = 'p'").orderBy("row_index").collect()
    assert all(r.char_count <= 1500 and r.page_end >= r.page_number for r in got)
    assert [r.row_index for r in got] == list(range(len(got)))
    assert {r.section_kind for r in got} == {"front", "abstract", "body", "references"}
    kinds = [r.title for r in extraction.sections_of(pages).filter("paper_id = 'p'").orderBy("ordinal").collect()]
    assert kinds == ["", "Abstract", "Introduction", "References"]
    flags = {r.paper_id: r.flags for r in extraction.quality_flags(pages, extraction.chunks_of(pages)).collect()}
    assert flags["q"] == ["empty_document"] and "missing_abstract" not in flags["p"]
    assert spark.range(1).select(extraction.split_long(F.lit("One sentence. " + "x" * 30 + ". Two."), 20).alias("p")).first().p == ["One sentence.", "x" * 30 + ".", "Two."]


def test_persons(spark):
    meta = spark.createDataFrame([("p1", "strong", ["Ada Lovelace", "Alan Turing"], ["A50238883", ""], ["", ""], "T1", 2000), ("p2", "strong", ["Lovelace, Ada"], ["A50238883"], [""], "T2", 2001), ("p3", "weak", ["X Y"], [""], [""], "T3", 0)], "paper_id string, confidence string, authors array<string>, author_ids array<string>, author_orcids array<string>, title string, year int")
    papers = spark.createDataFrame([("p1", "full"), ("p2", "full"), ("p3", "full"), ("p4", "full")], "paper_id string, document_kind string")
    a = persons.author_rows(meta, papers).persist()
    assert a.count() == 3
    c = persons.candidates(a, meta, "lovelace").collect()
    assert len(c) == 1 and c[0].n_papers == 2 and c[0].names == ["Ada Lovelace", "Lovelace, Ada"] and c[0].newest_titles == ["T2", "T1"] and not c[0].ambiguous
    assert persons.coverage(a, papers).first().share == 0.5
    assert [tuple(r) for r in persons.coauthors(a, "A50238883").collect()] == [("A50238883", "name:alan turing", 1)]
    assert persons.select_rows(a, person_keys=[]).count() == 0
    with pytest.raises(DomainError):
        persons.candidates(a, meta, "??")


def test_metadata_merge(spark):
    rows = [(1, "a", "The very same long title of a paper", 2020, ["x"], "1", "", "short", ""), (1, "b", "Other", 2019, ["y"], "1", "10.1/Z", "a longer abstract", "u"), (1, "c", "Third", 0, ["x"], "", "10.1/z", "", "")]
    df = spark.createDataFrame([("r", i, t, y, s, ax, doi, ab, u) for i, (_, _, t, y, s, ax, doi, ab, u) in enumerate(rows)], "run_id string, seq long, title string, year int, sources array<string>, arxiv_id string, doi string, abstract string, url string")
    got = metadata.merge_candidates(df).collect()
    assert len(got) == 1 and got[0].year == 2019 and got[0].sources == ["x", "y"] and got[0].abstract == "a longer abstract" and got[0].doi == "10.1/Z"
    t = spark.createDataFrame([("t1", "Graphs of knowledge for search engines"), ("t2", "Something else entirely, at length")], "title_id string, title string")
    c = spark.createDataFrame([("c1", "Graphs of knowledges for search engine"), ("c2", "unrelated")], "candidate_id string, title string")
    assert [(r.candidate_id, r.title_id) for r in metadata.title_matches(c, t).collect()] == [("c1", "t1")]


def test_evaluation(spark):
    q = spark.createDataFrame([("a", "fact"), ("b", "fact")], "qid string, kind string")
    e = spark.createDataFrame([("a", 1, "p1", "x"), ("a", 2, "p2", "y")], "qid string, rank int, paper_id string, component string")
    x = spark.createDataFrame([("a", "p2"), ("b", "p1")], "qid string, paper_id string")
    scored = evaluation.first_hits(e, x, q)
    r = {r.kind: r for r in evaluation.report(scored, q).collect()}
    assert r[None].hit_rate == 0.5 and r["fact"].mrr == 0.25
    b = spark.createDataFrame([("l", "a", 1), ("l", "b", None)], "label string, qid string, rank int")
    n = spark.createDataFrame([("l", "a", None), ("l", "b", 2)], "label string, qid string, rank int")
    assert {r.qid: r.severity for r in evaluation.compare_ranks(b, n).collect()} == {"a": "regression", "b": "new"}


def test_title_matches_equal_all_pairs(spark):
    import difflib

    rng = random.Random(6)
    base = ["probabilistic transformation representations understanding hierarchical", "graph search", "deep model", "abc", "ab", "a b c d e f g", "retrieval over large document collections"]
    edit = lambda t: "".join(c if rng.random() > 0.06 else rng.choice(["", "x", c + "y"]) for c in t)
    titles = [(f"t{i:03}", edit(rng.choice(base)).strip()) for i in range(120)]
    asked = [("c000", " ".join(w + "s" for w in base[0].split()))] + [(f"c{i:03}", edit(rng.choice(base)).strip()) for i in range(1, 60)]
    titles.append(("t999", base[0]))
    norm = lambda rows, k: {r[0]: r[1] for r in spark.createDataFrame(rows, f"{k} string, title string").select(k, metadata.normalize_title(F.col("title"))).collect()}
    x, y = norm(asked, "candidate_id"), norm(titles, "title_id")
    want = {}
    for c, a in x.items():
        best = min(((-difflib.SequenceMatcher(None, a, b).ratio(), t) for t, b in y.items() if a and b), default=(0, ""))
        if -best[0] >= metadata.SIMILAR:
            want[c] = best[1]
    got = metadata.title_matches(spark.createDataFrame(asked, "candidate_id string, title string"), spark.createDataFrame(titles, "title_id string, title string")).collect()
    assert {r.candidate_id: r.title_id for r in got} == want and "c000" in want
