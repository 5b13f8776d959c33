"""Records, evidence, sinks and tools on small tables."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from lexarium.errors import DomainError
from lexarium.operators import evaluation, evidence, graph, lexical, records
from lexarium.sources import readers, sinks
from lexarium.tools import STORE_ROWS, Tools


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_corrections(spark):
    none = rows(spark, [], STORE_ROWS)
    papers = rows(spark, [("p",)], "paper_id string")
    first, said = records.correct(none, papers, "p", {"title": "New", "year": 2001}, "seen", ["doi"])
    assert said == {"paper_id": "p", "applied_fields": ["doi", "title", "year"], "previous": {"doi": "", "title": "", "year": 0}}
    second, said = records.correct(first, papers, "p", {"doi": "10.1/x"}, "seen again")
    r = second.collect()
    assert len(r) == 1 and (r[0].title, r[0].doi, r[0].cleared_fields, r[0].evidence) == ("New", "10.1/x", [], "seen; seen again") and first.first().cleared_fields == ["doi"]
    for bad in ({"fields": {}}, {"fields": {"title": " "}}, {"fields": {"year": 3}}, {"fields": {"x": 1}}, {"fields": {"doi": "d"}, "clear": ["doi"]}, {"fields": {"title": "t"}, "evidence": ""}, {"fields": {"title": "t"}, "paper_id": "q"}):
        with pytest.raises(DomainError):
            records.correct(none, papers, **{"paper_id": "p", "evidence": "e", **bad})


def test_store_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/store.json"
    data = [("p2", "resolved", "strong", "T", ["A B"], 2000, "", "10.1/x", "", "", [], [], [], "e"), ("p1", "manual", "strong", "", [], 0, "", "", "", "", [], [], ["doi"], "m"), ("p2", "manual", "strong", "U", [], 0, "", "", "", "", [], [], [], "m")]
    store = rows(spark, data, STORE_ROWS)
    sinks.save_records(store, path, rows(spark, [("p1", "settled", "why")], "paper_id string, status string, reason string"))
    assert sorted(map(str, readers.read_store(spark, path, sinks.STORE_VERSION).select(*store.columns).collect())) == sorted(map(str, store.collect()))
    sinks.save_records(store.limit(1), path)  # reviews stay
    assert [tuple(r) for r in readers.read_reviews(spark, path).collect()] == [("p1", "settled", "why")]
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".tmp")]
    with pytest.raises(DomainError):
        readers.read_store(spark, path, "9")


def test_a_file_is_replaced_in_one_step(spark, tmp_path):
    path = f"file://{tmp_path}/x.json"
    sinks.write_text(spark, path, "one")
    sinks.write_text(spark, path, "two ä")
    assert sinks.read_text(spark, path) == "two ä" and sinks.read_text(spark, f"{path}.none") is None
    with pytest.raises(DomainError):
        (tmp_path / "folder").mkdir()
        (tmp_path / "folder" / "y").write_text("z")
        sinks.write_text(spark, f"file://{tmp_path}/folder", "x")
    assert (tmp_path / "folder" / "y").read_text() == "z"


def test_logs_reports_and_backups(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    for ts, n in (("a", 1), ("b", 2), ("a", 3)):
        sinks.append_rows(rows(spark, [(i,) for i in range(n)], "n int"), log, ts)
    assert {r.run_ts: r["count"] for r in spark.read.parquet(log).groupBy("run_ts").count().collect()} == {"a": 3, "b": 2}
    papers = rows(spark, [("p", "u", 3, 4), ("q", "v", 1, 1)], "paper_id string, source_uri string, n_pages int, n_chunks int")
    sinks.write_quality_report(papers, rows(spark, [("q", ["no_sections"])], "paper_id string, flags array<string>"), f"file://{tmp_path}/report")
    assert "- with flags: 1" in (tmp_path / "report" / "report.md").read_text() and spark.read.text(f"file://{tmp_path}/report/flagged").first().value == "| q | 1 | 1 | no_sections |"
    source = tmp_path / "src"
    (source / "papers").mkdir(parents=True)
    (source / "papers" / "a b.pdf").write_bytes(b"one")
    (source / "list.txt").write_text("two")
    root, target = f"file://{source}", f"file://{tmp_path}/saved"
    assert {r.path: r.action for r in sinks.create_backup(spark, root, target, dry_run=True).collect()} == {"papers/a b.pdf": "copied", "list.txt": "copied"}
    sinks.create_backup(spark, root, target)
    assert (tmp_path / "saved" / "files" / "papers" / "a b.pdf").read_bytes() == b"one" and sinks.verify_backup(spark, target).count() == 0
    (source / "list.txt").write_text("three")
    assert {r.path: r.action for r in sinks.create_backup(spark, root, target).collect()} == {"papers/a b.pdf": "unchanged", "list.txt": "copied"}
    (tmp_path / "saved" / "files" / ".list.txt.crc").unlink()
    (tmp_path / "saved" / "files" / "list.txt").write_text("broken")
    (tmp_path / "saved" / "files" / "papers" / "a b.pdf").unlink()
    assert {r.path: r.finding for r in sinks.verify_backup(spark, target).collect()} == {"list.txt": "mismatched", "papers/a b.pdf": "missing"}
    with pytest.raises(DomainError):
        sinks.create_backup(spark, root, f"{root}/inside")


def test_drafts_keep_a_files_bytes(spark, tmp_path):
    file = tmp_path / "t.md"
    file.write_bytes("| ID | Ä |\r\n|---|---|\r\n| Z3 | x |".encode())
    new = rows(spark, [("p", "B c.pdf", "full", {"doi": "10.1/x"}, ["k"], "S"), ("q", "a.pdf", "full", {}, [], "")], "paper_id string, filename string, document_kind string, identifiers map<string,string>, keywords array<string>, summary string")
    made = sinks.draft_rows(new, rows(spark, [("z.pdf",)], "filename string"), 4)
    assert sinks.append_drafts(made, f"file://{file}") == 2
    lines = file.read_bytes().decode().split("\r\n")
    assert lines[2] == "| Z3 | x |" and lines[3].startswith("| Z4 | a |") and "papers/B%20c.pdf" in lines[4] and lines[5] == ""


def test_gold_and_baselines(spark, tmp_path):
    q = rows(spark, [("b", "fact", "Q2"), ("a", "fact", "Q1")], "qid string, kind string, query string")
    sinks.save_questions(q, f"file://{tmp_path}/gold.json", "note")
    assert [(r.qid, r.query) for r in readers.read_gold(spark, f"file://{tmp_path}/gold.json").collect()] == [("a", "Q1"), ("b", "Q2")]
    print_ = {"n_papers": 2, "parameters": {"k": 5}}
    sinks.save_baseline(rows(spark, [("basic", "a", 1), ("basic", "b", None)], "label string, qid string, rank int"), f"file://{tmp_path}/ranks.json", print_)
    assert {(r.label, r.qid, r["rank"]) for r in readers.read_baseline(spark, f"file://{tmp_path}/ranks.json").collect()} == {("basic", "a", 1), ("basic", "b", None)}
    assert evaluation.differences(sinks.read_fingerprint(spark, f"file://{tmp_path}/ranks.json"), {**print_, "n_papers": 3}) == ["n_papers: 2 -> 3"]
    text = evaluation.render("Run", q, ["qid", "kind"])
    assert "| a | fact |" in text and text.startswith("# Run\n\n| qid | kind |\n|---|---|")


def test_random_baselines_are_seeded(spark):
    members = rows(spark, [(c, f"p{c}{i}") for c in range(6) for i in range(c + 1)], "community_id int, paper_id string")
    asked = rows(spark, [("a",), ("b",)], "qid string")
    drawn = lambda: sorted(map(tuple, evaluation.community_baselines(members, asked, 2, 5).collect()))
    got = drawn()
    assert got == drawn() and {c for s, c, _ in got if s == "largest"} == {5, 4} and len(got) == 2 * 2 * 6


def test_title_candidates_and_checks(spark):
    page = "\n A long enough title of a paper \nabout knowledge graphs\nAda Müller, B. Smith"
    r = rows(spark, [("p", page, "A long enough title of a paper about knowledge graphs", ["Müller, Ada", "Bob Smith", "Carl Gone"]), ("q", " ", "T", ["x"]), ("r", None, None, None)], "paper_id string, page string, title string, authors array<string>")
    assert "a long enough title of a paper about knowledge graphs" in r.select(evidence.title_candidates(F.col("page")).alias("c")).first().c
    got = {x.paper_id: x for x in evidence.check_title_pages(r).withColumns({"v": evidence.verdict(0.5, 0.2), "s": evidence.check_summary()}).collect()}
    assert got["p"].title_ratio == 1.0 and (got["p"].surnames_checked, got["p"].surnames_found, got["p"].v) == (3, 2, "confirmed") and got["p"].s == "title 1.00, authors 2/3 on page 1"
    assert got["q"].v == got["r"].v == "unreadable"
    uncalibrated = evidence.check_title_pages(r).withColumn("v", evidence.verdict()).collect()
    assert {x.v for x in uncalibrated} == {"unconfirmed", "unreadable"}


def test_fetching_by_a_port(spark):
    asked = evidence.request_urls(rows(spark, [("q1", ["graph", "search"]), ("q2", ["x"])], "query_id string, terms array<string>"))
    calls = []

    def get(url):
        calls.append(url)
        if "openalex" in url:
            raise OSError("down")
        return (200, "<feed/>") if "graph" in url else (429, "")

    got = {(r.query_id, r.source): (r.status, r.note) for r in evidence.fetch(asked, get).collect()}
    assert got == {("q1", "arxiv"): (200, ""), ("q1", "openalex"): (0, "OSError: down"), ("q2", "arxiv"): (429, "HTTP 429"), ("q2", "openalex"): (0, "OSError: down")} and len(calls) == 4


def test_discovery(spark):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2404.16130v2</id><published>2024-04-24</published><title>A long title of one single paper</title><summary>S</summary></entry></feed>'
    work = {"results": [{"id": "W", "doi": "https://doi.org/10.48550/arXiv.2404.16130", "title": "A long title of one single paper", "publication_year": 2024}, {"id": "V", "doi": "https://doi.org/10.1/old", "title": "An old paper", "publication_year": 1990}, {"id": "U", "doi": "https://doi.org/10.1/known", "title": "A known paper", "publication_year": 2023}]}
    responses = rows(spark, [("q", "arxiv", atom), ("q", "openalex", json.dumps(work))], "query string, source string, payload string")
    owners = rows(spark, [("doi", "10.1/known", "p1")], "kind string, value string, paper_id string")
    got = evidence.discover(responses, owners, rows(spark, [("t", "Something else")], "title_id string, title string"), 2019).collect()
    assert {(r.arxiv_id, r.doi): (r.status, sorted(r.sources)) for r in got} == {("2404.16130", ""): ("fresh", ["arxiv", "openalex"]), ("", "10.1/known"): ("known_doi", ["openalex"])}


def modularity(edges, at):
    total = sum(w for *_, w in edges)
    degree = {}
    for a, b, w in edges:
        degree[a], degree[b] = degree.get(a, 0) + w, degree.get(b, 0) + w
    inside = sum(w for a, b, w in edges if at[a] == at[b])
    return inside / total - sum(sum(d for x, d in degree.items() if at[x] == c) ** 2 for c in set(at.values())) / (2 * total) ** 2


def sequential(edges, nodes):
    """Local moves of single nodes, in order, until none raises modularity."""
    at = {x: x for x in nodes}
    while True:
        moved = False
        for x in sorted(nodes):
            best = max(sorted({at[y] for a, b, _ in edges for y in (a, b) if x in (a, b)} | {at[x]}), key=lambda c: modularity(edges, {**at, x: c}))
            if modularity(edges, {**at, x: best}) > modularity(edges, at) + 1e-12:
                at[x], moved = best, True
        if not moved:
            return at


def test_communities_are_as_good_as_sequential_ones(spark, tmp_path):
    rng = random.Random(5)
    groups = {f"n{i:02}": i % 4 for i in range(24)}
    edges = [(a, b, round(rng.uniform(0.3, 1), 3)) for a, b in itertools.combinations(groups, 2) if rng.random() < (0.7 if groups[a] == groups[b] else 0.08)]
    n = iter(range(10_000))

    def keep(df):
        path = f"file://{tmp_path}/{next(n)}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    got = graph.louvain(rows(spark, [(x,) for x in groups], "paper_id string"), rows(spark, edges, "source string, target string, weight double"), keep)
    at = {r.paper_id: r.community for r in got.collect()}
    assert modularity(edges, at) >= modularity(edges, sequential(edges, list(groups))) - 0.02


def test_phrases_are_folded_and_near_takes_phrases(spark):
    c = rows(spark, [("a", "p1", "The café of state-of-the-art graph search"), ("b", "p2", "graph model, search of the cafe"), ("c", "p3", "x " * 60 + "graph search")], "chunk_id string, paper_id string, text string")
    pos = lexical.positions(c)
    ids = lambda df: sorted(r.chunk_id for r in df.collect())
    assert ids(lexical.phrase_hits(pos, "café")) == ["a", "b"] and ids(lexical.phrase_hits(pos, "State-of-the-Art")) == ["a"] and ids(lexical.phrase_hits(pos, "graph, search")) == ["a", "c"]
    assert ids(lexical.near_hits(pos, ["graph search", "café"], 6)) == ["a"] and ids(lexical.near_hits(pos, ["graph search", "café"], 4)) == []
    assert ids(lexical.near_hits(pos, ["the cafe", "model"], 2)) == ["b"] and ids(lexical.near_hits(pos, ["graph", "search", "café"], 4)) == ["b"]
    found = lexical.text_matches(pos, lexical.phrase_hits(pos, "graph search"), c, limit=1).collect()
    assert [(r.chunk_id, r.total, r.n_hits) for r in found] == [("a", 2, 1)] and "«graph» «search»" in found[0].snippet
    only = rows(spark, [("p3",)], "paper_id string")
    assert [(r.chunk_id, r.total) for r in lexical.text_matches(pos, lexical.phrase_hits(pos, "graph search"), c, only).collect()] == [("c", 1)]
    for bad in (lambda: lexical.phrase_hits(pos, "!?"), lambda: lexical.phrase_hits(pos, "gr", True), lambda: lexical.near_hits(pos, ["a b", "A, b"], 1)):
        with pytest.raises(DomainError):
            bad()


def test_tools(spark, tmp_path):
    from lexarium.plans import snapshot

    body = {"p1": "Graph search models rank papers by their words and links", "p2": "Graph search needs an index of terms", "p3": "Cooking with herbs and spices at home"}
    data = [(p, f"{p}-c0", 0, t, 1, 1, "Introduction", "full") for p, t in body.items()] + [("p2", "p2-c1", 1, "[1] see 10.1145/1234 for more", 9, 9, "References", "full"), ("p4", "p4-c0", 0, "An abstract of graph search without a full text", 0, 0, "Abstract", "reference"), ("p1", "p1-c1", 1, "doi 10.1145/1234 on the first page", 1, 1, "", "full")]
    chunks = rows(spark, data, "paper_id string, chunk_id string, row_index int, text string, page_number int, page_end int, section_title string, document_kind string")
    (tmp_path / "p1.pdf").write_bytes(b"%PDF-1")
    stub = ("Stub title", ["Ada Lovelace"], ["A50238883"], [], 1950, "Mind", "", "works", "doi:10.1/s")
    papers = rows(spark, [("p1", f"file://{tmp_path}/p1.pdf", "full", {"doi": "10.1145/1234"}, None), ("p2", "file:///gone/p2.pdf", "full", {}, None), ("p3", "file:///gone/p3.pdf", "full", {}, None), ("p4", "file:///x/p4.refjson", "reference", {"doi": "10.1/s"}, stub)], f"paper_id string, source_uri string, document_kind string, identifiers map<string,string>, bibliography {snapshot.BIBLIOGRAPHY}")
    root = f"file://{tmp_path}/index"
    snapshot.build(spark, root, chunks, papers)
    tools = Tools(spark, root, f"file://{tmp_path}/store.json", provider=str.upper)
    hits = tools.search_basic("graph search", 3)["citations"]
    assert [h["rank"] for h in hits] == [1, 2, 3] and hits[-1]["paper_id"] == "p4" and hits[-1]["citation_key"] == "Lovelace1950"
    assert tools.search_basic(" ")["error"]["code"] == "invalid_input" and tools.search_basic("x", 51)["error"]["code"] == "invalid_input"
    assert tools.search_local("graph search", 2, 0)["fan_out"] == [] and len(tools.search_local("graph search", 2)["seeds"]) == 3
    assert tools.search_global("herbs", 1)["communities"][0]["rank"] == 1 and not tools.search_drift("herbs", 1)["fallback"]
    match = tools.search_global("herbs", 1)["communities"][0]
    assert [(r["paper_id"], r["citation_key"]) for r in match["representatives"]] == [("p3", "p3")] and match["size"] == 1
    assert [c["community_id"] for c in tools.search_drift("herbs", 1)["communities"]][0] == match["community_id"]
    fan = tools.search_local("graph search", 2)["fan_out"]
    assert all({"paper_id", "pages", "snippet", "citation_key", "weight"} <= set(r) for r in fan)
    detail = tools.get_paper("p1")
    assert (detail["document_kind"], detail["identifiers"], detail["reference"]["doi"]) == ("full", {"doi": "10.1145/1234"}, "10.1145/1234") and detail["source_uri"].endswith("p1.pdf")
    assert tools.get_paper(" ")["error"]["code"] == "invalid_input"
    assert tools.search_text(phrase="Graph, search")["total"] == 3 and tools.search_text(near=["index", "graph"], paper_ids=["p2"])["matches"][0]["paper_id"] == "p2"
    assert tools.search_text()["error"]["code"] == "invalid_input"
    assert tools.get_paper("p2")["sections"] == ["Introduction", "References"] and tools.get_paper("nope")["error"]["code"] == "not_found"
    assert tools.get_paper_file("p1")["size_bytes"] == 6 and tools.get_paper_file("p2")["reason"] == "file_missing" and tools.get_paper_file("p4")["reason"] == "reference_only"
    assert tools.get_reference("p4")["apa"] == "Lovelace, A. (1950). Stub title. Mind. https://doi.org/10.1/s" and tools.get_reference("p3")["missing"] == ["authors", "year"]
    assert [r["paper_id"] for r in tools.get_citations("p2")["cites"]] == ["p1"] and tools.get_citations("p1")["cited_by_total"] == 1
    assert tools.list_topics(1)["total"] >= 1 and "members" in tools.list_topics(community_id=0) and tools.list_topics(community_id=99)["error"]["code"] == "not_found"
    assert tools.search_authors("lovelace")["candidates"][0]["person_key"] == "A50238883" and tools.search_authors("nobody")["error"]["details"]["coverage"]["total"] == 3
    person = tools.get_author("A50238883")
    assert person["names"] == ["Ada Lovelace"] and person["papers"][0]["paper_id"] == "p4" and tools.get_author("x")["error"]["code"] == "not_found"
    assert [h["paper_id"] for h in tools.search_author_papers("A50238883", "graph")["citations"]] == ["p4"] and tools.get_author_citations("A50238883")["cites"] == []
    answer = tools.answer_question("graph search", "basic", 2, synthesize=True)
    assert answer["generated"] and answer["references"] and not tools.answer_question("graph search", "basic")["generated"]
    assert tools.correct_paper_metadata("p3", "seen", title="A better title", year=1999)["applied_fields"] == ["title", "year"]
    stored = readers.read_store(spark, f"file://{tmp_path}/store.json", sinks.STORE_VERSION)
    snapshot.build(spark, root, chunks, papers, stored=stored)
    assert tools.get_reference("p3")["missing"] == ["authors"] and "A better title" in tools.get_reference("p3")["harvard"]


def test_readers_of_tables_and_lists(spark, tmp_path):
    (tmp_path / "t.md").write_text("| ID | Name | Interner Link | Externer Link/Indetifikator |\n|---|---|---|---|\n| A1 | The  one | [Quelle](papers/a%20b.pdf) | [x](https://doi.org/10.48550/arXiv.2404.16130v2) |\n| Z1 | Draft | [Quelle](papers/c.pdf) | 10.1145/5 |\n| A2 | Bare | [Quelle](papers/d.pdf) | 10.1145/5 |\n| A3 | None | - | - |\n")
    table = readers.markdown_table(spark, f"file://{tmp_path}/t.md")
    got = {r.filename: (r.row_id, r.title, r.doi, r.arxiv_id) for r in readers.curated_entries(table).collect()}
    assert got == {"a b.pdf": ("A1", "The one", "10.48550/arXiv.2404.16130v2", "2404.16130"), "d.pdf": ("A2", "Bare", "10.1145/5", "")}
    assert {r.filename for r in readers.internal_links(table).collect()} == {"a b.pdf", "c.pdf", "d.pdf"}
    feed = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><author><name> Ada  L </name></author><author><name></name></author></entry></feed>'
    assert readers.authors_from_feed(rows(spark, [("q", feed)], "query string, payload string")).first().authors == ["Ada L"]
    paper = rows(spark, [("1.0", "p", {"doi": "d"})], "schema_version string, paper_id string, identifiers map<string,string>")
    sinks.write_papers(paper, f"file://{tmp_path}/papers")
    back = readers.read_papers(spark, f"file://{tmp_path}/papers").first()
    assert (back.paper_id, back.identifiers, back.sections) == ("p", {"doi": "d"}, None)
    assert [r.schema_version for r in readers.schema_versions(spark, f"file://{tmp_path}/papers").collect()] == ["1.0"]


def test_papers_in_files_of_any_layout(spark, tmp_path):
    """Several papers in a file, one a line, come back as they were; so does a file that is one object over many lines."""
    papers = rows(spark, [("1.0", f"p{i}", {"doi": str(i)}) for i in range(6)], "schema_version string, paper_id string, identifiers map<string,string>")
    folder = f"file://{tmp_path}/papers"
    sinks.write_papers(papers.coalesce(1), folder)
    back = lambda: {(r.paper_id, r.identifiers["doi"]) for r in readers.read_papers(spark, folder).collect()}
    assert back() == {(f"p{i}", str(i)) for i in range(6)}
    assert len(readers.schema_versions(spark, folder).collect()) == 6
    (tmp_path / "papers" / "whole.json").write_text(json.dumps({"schema_version": "1.0", "paper_id": "w", "identifiers": {"doi": "w"}, "chunks": []}, indent=2))
    assert len(back()) == 7 and ("w", "w") in back()
    (tmp_path / "papers" / "broken.json").write_text('{"paper_id": "x", "identifiers": {}}\n{"paper_id": \n')
    with pytest.raises(DomainError):
        readers.read_papers(spark, folder)


def test_sections_of_a_run_stand_beside_each_other(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    for section, n in (("a", 1), ("b", 2), ("a", 3)):
        sinks.append_rows(rows(spark, [(n,)], "n int"), log, "t1", section)
    assert {(r.section, r.n) for r in spark.read.parquet(log).collect()} == {("a", 3), ("b", 2)}
