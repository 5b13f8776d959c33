import json

from lexarium.operators import evidence
from lexarium.sources import readers

SCHEMA = "line_no int, title string, authors array<string>, author_ids array<string>, author_orcids array<string>, year int, venue string, doi string, arxiv_id string, url string, abstract string, source string, source_url string, note string"


def answer(n, title="", abstract="", doi="", arxiv="", source="works", note=""):
    return (n, title, ["Ada L"] if title else None, [], [], 2020, "V", doi, arxiv, "", abstract, source, "http://x", note)


def test_a_list_is_resolved(spark, tmp_path):
    pending = spark.createDataFrame([(1, "doi", "10.1/a"), (2, "doi", "10.1/b"), (3, "arxiv", "2404.1"), (4, "arxiv", "2404.2"), (5, "doi", "10.1/c"), (6, "doi", "10.1/d"), (7, "arxiv", "2404.3")], "line_no int, kind string, value string")
    works = spark.createDataFrame([answer(1, "Whole", "Of it"), answer(2, "No abstract", arxiv="2001.5"), answer(3, "Preprint", doi="10.9/p"), answer(4, note="HTTP 404"), answer(5, "No abstract, no id"), answer(6, note="HTTP 500")], SCHEMA)
    feeds = spark.createDataFrame([answer(1, "Other", "Unasked", source="feed"), answer(2, "Other", "Lent", source="feed"), answer(4, "By the feed", "F", source="feed"), answer(5, "x", "never asked", source="feed"), answer(7, note="empty feed")], SCHEMA)
    got = {r.line_no: r for r in evidence.resolve_references(pending, works, feeds).collect()}
    short = {n: (r.action, r.title, r.abstract, r.doi, r.arxiv_id, r.source, r.note) for n, r in got.items()}
    assert short == {
        1: ("written", "Whole", "Of it", "10.1/a", "", "works", ""),
        2: ("written", "No abstract", "Lent", "10.1/b", "2001.5", "works", ""),
        3: ("written", "Preprint", "", "10.9/p", "2404.1", "works", "add the abstract by hand"),
        4: ("written", "By the feed", "F", "", "2404.2", "feed", ""),
        5: ("written", "No abstract, no id", "", "10.1/c", "", "works", "add the abstract by hand"),
        6: ("unresolved", "", "", "10.1/d", "", "", "HTTP 500"),
        7: ("unresolved", "", "", "", "2404.3", "", "empty feed"),
    }
    asked = {(r.line_no, r.source, r.identifier) for r in evidence.reference_requests(pending.filter("line_no < 4")).collect()}
    assert asked == {(1, "works", "10.1/a"), (2, "works", "10.1/b"), (3, "works", "10.48550/arXiv.2404.1"), (3, "feed", "2404.1")}

    inbox = f"file://{tmp_path}/in"
    (tmp_path / "in").mkdir()
    assert evidence.process_references(evidence.resolve_references(pending, works, feeds), inbox, "2024-01-01T00:00:00Z") == 5
    stubs = readers.read_stubs(spark, f"{inbox}/*.refjson").collect()
    assert {s.title for s in stubs} == {"Whole", "No abstract", "Preprint", "By the feed", "No abstract, no id"} and all(s.error is None for s in stubs)

    waiting = {(r.kind, r.value): r.quarantined for r in readers.waiting_stubs(spark, inbox).collect()}
    assert waiting[("doi", "10.1/a")] is False and waiting[("arxiv", "2404.2")] is False and ("doi", "10.1/d") not in waiting
    plan = evidence.plan_references(pending, spark.createDataFrame([], "kind string, value string, paper_id string"), readers.waiting_stubs(spark, inbox))
    assert {r.line_no for r in plan.filter("action = 'pending'").collect()} == {6, 7}


def test_stubs_that_wait(spark, tmp_path):
    inbox = tmp_path / "in"
    (inbox / "quarantine").mkdir(parents=True)
    (inbox / "any name.refjson").write_text(json.dumps({"doi": " 10.1/UP ", "requested": "https://arxiv.org/abs/cs/0112017"}, indent=1))
    (inbox / "broken.refjson").write_text("{")
    (inbox / "list.refjson").write_text("[1]")
    (inbox / "quarantine" / "q.refjson").write_text(json.dumps({"doi": "10.1/up", "arxiv_id": "2404.9"}))
    got = {(r.kind, r.value): r.quarantined for r in readers.waiting_stubs(spark, f"file://{inbox}").collect()}
    assert got == {("doi", "10.1/up"): False, ("arxiv", "cs/0112017"): False, ("arxiv", "2404.9"): True}
    assert readers.waiting_stubs(spark, f"file://{tmp_path}/none").collect() == []
    assert evidence.resolve_references(spark.createDataFrame([], "line_no int, kind string, value string"), *[spark.createDataFrame([], SCHEMA)] * 2).collect() == []
