import json

import pytest
from pyspark.sql import functions as F

from lexarium.errors import DomainError
from lexarium.plans import snapshot
from lexarium.sources import readers
from lexarium.streaming import ingest


def test_stubs_and_lists(spark, tmp_path):
    (tmp_path / "a.refjson").write_text(json.dumps({"document_kind": "reference", "title": "A\u0007 title", "abstract": "Text", "url": "javascript:x"}))
    (tmp_path / "b.refjson").write_text("{broken")
    rows = {r.title: r for r in readers.read_stubs(spark, f"file://{tmp_path}/*.refjson").collect()}
    assert rows["A title"].error is None and rows["A title"].url == "" and rows[""].error in ("parse_error", "constraint_violation")
    (tmp_path / "l.txt").write_text("# head\n10.1145/1 # x\n\n2404.16130\n")
    assert [(r.line_no, r.kind) for r in readers.read_identifier_list(spark, f"file://{tmp_path}/l.txt").collect()] == [(2, "doi"), (4, "arxiv")]


def test_markdown_columns_are_found_by_header(spark, tmp_path):
    (tmp_path / "t.md").write_text("text\n| Id | Titel | Link |\n|---|:--|---|\n| 1 | A | [x](a%20b.pdf) |\n| 2 | B | - |\n")
    rows = readers.markdown_table(spark, f"file://{tmp_path}/t.md").withColumn("t", readers.link_target(F.col("cells")["Link"])).orderBy("line_no").collect()
    assert [r.cells["Titel"] for r in rows] == ["A", "B"] and rows[0].t.target == "a%20b.pdf"


def test_feeds(spark):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/2404.16130v2</id><published>2024-04-24T00:00:00Z</published><title>From\n Local</title><summary>S</summary><arxiv:doi>10.1/x</arxiv:doi></entry></feed>'
    r = readers.parse_arxiv(spark.createDataFrame([("q", atom), ("q", f"<!DOCTYPE x>{atom}")], "query string, payload string")).collect()
    assert len(r) == 1 and (r[0].arxiv_id, r[0].year, r[0].title, r[0].doi) == ("2404.16130", 2024, "From Local", "10.1/x")
    work = {"results": [{"id": "W1", "doi": "https://doi.org/10.1/Y", "title": "T", "publication_year": 2020, "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "open_access": None}]}
    w = readers.parse_openalex(spark.createDataFrame([("q", json.dumps(work))], "query string, payload string")).first()
    assert (w.abstract, w.doi, w.year, w.url) == ("a b a", "10.1/y", 2020, "")


def test_answers(spark):
    rows = [(1, '{"paper_id":"p","doi":"10.1/x"}'), (2, '{"paper_id":"p","title":"t"}'), (3, '{"paper_id":"z","doi":"d"}'), (4, "no json"), (5, '{"paper_id":"q","doi":"d","title":"t"}'), (6, '{"paper_id":"q","x":"y"}')]
    good, bad = readers.parse_answers(spark.createDataFrame(rows, "seq int, answer string"), spark.createDataFrame([("p",), ("q",)], "paper_id string"))
    assert [r.seq for r in good.collect()] == [1]
    assert {r.seq: r.problem for r in bad.collect()} == {2: "second_answer", 3: "unknown_paper", 4: "parse_error", 5: "not_one_suggestion", 6: "unknown_key"}


def test_snapshot_is_published_at_once(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    with pytest.raises(DomainError):
        snapshot.open_index(spark, root)
    rows = [(f"p{i}", f"p{i}-c0", 0, t) for i, t in enumerate(["graph search index", "graph search model", "other words here", "words here again"])]
    chunks = spark.createDataFrame(rows, "paper_id string, chunk_id string, row_index int, text string").withColumns({"page_number": F.lit(1), "page_end": F.lit(1), "section_title": F.lit(""), "document_kind": F.lit("full")})
    papers = chunks.select("paper_id", F.lit("file:///x.pdf").alias("source_uri"))
    first = snapshot.build(spark, root, chunks, papers)
    index = snapshot.open_index(spark, root)
    q = spark.createDataFrame([(1, "graph index")], "query_id int, query string")
    from lexarium.operators import retrieval

    narrow = snapshot.for_terms(index, q)
    assert retrieval.search_basic(narrow, q, 2).orderBy("rank").first().chunk_id == "p0-c0"
    assert "PartitionFilters: [isnotnull(bucket" in narrow.weights._jdf.queryExecution().executedPlan().toString() or "bucket" in narrow.weights._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(DomainError):
        snapshot.build(spark, root, chunks.withColumn("text", F.lit(" ")), papers)
    assert first in snapshot.read_text(spark, f"{root}/CURRENT")


def test_incremental(spark, tmp_path):
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, sha256 string")
    manifest = spark.createDataFrame([("a", "1", "pa", "v"), ("b", "0", "pb", "v"), ("c", "3", "pc", "v")], ingest.MANIFEST_SCHEMA)
    assert [r.name for r in ingest.pending(files, manifest, "v").collect()] == ["b"]
    assert sorted(r.paper_id for r in ingest.stale(manifest, files).collect()) == ["pb", "pc"]
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "x.bin").write_bytes(b"abc")
    seen = []
    for _ in range(2):
        ingest.watch(spark, f"file://{inbox}", f"file://{tmp_path}/ck", lambda df, i: seen.extend(r.sha256 for r in df.select("sha256").collect())).awaitTermination()
    assert len(seen) == 1
