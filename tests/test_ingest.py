import json

import pytest
from pyspark.sql import functions as F

from lexarium.errors import DomainError
from lexarium.plans import ingest, snapshot, status
from lexarium.sources import readers


def parser(seen):
    """Pages between form feeds; ``seen`` is an accumulator of files that were parsed."""

    def parse(content: bytes) -> list[str]:
        seen.add(1)
        if b"broken" in content:
            raise ValueError("broken")
        return content.decode().split("\f")

    return parse


@pytest.fixture
def light(monkeypatch):
    """A build that writes papers and chunks alone."""

    def tables(spark, base, chunks, papers, *sources):
        chunks.write.parquet(f"{base}/chunks")
        papers.write.parquet(f"{base}/papers")

    monkeypatch.setattr(snapshot, "_tables", tables)


def published(spark, root):
    pointer = json.loads(open(f"{root}/CURRENT").read())
    table = lambda n: spark.read.parquet(f"file://{root}/snapshot={pointer['snapshot']}/{n}")
    papers = {r.source_uri.rsplit("/", 1)[1]: (r.document_kind, dict(r.identifiers), r.n_pages) for r in table("papers").collect()}
    return papers, sorted(r.text for r in table("chunks").collect())


def test_a_folder_over_several_runs(spark, tmp_path, light):
    folder, root = tmp_path / "papers", tmp_path / "root"
    folder.mkdir()
    (folder / "a b.pdf").write_bytes(b"First paper on graphs 10.1234/abc.\fSecond page.")
    (folder / "b.pdf").write_bytes(b"Another paper.")
    (folder / "twin.pdf").write_bytes(b"Another paper.")
    (folder / "bad.pdf").write_bytes(b"broken")
    (folder / "s.refjson").write_text(json.dumps({"document_kind": "reference", "title": "A stub", "abstract": "Of it.", "doi": "10.9/s"}))
    (folder / "note.txt").write_text("other")
    seen = spark.sparkContext.accumulator(0)
    run = lambda **more: ingest.run_ingest(spark, f"file://{folder}", f"file://{root}", parser(seen), **more)

    first = run()
    assert (first["files"], first["extracted"], first["kept"], first["removed"], first["built"]) == (5, 3, 0, 0, True)
    assert list(first["errors"]) == ["bad.pdf"] and first["errors"]["bad.pdf"].startswith("parse_error")
    papers, texts = published(spark, root)
    assert papers == {"a b.pdf": ("full", {"doi": "10.1234/abc"}, 2), "b.pdf": ("full", {}, 1), "s.refjson": ("reference", {"doi": "10.9/s"}, 0)}
    assert "A stub\n\nOf it." in texts and len(texts) == 3

    state = status.status(spark, f"file://{root}", f"file://{folder}")
    assert (state["n_papers"], state["n_identified"], state["n_reference_entries"], state["n_chunks"], state["n_communities"]) == (3, 2, 1, 3, None)
    assert (state["n_files"], state["n_manifest"], state["findings"]) == (5, 4, {"untracked_file": {"n": 1, "names": ["bad.pdf"]}})

    before, n = (root / "CURRENT").read_text(), seen.value
    again = run()
    assert (again["extracted"], again["kept"], again["built"]) == (0, 4, False) and (root / "CURRENT").read_text() == before
    assert seen.value - n <= 2  # the file that can't be read is tried again

    (folder / "a b.pdf").write_bytes(b"First paper, changed.")
    (folder / "s.refjson").unlink()
    (folder / "b.pdf").rename(folder / "c.pdf")
    state = status.status(spark, f"file://{root}", f"file://{folder}")
    assert state["findings"] == {"untracked_file": {"n": 2, "names": ["bad.pdf", "c.pdf"]}, "missing_file": {"n": 2, "names": ["b.pdf", "s.refjson"]}}
    third = run()
    assert (third["extracted"], third["removed"], third["built"]) == (2, 3, True)
    papers, texts = published(spark, root)
    assert set(papers) == {"a b.pdf", "c.pdf"} or set(papers) == {"a b.pdf", "b.pdf"}
    assert texts == ["Another paper.", "First paper, changed."]
    assert len(list((root / "canonical").glob("run=*"))) <= 2 and len(list(root.glob("manifest=*"))) == 1


def test_a_failed_run_changes_nothing(spark, tmp_path, light, monkeypatch):
    folder, root = tmp_path / "papers", tmp_path / "root"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(b"One paper.")
    parse = parser(spark.sparkContext.accumulator(0))
    with pytest.raises(DomainError):
        ingest.run_ingest(spark, f"file://{tmp_path}/none", f"file://{root}", parse)
    ingest.run_ingest(spark, f"file://{folder}", f"file://{root}", parse)
    state = sorted(str(p) for p in root.rglob("*") if not p.name.startswith("."))
    (folder / "b.pdf").write_bytes(b"Two papers.")

    def fails(spark, base, chunks, *rest):
        chunks.write.parquet(f"{base}/chunks")
        raise OSError("disk")

    with monkeypatch.context() as m:
        m.setattr(snapshot, "_tables", fails)
        with pytest.raises(OSError):
            ingest.run_ingest(spark, f"file://{folder}", f"file://{root}", parse)
    assert sorted(str(p) for p in root.rglob("*") if not p.name.startswith(".")) == state
    assert ingest.run_ingest(spark, f"file://{folder}", f"file://{root}", parse)["extracted"] == 1
    assert published(spark, root)[1] == ["One paper.", "Two papers."]


def test_status_of_nothing_and_of_what_differs(spark, tmp_path):
    state = status.status(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/nofolder")
    assert state["published"] is None and state["findings"] == {} and state["n_files"] == 0
    files = spark.createDataFrame([("a",), ("b",)], "name string")
    manifest = spark.createDataFrame([("b", "p1"), ("c", "p2"), ("d", "p2")], "name string, paper_id string")
    stored = spark.createDataFrame([("p2",), ("p3",)], "paper_id string")
    got = sorted(map(tuple, status.findings(files, manifest, stored).collect()))
    assert got == [("missing_file", "c"), ("missing_file", "d"), ("missing_paper", "p1"), ("orphan_paper", "p3"), ("untracked_file", "a")]


def test_old_snapshots_go(spark, tmp_path, light):
    chunks = spark.createDataFrame([("p", "p-c0", "text")], "paper_id string, chunk_id string, text string")
    papers = chunks.select("paper_id", F.lit("u").alias("source_uri"))
    for _ in range(4):
        last = snapshot.build(spark, f"file://{tmp_path}", chunks, papers, history=1)
    assert len(list(tmp_path.glob("snapshot=*"))) == 2 and (tmp_path / f"snapshot={last}").exists()
    assert readers.read_binary is not None
