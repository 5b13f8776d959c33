import json

import pytest

from lexarium.operators import evidence
from lexarium.sources.replay import StoredResponses


def write(folder, name, *rows):
    (folder / name).write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))


@pytest.fixture
def folder(spark, tmp_path):
    spark.dataSource.register(StoredResponses)
    own = tmp_path / "in"
    own.mkdir()
    write(own, "a.json", {"url": "u1", "source": "arxiv", "status": 200, "payload": "<feed/>\n"}, "", {"url": "u2", "source": "openalex", "status": 503, "payload": "busy"})
    write(own, "b.json", "no json", {"url": "u3", "payload": None}, "[1]")
    (own / "_SUCCESS").write_text("")
    return own


WANT = {("a.json", 1, "u1", 200, "<feed/>\n", ""), ("a.json", 3, "u2", 503, "", "HTTP 503"), ("b.json", 1, "", 0, "", "JSONDecodeError"), ("b.json", 2, "u3", 200, "", ""), ("b.json", 3, "", 0, "", "AttributeError")}


def as_set(rows):
    return {(r.path.rsplit("/", 1)[1], r.line, r.url, r.status, r.payload, r.note.split(":")[0]) for r in rows}


def test_table(spark, folder):
    df = spark.read.format("stored_responses").load(f"file://{folder}")
    assert as_set(df.collect()) == WANT and df.rdd.getNumPartitions() == 2
    empty = folder.parent / "empty"
    empty.mkdir()
    assert spark.read.format("stored_responses").load(str(empty)).collect() == []


def test_stream_goes_on_where_it_stopped(spark, folder, tmp_path):
    def run():
        stream = spark.readStream.format("stored_responses").load(f"file://{folder}")
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out").collect()

    first = run()
    assert as_set(first) == WANT and len(first) == 5
    assert len(run()) == 5
    write(folder, "c.json", {"url": "u4", "source": "arxiv", "payload": "x"})
    assert {r.url for r in run()} == {"u1", "u2", "u3", "u4", ""} and len(run()) == 6


def test_discovery_from_stored_responses(spark, folder):
    feed = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2404.16130v2</id><published>2024-04-24</published><title>A long title of one single paper</title><summary>S</summary></entry></feed>'
    write(folder, "d.json", {"url": "u", "source": "arxiv", "payload": feed})
    responses = spark.read.format("stored_responses").load(f"file://{folder}").filter("status = 200").selectExpr("url AS query", "source", "payload")
    owners = spark.createDataFrame([], "kind string, value string, paper_id string")
    got = evidence.discover(responses, owners, spark.createDataFrame([], "title_id string, title string"), 2000).collect()
    assert [(r.arxiv_id, r.status) for r in got] == [("2404.16130", "fresh")]
