import base64
import gzip
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lexarium.llm import warc


def pages(spark):
    html = '<html lang="en"><head><title>A  title</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- no --><p>One&nbsp;&amp; two<br>three <b>bold</b></p><a href="x">l</a></body></html>'
    return spark.createDataFrame([(1, "http://x.org/", html, "z"), (2, None, None, None), (3, "http://x.org/", "", "q"), (1, "http://x.org/", html, "z")], "page_id long, url string, html string, URL string")


def test_derivatives_are_linked(spark):
    r = warc.responses(pages(spark)).persist()
    d = warc.derive(r, keep=["page_id"]).collect()
    assert len(d) == 8
    ids = {x.record_id for x in r.collect()}
    assert all(x.refers_to in ids and re.fullmatch(r"urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-8[0-9a-f]{3}-a[0-9a-f]{3}-[0-9a-f]{12}", x.record_id) for x in d)
    text = next(x for x in d if x.page_id == 1 and x.record_type == "conversion")
    assert text.content.decode() == "A title\nOne & two\nthree bold\nl"
    assert text.payload_digest == text.block_digest == "sha256:" + hashlib.sha256(text.content).hexdigest()
    meta = next(x for x in d if x.page_id == 1 and x.record_type == "metadata").content.decode()
    assert "title: A title\r\n" in meta and "links: 1" in meta and "http-header: Content-Type: text/html; charset=utf-8" in meta
    assert next(x for x in d if x.page_id == 2 and x.record_type == "conversion").content == b""
    assert warc.derive(warc.responses(pages(spark).limit(0))).count() == 0
    with pytest.raises(ValueError):
        warc.derive(r, keep=["content"])


def test_one_very_long_page_and_a_null_id(spark):
    html = "<p>" + "word &amp; <b>bold</b> <i>x</i>\n" * 40_000
    page = spark.createDataFrame([(None, "u", html)], "page_id long, url string, html string")
    text = next(x for x in warc.derive(warc.responses(page), keep=["page_id"]).collect() if x.record_type == "conversion")
    assert text.content.decode() == "\n".join(["word & bold x"] * 40_000) and text.page_id is None


def test_content_types_and_charsets(spark):
    """Images and encoded bodies have no conversion; single-byte pages are read as such, and broken UTF-8 is marked."""
    bodies = [
        ("text/html; charset=ISO-8859-1", "", "<p>café \u0080</p>".encode("latin-1"), "café €"), ("text/html", "", b"<p>caf\xe9</p>", "caf�"), ("Text/HTML;charset=utf-8", "", "<p>é</p>".encode(), "é"),
        ("text/plain", "", b"a <b> &amp;\n\nc", "a <b> &amp;\n\nc"), ("image/png", "", b"\x89PNG", None), ("application/pdf", "", b"%PDF", None), ("text/html", "Content-Encoding: gzip\r\n", b"\x1f\x8b\x08", None), (None, "", b"<p>x</p>", "x"),
    ]
    head = lambda kind, more: ("HTTP/1.1 200 OK\r\n" + (f"Content-Type: {kind}\r\n" if kind else "") + more + "\r\n").encode()
    rows = [(f"r{i}", "response", head(k, m), b) for i, (k, m, b, _) in enumerate(bodies)] + [("w", "warcinfo", None, b"x"), ("n", "response", None, None)]
    records = spark.createDataFrame(rows, "record_id string, record_type string, http_headers binary, content binary")
    for c in ("warc_date", "target_uri", "payload_digest", "block_digest"):
        records = records.withColumn(c, F.lit(None).cast("string"))
    got = warc.derive(records).collect()
    assert sorted(r.refers_to for r in got if r.record_type == "metadata") == sorted([f"r{i}" for i in range(len(bodies))] + ["n"])
    text = {r.refers_to: bytes(r.content).decode() for r in got if r.record_type == "conversion"}
    assert text == {f"r{i}": want for i, (_, _, _, want) in enumerate(bodies) if want is not None} | {"n": ""}


def test_round_trip(spark, tmp_path):
    """All columns, and every byte of heads and bodies, come back; digests hold afterwards."""
    raw = (b"HTTP/1.1 200 OK\r\nX-Name: caf\xe9\r\n\r\n", b"\xff\xfe\x00\r\n\r\nWARC/1.1\r\nbinary")
    records = warc.responses(pages(spark)).drop("page_id").limit(3)
    digest = "sha256:" + hashlib.sha256(b"".join(raw)).hexdigest()
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(b"info").digest()).decode()
    odd = spark.createDataFrame(
        [("urn:x:1", "response", "2024", "http://é/", "", "application/http", raw[0], "", digest, len(raw[0] + raw[1]), raw[1], [("WARC-IP-Address", "192.0.2.1"), ("WARC-Concurrent-To", "<urn:x:0>")], None), ("urn:x:2", "warcinfo", "2024", "", "", "text/plain", b"", "", sha1, 4, b"info", [], None)],
        warc.RECORD_SCHEMA,
    )
    both = records.unionByName(warc.derive(records)).unionByName(odd).persist()
    members = [bytes(r.member) for r in warc.render_warc(both).collect()]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    (tmp_path / "b.warc").write_bytes(b"".join(gzip.decompress(m) for m in members))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(gzip.decompress(m) for m in members)))
    # derivatives carry no head of their own in the file
    plain = both.withColumn("http_headers", F.when(warc._has_head(), F.col("http_headers")).otherwise(F.lit("").cast("binary")))
    want = sorted(map(str, plain.collect()))
    for name in ("a.warc.gz", "b.warc", "c.warc.gz"):
        got = warc.parse_warc(spark.read.format("binaryFile").load(f"file://{tmp_path}/{name}")).persist()
        assert sorted(map(str, got.collect())) == want
        assert got.filter(~F.coalesce(warc.digest_holds(got), F.lit(False))).count() == 0


def test_damaged_files_give_errors_and_all_other_records(monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 50)
    record = lambda i, n=None: f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <r{i}>\r\nContent-Length: {10 if n is None else n}\r\n\r\n".encode() + b"0123456789" + b"\r\n\r\n"
    zipped = [gzip.compress(record(i)) for i in range(4)]
    read = lambda data: [(r.get("record_id"), r.get("error") is not None) for r in warc._records(data)]
    good = [(f"r{i}", False) for i in range(4)]
    assert read(b"".join(zipped)) == good and read(b"\0\0".join(zipped)) == good
    assert read(b"") == [] and read(b"nothing here") == [(None, True)]
    assert read(zipped[0] + b"other bytes" + zipped[1]) == [good[0], (None, True), good[1]]
    broken = bytearray(zipped[1])
    broken[len(broken) // 2] ^= 0xFF
    got = read(zipped[0] + bytes(broken) + zipped[2])
    assert got[0] == good[0] and got[-1] == good[2] and any(e for _, e in got[1:-1])
    assert read(zipped[0] + zipped[1][:-12])[0] == good[0] and read(zipped[0] + zipped[1][:-12])[-1][1]
    for cut in (record(1, "many"), record(1, -5), record(1, "9" * 30)):
        got = read(record(0) + cut + record(2))
        assert got[0] == good[0] and got[-1] == good[2] and all(e for _, e in got[1:-1]) and len(got) > 2
    assert read(record(0) + record(1, 10_000))[:2] == [good[0], (None, True)]
    assert read(record(0) + b"WARC/1.1\r\nWARC-Type: x") == [good[0], (None, True)]
    rng = random.Random(3)
    whole = b"".join(zipped)
    for _ in range(300):  # whatever the damage, the reader ends and gives rows
        data = bytearray(whole[: rng.randint(0, len(whole))])
        for _ in range(rng.randint(0, 4)):
            if data:
                data[rng.randrange(len(data))] = rng.randrange(256)
        list(warc._records(bytes(data)))


def test_text_of_entities_cells_and_odd_tags(spark):
    import html

    numbers = [38, 60, 62, 0x27, 169, 174, 183, 8211, 8212, 8216, 8217, 8220, 8221, 8230, 171, 187, 8364, 34, 39, 0x4E2D, 0x1F600, 128, 150, 55296, 1114112, 99999999999]
    cases = [("".join(f"a{x};b" for x in (f"&#{n}", f"&#x{n:x}", f"&#X{n:05X}")), html.unescape("".join(f"a&#{n};b" * 3 for n in [n]))) for n in numbers]
    cases += [
        ("&#160;x&nbsp;y", "x y"), ("&amp;#60; &#38;lt; &#38;amp;", "&#60; &lt; &amp;"), ("&#; &#x; &#12 &#zz; 5 &#", "&#; &#x; &#12 &#zz; 5 &#"),
        ("<table><tr><td>a</td><td>b</td></tr><tr><th>c</th></tr></table>", "a b\nc"),
        ('<p>x <a title="x < y" href="q">link</a></p>', "x link"), ('a<script data-x="1<2">var t = 1;</script><style media="a<b">p{}</style>b', "a b"),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, h string").select("i", warc.html_text(F.col("h")).alias("t"))
    got = {r.i: r.t for r in rows.collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
