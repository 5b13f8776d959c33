"""WARC derivatives: metadata and plain-text conversion records of responses.

Records are rows (RECORD_SCHEMA) whose headers and blocks are bytes as they came. ``derive`` turns each response into a
metadata and, if its content is text, a conversion record, linked to it by their refers-to identifier, with its headers
and digests carried on. ``parse_warc`` and ``render_warc`` read and write the file format itself, a gzip member for each
record.
"""

from __future__ import annotations

import gzip
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, pick

#: ``http_headers`` is the head of an HTTP block with its blank line; ``other_headers`` are WARC fields without a column
#: of their own, in order; ``error`` says why a record couldn't be read (its other columns are then null).
RECORD_SCHEMA = (
    "record_id string, record_type string, warc_date string, target_uri string, refers_to string, content_type string, http_headers binary, payload_digest string, block_digest string, "
    "content_length long, content binary, other_headers array<struct<name:string,value:string>>, error string"
)

#: From HTML to text: patterns and replacements before and after entities are read. They mean the same to Java and RE2, and
#: match only what changes (a single space between words is no match).
TAG_STEPS = [
    (r"(?i)<!--[\s\S]*?-->|<script\b[^>]*>[\s\S]*?</script\s*>|<style\b[^>]*>[\s\S]*?</style\s*>|</?(?:td|th)\b[^>]*>", " "),
    (r"(?i)</?(?:p|div|br|li|ul|ol|dl|dt|dd|h[1-6]|table|thead|tbody|tr|article|section|aside|header|footer|nav|main|body|head|title|html|blockquote|pre|hr|form|figure)\b[^>]*>", "\n"),
    (r"<[A-Za-z/!?][^>]*>", ""),
]
#: Named entities and their characters; numeric ones are read after them and the ampersand last.
ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "\u00a9", "reg": "\u00ae", "middot": "\u00b7", "ndash": "\u2013", "mdash": "\u2014", "hellip": "\u2026",
    "lsquo": "\u2018", "rsquo": "\u2019", "ldquo": "\u201c", "rdquo": "\u201d", "laquo": "\u00ab", "raquo": "\u00bb", "euro": "\u20ac",
}
#: A numeric entity after its "&#": hexadecimal or decimal digits, as many as a character can have.
NUMERIC = r"^(?:[xX]0*([0-9a-fA-F]{1,6})|0*([0-9]{1,7}));"
#: The characters that HTML reads the numbers 128 to 159 as.
C1 = [c for c in range(128, 160) if c not in (129, 141, 143, 144, 157)]
SPACE_STEPS = [
    (r"\x20[\x20\t\r\f\x0B]+|[\t\r\f\x0B][\x20\t\r\f\x0B]*", " "),
    (r"\x20?\n[\x20\n]*", "\n"),
]
TITLE = r"(?i)<title\b[^>]*>([^<]*)"
LANG = r"(?i)<html\b[^>]*\blang=\"([A-Za-z-]*)\""
LINK = r"(?i)<a\b[^>]*\bhref="


def _numeric(text: Column) -> Column:
    """``text`` with its numeric entities read; an ampersand becomes a named entity, and what is no character U+FFFD."""

    def char(code: Column) -> Column:
        plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        plain = F.translate(plain, "".join(map(chr, C1)), bytes(C1).decode("cp1252"))
        real = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(code == 38, "&amp;").when(code == 160, " ").when(real, plain).otherwise("\ufffd")

    def piece(p: Column) -> Column:
        digits = lambda k: F.regexp_extract(p, NUMERIC, k)
        code = F.coalesce(F.conv(F.nullif(digits(1), F.lit("")), 16, 10).try_cast("long"), digits(2).try_cast("long"), F.lit(0))
        return F.when(p.rlike("^(?:[xX][0-9a-fA-F]+|[0-9]+);"), F.concat(let(code, char), F.regexp_replace(p, "^[^;]*;", ""))).otherwise(F.concat(F.lit("&#"), p))

    read = let(F.split(text, "&#"), lambda parts: F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), piece), "")))
    return F.when(F.contains(text, F.lit("&#")), read).otherwise(text)


def html_text(html: Column) -> Column:
    """The readable text of a page: without comments, scripts, styles and tags, a line for each block."""
    out = html
    for pattern, new in TAG_STEPS:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(new))
    for name, new in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(new))
    out = F.replace(let(out, _numeric), F.lit("&amp;"), F.lit("&"))
    for pattern, new in SPACE_STEPS:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(new))
    return F.btrim(out, F.lit(" \n"))


def _digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def _record_id(*parts: Column) -> Column:
    """A version-8 uuid from the SHA-256 of the parts."""
    h = F.sha2(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]), 256)
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-8"), cut(14, 3), F.lit("-a"), cut(18, 3), F.lit("-"), cut(21, 12))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", warc_date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records (with ``id_col`` in front) of a table of fetched pages, one for each row.

    Nulls: null html is an empty page, a null url an empty target; a null id is kept. Repeated rows each get a record,
    with one id. An empty table gives no rows. Pages are taken whole; further columns are ignored.
    """
    rows = pick(pages, id=id_col, url=url_col, html=html_col).withColumn("content", F.coalesce("html", F.lit("")))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("content").cast("string"), F.lit("\r\n\r\n"))
    rows = rows.withColumn("http_headers", head)
    block = F.concat("http_headers", "content")
    return rows.select(
        F.col("id").alias(id_col), _record_id(F.lit("response"), F.col("id").cast("string"), F.col("url")).alias("record_id"), F.lit("response").alias("record_type"), F.lit(warc_date).alias("warc_date"), F.coalesce("url", F.lit("")).alias("target_uri"), F.lit("").alias("refers_to"),
        F.lit("application/http; msgtype=response").alias("content_type"), F.col("http_headers").cast("binary").alias("http_headers"), _digest(F.col("content")).alias("payload_digest"), _digest(block).alias("block_digest"), F.octet_length(block).cast("long").alias("content_length"), F.col("content").cast("binary").alias("content"),
        F.array().cast("array<struct<name:string,value:string>>").alias("other_headers"), F.lit(None).cast("string").alias("error"),
    )


#: Content types that are HTML (none given counts as HTML), and charset names that are read byte for character.
HTML_TYPES = ["text/html", "application/xhtml+xml", ""]
SINGLE_BYTE = ["iso-8859-1", "latin1", "latin-1", "windows-1252", "cp1252", "us-ascii", "ascii"]


def _header(head: Column, name: str) -> Column:
    """The first value of an HTTP header, '' without one."""
    return F.btrim(F.regexp_extract(head, rf"(?i)\n{name}[ \t]*:([^\r\n]*)", 1))


def block_text(content: Column, charset: Column) -> Column:
    """Bytes as text: by character for the single-byte charsets, else as UTF-8 with U+FFFD for what isn't."""
    single = F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, C1)), bytes(C1).decode("cp1252"))
    return F.when(charset.isin(SINGLE_BYTE), single).otherwise(F.make_valid_utf8(content.cast("string")))


def derive(records: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """A metadata record for each response, and a conversion record if it is HTML or plain text; ``keep`` names further columns to carry on.

    The metadata block lists the title, language, number of links, the response's digests and its header fields. The
    record that a derivative refers to is its response's; ids are made from that id, so that a rerun gives them again.
    ``http_headers`` are the response's. Charsets other than UTF-8 and the single-byte Latin ones are read as UTF-8; a
    body that is still compressed or chunked, an image or any other type has no conversion.

    Nulls: null content is an empty page, null headers are none. Records of other types and those with an error are left
    out. Repeated rows each get their derivatives, with the same ids. An empty table gives no rows. Pages are converted
    whole. ``keep`` must not name a column of RECORD_SCHEMA (ValueError).
    """
    keep = keep or []
    own = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
    if clash := [k for k in keep if k in own]:
        raise ValueError(f"columns of records can't be kept beside them: {clash}")
    rows = records.filter(F.col("record_type") == "response").withColumn("head", F.decode(F.coalesce("http_headers", F.lit("").cast("binary")), "ISO-8859-1"))
    rows = rows.withColumns({"mime": F.lower(_header(F.col("head"), "Content-Type")), "coding": F.lower(F.concat(_header(F.col("head"), "Content-Encoding"), _header(F.col("head"), "Transfer-Encoding")))})
    charset = F.regexp_extract("mime", "charset[ \t]*=[ \t]*[\"']?([^\"';, \t]+)", 1)
    rows = rows.withColumns({"page": block_text(F.coalesce("content", F.lit("").cast("binary")), charset), "kind": F.btrim(F.substring_index("mime", ";", 1)), "plain": F.col("coding").isin("", "identity")})
    headers = F.regexp_replace(F.regexp_replace("head", F.lit("\r\n\r\n$"), F.lit("")), F.lit("\r\n"), F.lit("\r\nhttp-header: "))
    html = F.col("plain") & F.col("kind").isin(HTML_TYPES)
    of_html = lambda value: F.when(html, value).otherwise("")
    title = F.regexp_replace(F.regexp_extract("page", TITLE, 1), F.lit(r"[\x20\t\r\n\f\x0B]+"), F.lit(" "))
    fields = F.concat(
        F.lit("title: "), of_html(title), F.lit("\r\nlanguage: "), of_html(F.regexp_extract("page", LANG, 1)), F.lit("\r\nlinks: "), F.when(html, F.regexp_count("page", F.lit(LINK))).otherwise(0).cast("string"),
        F.lit("\r\nresponse-payload-digest: "), F.coalesce("payload_digest", F.lit("")), F.lit("\r\nresponse-block-digest: "), F.coalesce("block_digest", F.lit("")), F.lit("\r\nhttp-header: "), headers, F.lit("\r\n"),
    )
    text = F.when(html, html_text(F.col("page"))).when(F.col("plain") & (F.col("kind") == "text/plain"), F.col("page"))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("text")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), text.alias("text")),
    )
    made = rows.select(*keep, F.col("record_id").alias("refers_to"), "warc_date", "target_uri", "http_headers", F.explode(kinds).alias("new")).filter("new.text is not null")
    made = made.select(*keep, "refers_to", "warc_date", "target_uri", "http_headers", "new.*")
    digest = _digest(F.col("text"))
    return made.select(
        *keep, _record_id(F.col("record_type"), F.col("refers_to")).alias("record_id"), "record_type", "warc_date", "target_uri", "refers_to", "content_type", "http_headers", digest.alias("payload_digest"), digest.alias("block_digest"),
        F.octet_length("text").cast("long").alias("content_length"), F.col("text").cast("binary").alias("content"), F.array().cast("array<struct<name:string,value:string>>").alias("other_headers"), F.lit(None).cast("string").alias("error"),
    )


#: Header names of the record columns, and record types whose block begins with an HTTP head.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "warc_date": "WARC-Date", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "content_type": "Content-Type", "payload_digest": "WARC-Payload-Digest", "block_digest": "WARC-Block-Digest"}
_BRACKETED = {"record_id", "refers_to"}
WITH_HEAD = ("response", "request")
#: Columns by header name in lower case; the length has no fixed header, as it is always worked out anew.
_COLUMNS = {h.lower(): c for c, h in HEADERS.items()} | {"content-length": "content_length"}
#: Bytes that a worker decompresses at a time, and bytes of records in a batch of rows.
PIECE, BATCH_BYTES = 1 << 20, 16 << 20


def _has_head() -> Column:
    return F.col("record_type").isin(*WITH_HEAD)


def digest_holds(records: DataFrame) -> Column:
    """Whether a record's block has its ``block_digest`` (``sha256:`` in hex, ``sha1:`` in base 32 or hex); null for others or none."""
    block = F.when(_has_head(), F.concat(F.coalesce("http_headers", F.lit("").cast("binary")), F.col("content"))).otherwise(F.col("content"))
    kind, value = F.lower(F.substring_index("block_digest", ":", 1)), F.substring_index("block_digest", ":", -1)
    digits = F.translate(F.upper(value), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV")
    from_base32 = F.concat(*[F.lpad(F.conv(F.substring(digits, 1 + 8 * k, 8), 32, 16), 10, "0") for k in range(4)])
    sha1 = F.upper(F.when(F.length(value) == 32, from_base32).otherwise(value))
    return F.when(kind == "sha256", F.sha2(block, 256) == F.lower(value)).when(kind == "sha1", F.upper(F.sha1(block)) == sha1)


def render_warc(records: DataFrame) -> DataFrame:
    """``record_id, member``: each record as a gzip member; members one after another are a .warc.gz file.

    The block is ``content``, behind ``http_headers`` for responses and requests; its bytes and digests stay as they are.
    Line ends in header values become spaces. Nulls: a null column is no header, null content an empty block; rows with an
    error are left out. Repeated rows give equal members. An empty table gives no rows.
    """
    columns = [*HEADERS, "http_headers", "content", "other_headers", "error"]

    def render(batches):
        one_line = lambda x: " ".join(x.splitlines())
        for batch in batches:
            ids, members = [], []
            for row in batch.to_pylist():
                if row["error"] is not None:
                    continue
                head = ["WARC/1.1"]
                for column, name in HEADERS.items():
                    if value := row[column]:
                        head.append(f"{name}: <{one_line(value)}>" if column in _BRACKETED else f"{name}: {one_line(value)}")
                head += [f"{x['name']}: {one_line(x['value'] or '')}" for x in row["other_headers"] or ()]
                block = row["content"] or b""
                if row["record_type"] in WITH_HEAD:
                    block = (row["http_headers"] or b"") + block
                head.append(f"Content-Length: {len(block)}")
                ids.append(row["record_id"])
                members.append(gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", mtime=0))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(members, pa.binary())], names=["record_id", "member"])

    return records.select(*columns).mapInArrow(render, "record_id string, member binary")


class _Bytes:
    """The bytes of a file, decompressed as they are asked for, whether it is compressed by record, as a whole or not at all."""

    def __init__(self, data: bytes):
        self.data, self.at, self.member, self.inflate = memoryview(data), 0, 0, None
        self.buffer, self.damage = bytearray(), ""
        self.gzipped = data[:2] == b"\x1f\x8b"

    def more(self) -> bool:
        """Another piece into the buffer; false at the end. Where the file is damaged, ``damage`` is set and the buffer left as it is; reading goes on at the next member."""
        while self.at < len(self.data) or (self.inflate and self.inflate.unconsumed_tail):
            if not self.gzipped:
                self.buffer += self.data[self.at : self.at + PIECE]
                self.at += PIECE
                return True
            if self.inflate is None:
                while self.at < len(self.data) and self.data[self.at] == 0:  # padding
                    self.at += 1
                if self.data[self.at : self.at + 3] != b"\x1f\x8b\x08":
                    if self.at < len(self.data):
                        self.damage = "bytes between members"
                    return self._seek()
                self.member, self.inflate = self.at, zlib.decompressobj(31)
            try:
                fed = self.inflate.unconsumed_tail
                if not fed:
                    fed = bytes(self.data[self.at : self.at + PIECE])
                    self.at += len(fed)
                out = self.inflate.decompress(fed, PIECE)
            except zlib.error as e:
                self.damage, self.inflate, self.at = f"damaged member: {e}", None, self.member + 3
                return self._seek()
            if self.inflate.eof:
                self.at -= len(self.inflate.unused_data)
                self.inflate = None
            if out:
                self.buffer += out
                return True
        if self.inflate is not None:
            self.damage, self.inflate = "the file ends within a member", None
        return False

    def _seek(self) -> bool:
        """To the next place that begins like a member."""
        while self.at < len(self.data):
            found = bytes(self.data[self.at : self.at + PIECE + 2]).find(b"\x1f\x8b\x08")
            if found >= 0:
                self.at += found
                return True
            self.at += PIECE
        return False


def _records(data: bytes):
    """The records of a WARC file as dictionaries, read piece by piece; what can't be read is a record with an error."""
    source = _Bytes(data)
    buffer, more = source.buffer, True

    def fill() -> bool:
        nonlocal more
        more = more and not source.damage and source.more()
        return more and not source.damage

    while True:
        # to the next record: line ends between records are skipped, other bytes are reported once
        skipped = False
        while not source.damage:
            del buffer[: len(buffer) - len(buffer.lstrip(b"\r\n"))]
            if buffer.startswith(b"WARC/"):
                break
            if len(buffer) >= 5:
                skipped = True
                found = buffer.find(b"\nWARC/")
                del buffer[: found + 1 if found >= 0 else len(buffer) - 5]
                if found >= 0:
                    break
            if not fill() and not source.damage:
                skipped = skipped or bool(buffer)
                break
        if skipped:
            yield {"error": "bytes that are no record"}
        if source.damage:  # what came before is a part of a record at most
            yield {"error": source.damage}
            source.damage = ""
            buffer.clear()
            continue
        if not buffer.startswith(b"WARC/"):
            return
        while (end := buffer.find(b"\r\n\r\n")) < 0 and fill():
            pass
        if end < 0:
            if not source.damage:
                yield {"error": "the file ends within a record's head"}
                buffer.clear()
            continue
        named, other = {}, []
        for line in bytes(buffer[:end]).split(b"\r\n")[1:]:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name, value = name.strip(), value.strip()
            column = _COLUMNS.get(name.lower())
            if column and column not in named:
                named[column] = value
            elif name:
                other.append({"name": name, "value": value})
        length = named.pop("content_length", "")
        usable = length.isascii() and length.isdigit() and len(length) < 16
        need = end + 4 + int(length) if usable else 0
        while len(buffer) < need and fill():
            pass
        if not usable or len(buffer) < need:
            yield {"error": f"record {named.get('record_id', '')} is cut" if usable else f"no usable Content-Length in record {named.get('record_id', '')}"}
            del buffer[:5]
            continue
        block = bytes(buffer[end + 4 : need])
        del buffer[:need]
        row = {c: named.get(c, "") for c in HEADERS}
        row |= {c: row[c].strip("<>") for c in _BRACKETED}
        head = b""
        if row["record_type"] in WITH_HEAD and b"\r\n\r\n" in block:
            cut = block.index(b"\r\n\r\n") + 4
            head, block = block[:cut], block[cut:]
        yield row | {"http_headers": head, "content_length": int(length), "content": block, "other_headers": other}


def parse_warc(files: DataFrame) -> DataFrame:
    """Records of WARC files given as ``content`` binary (``spark.read.format("binaryFile")``): RECORD_SCHEMA.

    A file is decompressed piece by piece, and rows leave in batches of bounded bytes. A record that is damaged or cut, and
    bytes that are no record, give a row with ``error`` alone; reading goes on at the next record. Nulls: a null or
    empty file has no records. Repeated rows are read each. An empty table gives no rows.
    """
    fields = {"http_headers": pa.binary(), "content": pa.binary(), "content_length": pa.int64(), "other_headers": pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))}
    schema = pa.schema([(c, fields.get(c, pa.string())) for c in (x.split()[0] for x in RECORD_SCHEMA.split(", "))])

    def parse(batches):
        rows, size = [], 0
        for batch in batches:
            for data in batch.column("content"):
                for record in _records(data.as_py() or b""):
                    rows.append(record)
                    size += len(record.get("content") or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("content").mapInArrow(parse, RECORD_SCHEMA)


#: The records that the query derives from pages, written for SQL alone. It reads the named entities and three numeric
#: ones of the test pages; a tag ends at the first ">".
SQL = r"""
WITH r AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS page,
         sha256(concat_ws(chr(10), 'response', coalesce(page_id::varchar, ''), coalesce(url, ''))) AS h,
         'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) AS lines
  FROM pages),
n AS (
  SELECT *, 'urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-8' || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS refers_to, lines || chr(13) || chr(10) AS http_headers FROM r),
bare AS (
  SELECT *, regexp_replace(page, '<!--(?:.|\n)*?-->|(?i:<script[ />](?:.|\n)*?</script *>)|(?i:<style[ />](?:.|\n)*?</style *>)|</?(?i:td|th)(?:[ /][^>]*)?>', ' ', 'g') AS t FROM n),
parted AS (
  SELECT *, regexp_replace(regexp_replace(t, '</?(?i:p|div|br|li|ul|ol|dl|dt|dd|h1|h2|h3|h4|h5|h6|table|thead|tbody|tr|article|section|aside|header|footer|nav|main|body|head|title|html|blockquote|pre|hr|form|figure)(?:[ /][^>]*)?>', chr(10), 'g'), '</?[A-Za-z!?][^>]*>', '', 'g') AS u FROM bare),
spelt AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(u,
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&copy;', '©'), '&reg;', '®'), '&middot;', '·'), '&ndash;', '–'), '&mdash;', '—'), '&hellip;', '…'),
    '&lsquo;', '‘'), '&rsquo;', '’'), '&ldquo;', '“'), '&rdquo;', '”'), '&laquo;', '«'), '&raquo;', '»'), '&euro;', '€'), '&#39;', chr(39)), '&#34;', '"') AS v FROM parted),
made AS (
  SELECT page_id, target_uri, refers_to, http_headers, 'conversion' AS record_type, 'text/plain; charset=utf-8' AS content_type,
         array_to_string(list_filter(list_transform(string_split(replace(replace(v, '&#160;', ' '), '&amp;', '&'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f\v]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS content FROM spelt
  UNION ALL
  SELECT page_id, target_uri, refers_to, http_headers, 'metadata', 'application/warc-fields',
         'title: ' || regexp_replace(regexp_extract(page, '<(?i:title)(?: [^>]*)?>([^<]*)', 1), '[ \t\r\n\f\v]+', ' ', 'g') || chr(13) || chr(10)
         || 'language: ' || regexp_extract(page, '<(?i:html)(?: [^>]*)? (?i:lang)="([A-Za-z-]*)"', 1) || chr(13) || chr(10)
         || 'links: ' || len(regexp_extract_all(page, '<(?i:a) (?:[^>]* )?(?i:href)=')) || chr(13) || chr(10)
         || 'response-payload-digest: sha256:' || sha256(page) || chr(13) || chr(10)
         || 'response-block-digest: sha256:' || sha256(http_headers || page) || chr(13) || chr(10)
         || array_to_string(list_transform(string_split(rtrim(lines, chr(13) || chr(10)), chr(13) || chr(10)), lambda x: 'http-header: ' || x), chr(13) || chr(10)) || chr(13) || chr(10)
  FROM n),
ids AS (SELECT *, sha256(record_type || chr(10) || refers_to) AS h FROM made)
SELECT page_id, 'urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-8' || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS record_id,
       record_type, '2024-01-01T00:00:00Z' AS warc_date, target_uri, refers_to, content_type, http_headers, 'sha256:' || sha256(content) AS payload_digest, 'sha256:' || sha256(content) AS block_digest,
       octet_length(encode(content))::bigint AS content_length, content
FROM ids
"""
