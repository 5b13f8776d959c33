"""Readers: files to rows, with explicit schemas; what can't be read becomes a row with an error, not a failure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import DomainError
from ..functions.names import normalize_identifier
from ..functions.text import printable, safe_url

PAPER_SCHEMA = (
    "schema_version string, paper_id string, source_uri string, source_sha256 string, document_kind string, n_pages int, identifiers map<string,string>, quality_flags array<string>, "
    "sections array<struct<section_id:string,title:string,kind:string,level:int,page_number:int,order:int>>, "
    "chunks array<struct<chunk_id:string,paper_id:string,page_number:int,page_end:int,text:string,char_count:int,section_id:string,section_title:string>>, "
    "bibliography struct<title:string,authors:array<string>,author_ids:array<string>,author_orcids:array<string>,year:int,venue:string,url:string,source:string,requested:string>"
)
STUB_SCHEMA = "schema_version string, document_kind string, requested string, title string, authors array<string>, year int, venue string, doi string, arxiv_id string, url string, source string, source_url string, retrieved_at string, note string, abstract string, author_ids array<string>, author_orcids array<string>, _corrupt string"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Papers (``paper_id, page_number, text``) of a table of documents (doc_id, text): one page each."""
    docs = spark.read.parquet(path)
    return docs.select(F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("paper_id"), F.lit(1).alias("page_number"), F.coalesce("text", F.lit("")).alias("text"))


def read_binary(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]], glob: str = "*.pdf") -> DataFrame:
    """``path, paper_id, sha256, page_number, text, error`` of files: the id is the first 16 digits of the content's hash.

    ``parse`` turns a file's bytes into page texts; a file that it fails on is one row with the error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")
    return parse_binary(files.withColumn("sha256", F.sha2("content", 256)), parse)


def parse_binary(files: DataFrame, parse: Callable[[bytes], list[str]]) -> DataFrame:
    """``path, paper_id, sha256, page_number, text, error`` of files (``path, content, sha256``): see ``read_binary``."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for p, content, digest in zip(pdf["path"], pdf["content"], pdf["sha256"]):
                try:
                    rows += [(p, digest[:16], digest, i + 1, text, None) for i, text in enumerate(parse(bytes(content)))]
                except Exception as e:  # a file of the user's: reported, not fatal
                    rows.append((p, digest[:16], digest, 0, None, f"parse_error: {e}"))
            yield pd.DataFrame(rows, columns=["path", "paper_id", "sha256", "page_number", "text", "error"])

    return files.select("path", "content", "sha256").mapInPandas(run, "path string, paper_id string, sha256 string, page_number int, text string, error string")


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """Canonical papers as JSON; fields that older versions lack are null."""
    return _objects(spark, path, PAPER_SCHEMA, "paper_id").drop("_path")


def schema_versions(spark: SparkSession, path: str) -> DataFrame:
    """``path, schema_version`` of canonical papers; only that field and the id are parsed."""
    return _objects(spark, path, "schema_version string, paper_id string", "paper_id").select(F.col("_path").alias("path"), "schema_version")


def _objects(spark: SparkSession, path: str, schema: str, needed: str) -> DataFrame:
    """Objects of JSON files with their ``_path``: one a line, or one that is all of its file.

    A file without a line that is an object is read as a whole. A file that has lines of both kinds is damaged, which is an error.
    """
    named = F.col("_metadata.file_path").alias("_path")
    fields = StructType.fromDDL(schema).names
    lines = spark.read.schema(f"{schema}, _corrupt string").json(path, columnNameOfCorruptRecord="_corrupt").select(*fields, "_corrupt", named)
    good = F.col(needed).isNotNull() & F.col("_corrupt").isNull()
    kinds = lines.groupBy("_path").agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"))
    mixed = kinds.filter("good > 0 and bad > 0").limit(1).collect()
    if mixed:
        raise DomainError("parse_error", f"lines of {mixed[0]._path} are not papers")
    lines = lines.filter(good).drop("_corrupt")
    whole = kinds.filter("good = 0").select("_path")
    if whole.isEmpty():
        return lines
    objects = spark.read.schema(schema).json(path, multiLine=True).select(*fields, named)
    return lines.unionByName(objects.join(whole, "_path", "left_semi").select(*fields, "_path").filter(F.col(needed).isNotNull()))


def read_stubs(spark: SparkSession, path: str) -> DataFrame:
    """Reference stubs: validated, printable, cut to length; ``error`` says what is wrong with a file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))
    return parse_stubs(files).drop("path")


def parse_stubs(files: DataFrame) -> DataFrame:
    """``files`` with a ``payload`` each (the text of a stub) and the stub's fields in its place."""
    rows = files.withColumn("s", F.from_json("payload", STUB_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    rows = rows.select(*[c for c in files.columns if c not in ("payload", "content")], "s.*")
    limits = {"title": 500, "venue": 300, "doi": 200, "arxiv_id": 50, "source": 100, "note": 500, "abstract": 10_000}
    rows = rows.withColumns({c: printable(F.coalesce(c, F.lit("")), n) for c, n in limits.items()}).withColumn("url", safe_url(F.coalesce("url", F.lit(""))))
    wrong = F.coalesce("document_kind", F.lit("")) != "reference"
    error = F.when(F.col("_corrupt").isNotNull(), "parse_error").when(wrong, "constraint_violation").when(F.col("title") == "", "invalid_input")
    return rows.withColumn("error", error).drop("_corrupt")


def waiting_stubs(spark: SparkSession, inbox: str) -> DataFrame:
    """``kind, value, path, quarantined``: the identifiers in the stubs of an inbox and its quarantine, whatever the files are called.

    Each identifier has one row: the inbox goes before the quarantine, then the first path. Files that can't be read have none.
    """
    from .sinks import exists

    folders = [(f, q) for f, q in ((inbox, False), (f"{inbox}/quarantine", True)) if exists(spark, f)]
    out = spark.createDataFrame([], "path string, payload string, quarantined boolean")
    for folder, quarantined in folders:
        files = spark.read.option("pathGlobFilter", "*.refjson").text(folder, wholetext=True)
        out = out.unionByName(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"), F.lit(quarantined).alias("quarantined")))
    stub = F.from_json("payload", "doi string, arxiv_id string, requested string")
    asked = normalize_identifier(F.coalesce("s.requested", F.lit("")))
    plain = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    ids = F.array(F.struct(F.lit("doi").alias("kind"), plain("s.doi").alias("value")), F.struct(F.lit("arxiv").alias("kind"), plain("s.arxiv_id").alias("value")), F.struct(asked["kind"].alias("kind"), F.lower(asked["value"]).alias("value")))
    rows = out.withColumn("s", stub).select("path", "quarantined", F.explode(ids).alias("x")).select("path", "quarantined", "x.*").filter("kind <> '' and value <> ''")
    return rows.groupBy("kind", "value").agg(F.min(F.struct("quarantined", "path")).alias("m")).select("kind", "value", "m.path", "m.quarantined")


def stub_chunks(stubs: DataFrame) -> DataFrame:
    """Each valid stub (with paper_id) as one chunk of title and abstract, page 0, kind ``reference``."""
    text = F.trim(F.concat_ws("\n\n", "title", F.when(F.col("abstract") != "", F.col("abstract"))))
    return stubs.filter("error is null").select(
        "paper_id", F.concat("paper_id", F.lit("-c0000")).alias("chunk_id"), F.lit(0).alias("row_index"), F.concat("paper_id", F.lit("-s000")).alias("section_id"), F.lit("Abstract").alias("section_title"), F.lit("abstract").alias("section_kind"),
        F.lit(0).alias("page_number"), F.lit(0).alias("page_end"), text.alias("text"), F.length(text).alias("char_count"), F.lit("reference").alias("document_kind"),
    )


def markdown_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a markdown table as ``line_no, cells`` (map from header text to cell); columns are found by header, not place."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "line")).filter(F.trim("line").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"(?<!\\)\|"), lambda c: F.trim(c))
    rows = text.select("line_no", cells.alias("c"))
    rule = F.forall("c", lambda x: x.rlike("^:?-+:?$"))
    head = rows.filter(rule).agg(F.min("line_no").alias("at"))
    head = rows.crossJoin(F.broadcast(head)).filter(F.col("line_no") == F.col("at") - 1).select("at", F.col("c").alias("names"))
    body = rows.filter(~rule).crossJoin(F.broadcast(head)).filter(F.col("line_no") > F.col("at"))
    return body.select("line_no", F.map_from_arrays(F.slice("names", F.lit(1), F.size("c")), F.slice("c", F.lit(1), F.least(F.size("c"), F.size("names")))).alias("cells"))


#: Headers of the curated table, and the shape of a draft row's id: fixed values.
INTERNAL, EXTERNAL, NAME, DRAFT = "Interner Link", "Externer Link/Indetifikator", "Name", "^Z[0-9]+$"


def curated_cells(rows: DataFrame) -> DataFrame:
    """``row_id, filename, title, cells`` of the rows of a curated table (``line_no, cells``) that aren't drafts and name a file; the last of a file counts."""
    from pyspark.sql import Window

    row_id = F.trim(F.coalesce(F.col("cells")["ID"], F.lit("")))
    target = link_target(F.coalesce(F.col("cells")[INTERNAL], F.lit("")))["target"]
    name = F.regexp_replace(F.trim(target), "^[^/]*/", "")
    name = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    own = rows.withColumns({"row_id": row_id, "filename": name, "title": F.trim(F.regexp_replace(F.coalesce(F.col("cells")[NAME], F.lit("")), r"\s+", " "))})
    own = own.filter((F.col("row_id") != "") & ~F.col("row_id").rlike(DRAFT) & (F.col("filename") != ""))
    last = F.row_number().over(Window.partitionBy("filename").orderBy(F.desc("line_no")))
    return own.withColumn("_r", last).filter("_r = 1").select("row_id", "filename", "title", "cells")


def parse_identifiers(cell: Column) -> Column:
    """Struct (doi, arxiv_id, url) of a cell of links: the first of each kind; a preprint's DOI gives its id too."""
    links = F.regexp_extract_all(cell, F.lit(r"\]\(<?([^)>]*)>?\)"), F.lit(1))
    links = F.when(F.size(links) > 0, links).otherwise(F.array(F.trim(cell)))
    first = lambda pattern, k=1: F.coalesce(F.get(F.filter(F.transform(links, lambda x: F.regexp_extract(x, pattern, k)), lambda x: x != ""), F.lit(0)), F.lit(""))
    doi = first(r"^(?:(?i:https?://(?:dx\.)?doi\.org/))?(10\.\d{4,9}/\S+)$")
    arxiv = F.regexp_replace(first(r"(?i)^https?://arxiv\.org/(?:abs|pdf)/([^\s?#]+?)(?:\.pdf)?$"), r"v\d+$", "")
    preprint = F.regexp_replace(F.regexp_extract(doi, r"(?i)^10\.48550/arxiv\.(.+)$", 1), r"v\d+$", "")
    other = first(r"(?i)^(https?://(?!(?:dx\.)?doi\.org/|arxiv\.org/)\S+)$")
    return F.struct(doi.alias("doi"), F.when(arxiv == "", preprint).otherwise(arxiv).alias("arxiv_id"), other.alias("url"))


def curated_entries(rows: DataFrame) -> DataFrame:
    """``row_id, filename, title, doi, arxiv_id, url`` of the rows of a curated table."""
    own = curated_cells(rows).withColumn("x", parse_identifiers(F.coalesce(F.col("cells")[EXTERNAL], F.lit(""))))
    return own.select("row_id", "filename", "title", "x.doi", "x.arxiv_id", "x.url")


def internal_links(rows: DataFrame) -> DataFrame:
    """``filename`` of all files that a table links to, drafts too."""
    target = link_target(F.coalesce(F.col("cells")[INTERNAL], F.lit("")))["target"]
    name = F.url_decode(F.replace(F.regexp_replace(F.trim(target), "^[^/]*/", ""), F.lit("+"), F.lit("%2B")))
    return rows.select(name.alias("filename")).filter("filename <> ''").distinct()


def link_target(cell: Column) -> Column:
    """Label and target of a markdown link, else the cell and ''."""
    return F.struct(F.coalesce(F.nullif(F.regexp_extract(cell, r"\[([^\]]*)\]\(", 1), F.lit("")), cell).alias("label"), F.regexp_extract(cell, r"\]\(<?([^)>]*)>?\)", 1).alias("target"))


def read_identifier_list(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, text, kind, value`` of a list of identifiers, one a line, ``#`` comments left out."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("i", "line"))
    rows = rows.select((F.col("i") + 1).alias("line_no"), F.trim(F.substring_index("line", "#", 1)).alias("text")).filter("text <> ''")
    return rows.withColumn("x", normalize_identifier(F.col("text"))).select("line_no", "text", "x.kind", "x.value")


ATOM = "struct<entry:array<struct<id:string,published:string,title:string,summary:string,doi:string>>>"


def parse_arxiv(responses: DataFrame) -> DataFrame:
    """Candidates of Atom feeds (``query, payload``); a feed with a document type or entities is refused."""
    clean = F.regexp_replace("payload", "<(/?)arxiv:", "<$1")
    bad = F.col("payload").rlike("<!(DOCTYPE|ENTITY)")
    feed = F.from_xml(F.when(~bad, clean), ATOM, {"rowTag": "feed"})
    rows = responses.select("query", F.explode(feed["entry"]).alias("e"))
    one = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    arxiv = F.regexp_replace(F.regexp_extract("e.id", r"abs/(.+)$", 1), r"v\d+$", "")
    return rows.select("query", one(F.col("e.title")).alias("title"), F.coalesce(F.substring("e.published", 1, 4).try_cast("int"), F.lit(0)).alias("year"), F.array(F.lit("arxiv")).alias("sources"), arxiv.alias("arxiv_id"), F.coalesce("e.doi", F.lit("")).alias("doi"), one(F.coalesce("e.summary", F.lit(""))).alias("abstract"), F.col("e.id").alias("url"))


def authors_from_feed(responses: DataFrame) -> DataFrame:
    """``query, authors``: the names of the first entry of each feed; none for one that can't be read."""
    bad = F.col("payload").rlike("<!(DOCTYPE|ENTITY)")
    feed = F.from_xml(F.when(~bad, F.col("payload")), "struct<entry:array<struct<author:array<struct<name:string>>>>>", {"rowTag": "feed"})
    named = F.transform(F.get(feed["entry"], F.lit(0))["author"], lambda a: F.trim(F.regexp_replace(F.coalesce(a["name"], F.lit("")), r"\s+", " ")))
    return responses.select("query", F.coalesce(F.filter(named, lambda x: x != ""), F.array().cast("array<string>")).alias("authors"))


WORKS = "struct<results:array<struct<id:string,doi:string,title:string,publication_year:int,open_access:struct<oa_url:string>,primary_location:struct<license:string,source:struct<display_name:string>>,abstract_inverted_index:map<string,array<int>>,authorships:array<struct<author:struct<id:string,display_name:string,orcid:string>>>>>>"


def restored_abstract(index: Column) -> Column:
    """The text of an inverted index (word -> places): words by place, ties by word."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def parse_openalex(responses: DataFrame) -> DataFrame:
    """Candidates of work lists (``query, payload``)."""
    rows = responses.select("query", F.explode(F.from_json("payload", WORKS)["results"]).alias("w"))
    doi = F.regexp_replace(F.lower(F.coalesce("w.doi", F.lit(""))), r"^https?://(dx\.)?doi\.org/", "")
    arxiv = F.regexp_extract(doi, r"^10\.48550/arxiv\.(.+)$", 1)
    return rows.select(
        "query", F.coalesce("w.title", F.lit("")).alias("title"), F.coalesce("w.publication_year", F.lit(0)).alias("year"), F.array(F.lit("openalex")).alias("sources"), arxiv.alias("arxiv_id"), F.when(arxiv == "", doi).otherwise("").alias("doi"),
        F.coalesce(restored_abstract(F.col("w.abstract_inverted_index")), F.lit("")).alias("abstract"), F.coalesce("w.open_access.oa_url", F.lit("")).alias("url"), F.coalesce("w.primary_location.license", F.lit("")).alias("license"),
        F.coalesce("w.primary_location.source.display_name", F.lit("")).alias("venue"), F.coalesce(F.transform(F.slice("w.authorships", 1, 25), lambda a: a["author"]["display_name"]), F.array().cast("array<string>")).alias("authors"),
        F.coalesce(F.transform(F.slice("w.authorships", 1, 25), lambda a: F.regexp_extract(F.coalesce(a["author"]["id"], F.lit("")), r"(A\d+)$", 1)), F.array().cast("array<string>")).alias("author_ids"),
    )


WORK = WORKS[len("struct<results:array<") : -len(">>")]


def raw_authorships(responses: DataFrame) -> DataFrame:
    """``doi, names, author_ids, author_orcids, source`` of works in stored responses (``path, payload``) that give any person's id.

    A response is a single work or a list; at most 25 authors of a work count, those without a name don't.
    """
    from ..functions.names import aligned_identifiers, openalex_author_id, orcid
    from ..functions.text import printable

    many, one = F.from_json("payload", WORKS)["results"], F.from_json("payload", WORK)
    works = responses.select(F.col("path").alias("source"), F.explode(F.when(many.isNotNull(), many).otherwise(F.array(one))).alias("w"))
    own = F.filter(F.col("w.authorships"), lambda a: F.trim(F.coalesce(a["author"]["display_name"], F.lit(""))) != "")
    rows = works.withColumn("a", F.slice(F.coalesce(own, F.array().cast(f"array<{AUTHORSHIP}>")), 1, 25))
    doi = F.lower(F.trim(F.regexp_replace(F.trim(F.coalesce("w.doi", F.lit(""))), r"(?i)^(https?://(dx\.)?doi\.org/|doi:)", "")))
    names = F.transform("a", lambda x: printable(x["author"]["display_name"], 200))
    rows = rows.select(doi.alias("doi"), names.alias("names"), F.transform("a", lambda x: openalex_author_id(F.coalesce(x["author"]["id"], F.lit("")))).alias("ids"), F.transform("a", lambda x: orcid(F.coalesce(x["author"]["orcid"], F.lit("")))).alias("orcids"), "source")
    rows = rows.select("doi", "names", aligned_identifiers(F.col("names"), F.col("ids")).alias("author_ids"), aligned_identifiers(F.col("names"), F.col("orcids")).alias("author_orcids"), "source")
    return rows.filter((F.col("doi") != "") & ((F.size("author_ids") > 0) | (F.size("author_orcids") > 0)))


AUTHORSHIP = "struct<author:struct<id:string,display_name:string,orcid:string>>"


def read_raw_responses(spark: SparkSession, path: str) -> DataFrame:
    """Stored JSON responses below a folder: ``path, payload, readable``."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))
    return rows.withColumn("readable", F.try_parse_json("payload").isNotNull())


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a gold file, a row each; all kinds of gold set share the schema, absent fields are null."""
    schema = "version string, questions array<struct<qid:string,kind:string,language:string,query:string,expected_modes:array<string>,note:string,match_all:array<string>,expected_paper_ids:array<string>,label_source:string,anchor_paper_id:string,anchor_title:string,topic_terms:array<string>>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("questions").alias("q")).select("q.*")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """``label, qid, rank`` of a frozen rank file."""
    rows = spark.read.schema("ranks map<string,map<string,int>>").json(path, multiLine=True)
    return rows.select(F.explode("ranks").alias("label", "by")).select("label", F.explode("by").alias("qid", "rank"))


def read_store(spark: SparkSession, path: str, version: str) -> DataFrame:
    """``paper_id, record`` of a versioned metadata store; another version is a constraint_violation."""
    schema = "schema_version string, papers map<string,array<struct<origin:string,confidence:string,title:string,authors:array<string>,year:int,venue:string,doi:string,arxiv_id:string,url:string,author_ids:array<string>,author_orcids:array<string>,cleared_fields:array<string>,evidence:string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    found = rows.select("schema_version").first()
    if found is None or found.schema_version != version:
        raise DomainError("constraint_violation", "the store has another version", expected=version)
    return rows.select(F.explode("papers").alias("paper_id", "records")).select("paper_id", F.explode("records").alias("r")).select("paper_id", "r.*")


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """``paper_id, status, reason`` of the reviews in a metadata store."""
    schema = "reviews map<string,struct<status:string,reason:string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("reviews").alias("paper_id", "r"))
    return rows.select("paper_id", F.coalesce("r.status", F.lit("")).alias("status"), F.coalesce("r.reason", F.lit("")).alias("reason"))


def parse_answers(answers: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and findings of untrusted answers (``seq, answer`` JSON): known keys only, one suggestion, one answer a paper."""
    allowed = ["paper_id", "doi", "arxiv_id", "title"]
    rows = answers.withColumn("m", F.from_json("answer", "map<string,string>"))
    rows = rows.withColumn("paper_id", F.col("m")["paper_id"]).join(known.select("paper_id", F.lit(True).alias("known")), "paper_id", "left")
    given = F.size(F.filter(F.array(*[F.col("m")[k] for k in allowed[1:]]), lambda x: x.isNotNull() & (F.trim(x) != "")))
    nth = F.row_number().over(_by_paper())
    problem = F.when(F.col("m").isNull(), "parse_error").when(F.size(F.array_except(F.map_keys("m"), F.array(*map(F.lit, allowed)))) > 0, "unknown_key").when(F.col("known").isNull(), "unknown_paper").when(given != 1, "not_one_suggestion")
    rows = rows.withColumn("problem", problem)
    rows = rows.withColumn("problem", F.when(F.col("problem").isNull() & (nth > 1), "second_answer").otherwise(F.col("problem")))
    return rows.filter("problem is null").select("seq", "paper_id", *[F.col("m")[k].alias(k) for k in allowed[1:]]), rows.filter("problem is not null").select("seq", "paper_id", "problem")


def _by_paper():
    from pyspark.sql import Window

    return Window.partitionBy("paper_id", F.col("problem").isNull()).orderBy("seq")
