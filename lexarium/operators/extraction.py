"""From pages to sections and chunks, in Columns.

Lines are classed by ``functions.text.heading``. What depends on lines before is read off the last line that decides it: only a
heading that counts inside references too can open or close them, so the last such heading says whether a line is inside;
a short body section joins the last that stays, and stays itself only right after the references. Paragraphs, sections and
pieces are rows in windows over one document; only the packing of pieces up to a length is a fold, over a section's pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import heading, looks_tabular, normalize_text, ocr_noise

MAX_CHARS, MIN_CHARS, MIN_SECTION = 1500, 200, 200
SENTENCE = r"(?<=[.!?])\s+"
CHUNK_SCHEMA = "paper_id string, chunk_id string, row_index int, section_id string, section_title string, section_kind string, page_number int, page_end int, text string, char_count int"


def lines_of(pages: DataFrame) -> DataFrame:
    """``paper_id, page_number, i, line, head, section, paragraph`` of all lines: the heading that a line is (or null), and the numbers of its section and paragraph.

    ``pages``: paper_id, page_number, text. A page's end closes a paragraph, so a blank line is added to it. Section 0 is what
    comes before the first heading.
    """
    rows = pages.select("paper_id", "page_number", F.posexplode(F.concat(F.split(normalize_text(F.coalesce("text", F.lit(""))), "\n"), F.array(F.lit("")))).alias("i", "line"))
    rows = rows.withColumns({"line": F.trim("line"), "outside": heading(F.col("line")), "inside": heading(F.col("line"), True)})
    order = Window.partitionBy("paper_id").orderBy("page_number", "i")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    listed = F.coalesce(F.last(F.col("inside")["kind"], ignorenulls=True).over(before) == "references", F.lit(False))
    rows = rows.withColumn("head", F.when(listed, F.col("inside")).otherwise(F.col("outside"))).drop("inside", "outside")
    opens = F.col("head").isNotNull()
    return rows.withColumns({"section": F.sum(opens.cast("int")).over(upto).cast("int"), "paragraph": F.sum((opens | (F.col("line") == "")).cast("int")).over(upto)})


def _paragraphs(lines: DataFrame) -> DataFrame:
    """``paper_id, section, paragraph, page, text``: lines joined; the page is that of the last."""
    held = lines.filter(F.col("head").isNull() & (F.col("line") != ""))
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "i", "line")))
    return held.groupBy("paper_id", "section", "paragraph").agg(F.max("page_number").alias("page"), F.array_join(F.transform(ordered, lambda x: x["line"]), " ").alias("text"))


def _sections(lines: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """``paper_id, section, title, kind, level, page_number, into``: all sections, and the one that each one's text belongs to.

    A body section of little text joins the last that stayed, unless that is the references.
    """
    front = F.struct(F.lit("").alias("title"), F.lit("front").alias("kind"), F.lit(1).alias("level"))
    named = lines.filter("head is not null").select("paper_id", "section", "head", "page_number")
    first = lines.select("paper_id").distinct().select("paper_id", F.lit(0).alias("section"), front.alias("head"), F.lit(1).alias("page_number"))
    size = paragraphs.groupBy("paper_id", "section").agg(F.sum(F.length("text")).alias("size"))
    rows = first.unionByName(named).join(size, ["paper_id", "section"], "left").select("paper_id", "section", "head.*", "page_number", F.coalesce("size", F.lit(0)).alias("size"))
    order = Window.partitionBy("paper_id").orderBy("section")
    after_references = F.coalesce(F.lag("kind").over(order) == "references", F.lit(False))
    stays = (F.col("section") == 0) | (F.col("kind") != "body") | (F.col("size") >= MIN_SECTION) | after_references
    into = F.last(F.when(stays, F.col("section")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("into", into).drop("size")


def split_long(paragraph: Column, limit: int = MAX_CHARS) -> Column:
    """A paragraph as pieces: sentences packed up to the limit; one that is longer stays whole."""
    sentences = F.array_remove(F.transform(F.split(paragraph, SENTENCE), lambda s: F.trim(s)), "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("last"))

    def grow(a: Column, s: Column) -> Column:
        fits = F.length(a["last"]) + 1 + F.length(s) <= limit
        done = F.when(fits | a["last"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["last"])))
        return F.struct(done.alias("done"), F.when(fits, F.concat_ws(" ", a["last"], s)).otherwise(s).alias("last"))

    packed = F.aggregate(sentences, start, grow, lambda a: F.concat(a["done"], F.array_compact(F.array(a["last"]))))
    return F.when(F.length(paragraph) <= limit, F.array(paragraph)).otherwise(packed)


def _packed(pieces: Column, limit: int) -> Column:
    """Pieces (page, text) in order as chunks (first, last, text): packed up to the limit, a blank line between."""
    pack = "struct<first:int,last:int,text:string>"
    start = F.struct(F.array().cast(f"array<{pack}>").alias("done"), F.lit(None).cast(pack).alias("open"))

    def grow(a: Column, p: Column) -> Column:
        one = a["open"]
        fits = F.length(one["text"]) + 2 + F.length(p["text"]) <= limit
        done = F.when(fits | one.isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(one)))
        larger = F.struct(one["first"].alias("first"), p["page"].alias("last"), F.concat(one["text"], F.lit("\n\n"), p["text"]).alias("text"))
        alone = F.struct(p["page"].alias("first"), p["page"].alias("last"), p["text"].alias("text"))
        return F.struct(done.alias("done"), F.when(fits, larger).otherwise(alone).cast(pack).alias("open"))

    return F.aggregate(pieces, start, grow, lambda a: F.concat(a["done"], F.array_compact(F.array(a["open"]))))


def chunks_of(pages: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """Chunks (CHUNK_SCHEMA) of documents given as pages: paragraphs of a section packed up to the limit, a blank line between."""
    lines = lines_of(pages)
    paragraphs = _paragraphs(lines)
    sections = _sections(lines, paragraphs)
    placed = paragraphs.join(sections.select("paper_id", "section", "into"), ["paper_id", "section"])
    pieces = placed.select("paper_id", "into", "paragraph", "page", F.posexplode(split_long(F.col("text"), limit)).alias("k", "text"))
    ordered = F.array_sort(F.collect_list(F.struct("paragraph", "k", F.col("page").cast("int").alias("page"), "text")))
    packs = pieces.groupBy("paper_id", F.col("into").alias("section")).agg(ordered.alias("pieces"))
    rows = packs.select("paper_id", "section", F.posexplode(_packed(F.col("pieces"), limit)).alias("k", "c"))
    number = (F.row_number().over(Window.partitionBy("paper_id").orderBy("section", "k")) - 1).cast("int")
    rows = rows.withColumn("row_index", number).join(sections.select("paper_id", "section", "title", "kind"), ["paper_id", "section"])
    return rows.select(
        "paper_id", F.format_string("%s-c%04d", "paper_id", "row_index").alias("chunk_id"), "row_index", F.format_string("%s-s%03d", "paper_id", "section").alias("section_id"), F.col("title").alias("section_title"), F.col("kind").alias("section_kind"),
        F.col("c.first").alias("page_number"), F.col("c.last").alias("page_end"), F.col("c.text").alias("text"), F.length("c.text").alias("char_count"),
    )


def sections_of(pages: DataFrame) -> DataFrame:
    """``paper_id, section_id, title, kind, level, page_number, ordinal`` of the sections that remain after short ones are merged."""
    lines = lines_of(pages)
    kept = _sections(lines, _paragraphs(lines)).filter("into = section")
    return kept.select("paper_id", F.format_string("%s-s%03d", "paper_id", "section").alias("section_id"), "title", "kind", "level", F.col("page_number").cast("int").alias("page_number"), F.col("section").alias("ordinal"))


def _headless_table(text: Column) -> Column:
    """A run of three tabular lines or more without a caption in the two lines with text above it."""
    lines = F.split(text, "\n")
    mark = F.array_join(F.transform(lines, lambda x: F.when(looks_tabular(x), "t").when(F.trim(x) == "", "b").when(F.lower(F.trim(x)).rlike("^(table|tabelle)"), "c").otherwise("x")), "")
    captioned = F.regexp_replace(mark, "cb*[x]?b*t+", "")
    return captioned.contains("ttt")


def quality_flags(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """``paper_id, flags``: sorted findings on pages, sections and chunks of each document."""
    number = F.col("page_number").cast("string")
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    by_page = pages.groupBy("paper_id").agg(
        F.min(blank.cast("int")).alias("empty"),
        F.collect_list(F.when(blank, F.concat(F.lit("empty_page:"), number))).alias("a"),
        F.collect_list(F.when(ocr_noise(F.col("text")), F.concat(F.lit("ocr_noise:"), number))).alias("b"),
        F.collect_list(F.when(_headless_table(F.col("text")), F.concat(F.lit("possible_headless_table:"), number))).alias("c"),
    )
    by_chunk = chunks.groupBy("paper_id").agg(
        F.count_if(F.col("section_kind") == "abstract").alias("n_abstract"), F.count_if(F.col("section_kind") == "references").alias("n_references"), F.count_if(F.col("section_kind") != "front").alias("n_sections"),
        F.count_if(F.col("char_count") < MIN_CHARS).alias("n_short"), F.collect_list(F.when(F.col("char_count") > MAX_CHARS, F.concat(F.lit("long_chunk:"), "chunk_id"))).alias("d"),
    )
    rows = by_page.join(by_chunk, "paper_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0)) == 0
    single = F.array_compact(F.array(
        F.when(none("n_abstract"), "missing_abstract"), F.when(none("n_references"), "missing_references"), F.when(none("n_sections"), "no_sections"),
        F.when(F.col("n_short") > 0, F.concat(F.lit("short_chunks:"), F.col("n_short").cast("string"))),
    ))
    empty = F.array().cast("array<string>")
    flags = F.array_sort(F.array_distinct(F.concat("a", "b", "c", F.coalesce("d", empty), single)))
    return rows.select("paper_id", F.when(F.col("empty") == 1, F.array(F.lit("empty_document"))).otherwise(flags).alias("flags"))


def reference_flags(stubs: DataFrame) -> DataFrame:
    """``paper_id, flags`` of reference entries (``paper_id, abstract``): the one finding that they can have, as they have no full text."""
    without = F.trim(F.coalesce("abstract", F.lit(""))) == ""
    return stubs.select("paper_id", F.when(without, F.array(F.lit("reference_without_abstract"))).otherwise(F.array().cast("array<string>")).alias("flags"))


def lead_texts(chunks: DataFrame, limit: int = 300) -> DataFrame:
    """``paper_id, summary``: the first abstract chunk, else the first with a section title, else the first."""
    from ..functions.text import snippet

    order = F.struct(F.when(F.col("section_kind") == "abstract", 0).when(F.col("section_title") != "", 1).otherwise(2), F.col("row_index"))
    return chunks.groupBy("paper_id").agg(snippet(F.min_by("text", order), limit).alias("summary"))
