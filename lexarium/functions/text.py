"""Text functions as Columns: normalisation, headings, identifiers, snippets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Typographic ligatures and their letters: fixed values.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
GLYPH = r"/?uni[0-9A-Fa-f]{8}"
#: Section names that are headings wherever they stand; all but three are body sections: fixed values.
ABSTRACT_NAMES = ["abstract"]
REFERENCE_NAMES = ["references", "bibliography"]
BODY_NAMES = [
    "introduction", "background", "related work", "related works", "motivation", "preliminaries", "problem formulation", "methodology", "methods", "method", "materials and methods", "approach", "proposed approach", "proposed method", "model", "models", "system model",
    "experiments", "experimental setup", "experimental results", "experiments and results", "evaluation", "results", "results and discussion", "discussion", "analysis", "ablation study", "limitations", "threats to validity", "conclusion", "conclusions",
    "conclusion and future work", "conclusions and future work", "future work", "acknowledgements", "acknowledgments", "acknowledgement", "acknowledgment", "appendix",
]
MAX_HEADING, MAX_DIGIT_SHARE, SNIPPET = 90, 0.3, 200
BIB_MARKERS = ["http://", "https://", "www.", "doi:", "doi.org/", "arxiv:"]


def normalize_text(text: Column) -> Column:
    """Ligatures as letters and undecoded glyph names gone; white space is narrowed only in lines that lost one."""
    plain = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), text)
    line = lambda x: F.when(x.rlike(GLYPH), F.trim(F.regexp_replace(F.regexp_replace(x, GLYPH, ""), "[ \t]{2,}", " "))).otherwise(x)
    return F.when(plain.rlike(GLYPH), F.array_join(F.transform(F.split(plain, "\n"), line), "\n")).otherwise(plain)


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def snippet(text: Column, limit: int = SNIPPET) -> Column:
    """The squeezed text, cut with an ellipsis so that it never exceeds the limit."""
    one = squeeze(text)
    return F.when(F.length(one) <= limit, one).otherwise(F.concat(F.rtrim(F.substring(one, 1, limit - 1)), F.lit("…")))


def looks_tabular(line: Column) -> Column:
    """Three or more fields by tabs or runs of spaces, or any tab."""
    return line.contains("\t") | (F.size(F.array_remove(F.split(F.trim(line), " {2,}"), "")) >= 3)


def heading(line: Column, in_references: Column | bool = False) -> Column:
    """Struct (title, kind, level) of a heading line, or null.

    Known names win; lower-case sentence rests, formulas, table rows, references and code aren't headings; then
    numbered lines of at most eight words (not inside references) and capital lines of at most six.
    """
    in_references = F.lit(in_references) if isinstance(in_references, bool) else in_references
    text = F.trim(line)
    number = F.regexp_extract(text, r"^(\d+(?:\.\d+)*)[.)]?\s+", 1)
    roman = F.regexp_extract(text, r"^([IVXLC]+)[.)]\s+", 1)
    numbered = (number != "") | (roman != "")
    core = F.when(number != "", F.trim(F.regexp_replace(text, r"^\d+(?:\.\d+)*[.)]?\s+", ""))).when(roman != "", F.trim(F.regexp_replace(text, r"^[IVXLC]+[.)]\s+", ""))).otherwise(text)
    level = F.when(number != "", F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1).otherwise(1)
    norm = F.lower(F.regexp_replace(F.regexp_replace(core, "[ .:—-]+$", ""), r"\s+", " "))
    tail = text.rlike(r"[.!?,;]$")
    rest = ~numbered & core.rlike(r"^\p{Ll}") & tail
    kind = F.when(norm.isin(ABSTRACT_NAMES), "abstract").when(norm.isin(REFERENCE_NAMES), "references").when(norm.isin(BODY_NAMES), "body")
    compact = F.regexp_replace(core, r"\s+", "")
    digits = F.length(F.regexp_replace(compact, r"[^\p{Nd}]+", ""))
    rejected = (
        text.rlike("[←-⇿∀-⋿\\x{1D400}-\\x{1D7FF}]") | looks_tabular(text) | text.rlike("[-;,.]$") | reduce(lambda a, b: a | b, [F.lower(text).contains(m) for m in BIB_MARKERS])
        | text.rlike(r"(?i)\bet\s+al\b") | text.rlike(r'["{}\[\]=<>|]') | (compact == "") | (digits > MAX_DIGIT_SHARE * F.length(compact))
    )
    n_words = F.size(F.array_remove(F.split(core, r"\s+"), ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    out = lambda title, kind, level: F.struct(title.alias("title"), kind.alias("kind"), level.cast("int").alias("level"))
    return (
        F.when((text == "") | (F.length(text) > MAX_HEADING) | rest, F.lit(None))
        .when(kind.isNotNull(), out(F.when(core == "", text).otherwise(core), kind, level))
        .when(norm.startswith("abstract") & (F.length(norm) <= 12), out(F.lit("Abstract"), F.lit("abstract"), level))
        .when(rejected, F.lit(None))
        .when(numbered & ~in_references & (core != "") & (n_words <= 8) & ~core.rlike(r"[.!?,;]$"), out(core, F.lit("body"), level))
        .when((letters >= 3) & (F.upper(text) == text) & (n_words <= 6), out(F.initcap(text), F.lit("body"), F.lit(1)))
    )


def is_reference_section(title: Column) -> Column:
    """Whether a section title names the references."""
    return F.coalesce(heading(title)["kind"] == "references", F.lit(False))


def extract_identifiers(text: Column) -> Column:
    """Map with the first ``doi`` and the first ``arxiv`` id (without version) of a text."""
    doi = F.regexp_replace(F.regexp_extract(text, r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+", 0), "[.,;)]+$", "")
    arxiv = F.regexp_extract(text, r"(?i)arxiv[:\s]\s*(\d{4}\.\d{4,5})(v\d+)?", 1)
    return F.map_filter(F.create_map(F.lit("doi"), doi, F.lit("arxiv"), arxiv), lambda k, v: v != "")


def printable(text: Column, limit: int) -> Column:
    """One line of printable characters, cut to a length."""
    return F.trim(F.substring(squeeze(F.regexp_replace(text, r"\p{C}", " ")), 1, limit))


def escape_markdown(text: Column, limit: int = 500) -> Column:
    """Printable text with the characters that markdown reads escaped."""
    return F.regexp_replace(printable(text, limit), r"([\\`*_\[\]<>|#])", r"\\$1")


def safe_url(url: Column, limit: int = 2000) -> Column:
    """An http(s) address without blanks and control characters, else ''."""
    clean = F.regexp_replace(url, r"[\p{C}\s]+", "")
    return F.when(clean.rlike("^https?://") & (F.length(clean) <= limit), clean).otherwise("")


def page_label(page: Column, page_end: Column) -> Column:
    """``no page``, ``p. 3`` or ``pp. 3-5``; the end is never before the start."""
    end = F.greatest(page, page_end)
    return F.when(page == 0, "no page").when(end == page, F.concat(F.lit("p. "), page.cast("string"))).otherwise(F.concat(F.lit("pp. "), page.cast("string"), F.lit("-"), end.cast("string")))


def ocr_noise(text: Column) -> Column:
    """Long text of few letters and digits, or mostly of single characters."""
    solid = F.regexp_replace(text, r"\s+", "")
    alnum = F.length(F.regexp_replace(solid, r"[^\p{L}\p{N}]+", ""))
    tokens = F.array_remove(F.split(F.trim(text), r"\s+"), "")
    single = F.size(F.filter(tokens, lambda t: F.length(t) == 1))
    return (F.length(F.trim(text)) >= 200) & ((alnum < 0.55 * F.length(solid)) | (single > 0.4 * F.size(tokens)))
