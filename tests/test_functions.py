import pytest
from pyspark.sql import functions as F

from lexarium.errors import DomainError, check_count, guard
from lexarium.functions import names, text


def value(spark, make, *args):
    kinds = {str: "string", int: "int", list: "array<string>"}
    schema = ", ".join(f"c{i} {kinds[type(a)]}" for i, a in enumerate(args))
    df = spark.createDataFrame([tuple(args)], schema)
    return df.select(make(*[F.col(f"c{i}") for i in range(len(args))]).alias("v")).first().v


def test_normalize_text(spark):
    assert value(spark, text.normalize_text, "eﬃcient ﬁle  a") == "efficient file  a"
    assert value(spark, text.normalize_text, "a  b\nx /uni00000013  y  z\nc  d") == "a  b\nx y z\nc  d"


@pytest.mark.parametrize(
    "line, want",
    [
        ("3.1 Proposed approach", ("Proposed approach", "body", 2)), ("References", ("References", "references", 1)), ("Abstract—", ("Abstract—", "abstract", 1)), ("methods.", None), ("2 Smith et al. 2019", None),
        ("IV. SYSTEM DESIGN", ("SYSTEM DESIGN", "body", 1)), ("LARGE MODELS", ("Large Models", "body", 1)), ("a plain sentence of text", None), ("1 0.95 0.93 0.91", None), ("x" * 91, None), ("", None), ("5 a  b  c", None),
    ],
)
def test_heading(spark, line, want):
    got = value(spark, text.heading, line)
    assert (tuple(got) if got else None) == want


def test_numbered_lines_in_references_are_no_headings(spark):
    assert value(spark, lambda c: text.heading(c, True), "3 Some other thing") is None
    assert value(spark, lambda c: text.heading(c, True), "3 Conclusion").kind == "body"


def test_snippet_never_exceeds_the_limit(spark):
    assert value(spark, text.snippet, " a \n b ") == "a b"
    long = value(spark, text.snippet, "word " * 100)
    assert len(long) <= 200 and long.endswith("…")


def test_identifiers(spark):
    assert value(spark, text.extract_identifiers, "see 10.1145/12.34). and arXiv: 2404.16130v2") == {"doi": "10.1145/12.34", "arxiv": "2404.16130"}
    for given, want in [("doi:10.1145/1234.", ("doi", "10.1145/1234")), ("https://doi.org/10.48550/arXiv.2404.16130", ("arxiv", "2404.16130")), ("https://arxiv.org/abs/2404.16130v3", ("arxiv", "2404.16130")), ("CS/0501001", ("arxiv", "cs/0501001")), ("nothing", ("", ""))]:
        assert tuple(value(spark, names.normalize_identifier, given)) == want


def test_names(spark):
    assert value(spark, names.ascii_fold, "Müller Straße é ñ ł") == "Mueller Strasse e n ł"
    assert value(spark, names.ascii_fold, "Müller") == "Mueller"
    assert value(spark, names.person_name_key, "Asai, Akari") == value(spark, names.person_name_key, " Akari  Asai") == "akari asai"
    assert value(spark, names.orcid, "https://orcid.org/0000-0002-1825-0097") == "0000-0002-1825-0097"
    assert value(spark, names.orcid, "0000-0002-1825-0098") == ""
    assert value(spark, names.openalex_author_id, "https://openalex.org/a5023888391") == "A5023888391"
    assert value(spark, names.person_key, "中文", "", "") == ""
    assert value(spark, names.year_from_arxiv, "2404.16130") == 2024 and value(spark, names.year_from_arxiv, "2413.16130") == 0
    assert value(spark, names.title_from_uri, "file:///x/A%20title+more.PDF") == "A title+more"
    assert value(spark, names.title_slug, "GraphX: From Local to Global") == "graphx"
    assert value(spark, names.lowest_confidence, ["strong", "weak"]) == "weak"


def test_references(spark):
    ref = lambda style: lambda t, a, y, v, u: names.format_reference(t, a, y, v, u, style)
    args = ("A title", ["Lovelace, Ada M.", "Alan Turing"], 1950, "Mind", "https://doi.org/10.1/x")
    assert value(spark, ref("apa"), *args) == "Lovelace, A. M., & Turing, A. (1950). A title. Mind. https://doi.org/10.1/x"
    assert value(spark, ref("harvard"), *args) == "Lovelace, A.M. and Turing, A. (1950) 'A title', Mind. Available at: https://doi.org/10.1/x"
    assert value(spark, lambda t, a, y: names.format_in_text(t, a, y, "apa"), "T", ["A B", "C D", "E F"], 0) == "(B et al., n.d.)"
    assert value(spark, names.citation_key, "p1", "The title", [], 2020) == "title2020"
    many = [f"N{i} M. Last{i}" for i in range(1, 23)]
    assert value(spark, ref("harvard"), "T", many[:4], 1, "", "") == "Last1, N.M. et al. (1) 'T',"
    assert value(spark, ref("harvard"), "T", many[:3], 1, "V?", "") == "Last1, N.M., Last2, N.M. and Last3, N.M. (1) 'T', V?"
    assert value(spark, ref("apa"), "T!", many, 0, "", "u").endswith("Last19, N. M., ..., Last22, N. M. (n.d.). T! u")
    assert value(spark, ref("apa"), " ", ["Plato", " "], 0, "V", "") == "Plato. (n.d.). Untitled. V."
    assert value(spark, ref("apa"), "T", [], 0, "", "") == "T. (n.d.)." and value(spark, ref("harvard"), "", [], 0, "", "u") == "Untitled (no date) Available at: u"
    assert value(spark, lambda t, a, y: names.format_in_text(t, a, y, "harvard"), "", ["A B", "C, D"], 3) == "(B and C, 3)"
    with pytest.raises(DomainError):
        names.format_reference(F.lit(""), F.array(), F.lit(0), F.lit(""), F.lit(""), "other")


def test_errors():
    with pytest.raises(DomainError):
        check_count("k", 51)
    assert guard(lambda: 1 / 0)[1]["error"]["code"] == "internal_error"
    assert guard(lambda: {"a": 1}) == ({"a": 1}, None)
    assert guard(lambda: "x" * 900_001)[1]["error"]["code"] == "constraint_violation"
