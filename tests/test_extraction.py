import random
import re

import pytest
from pyspark.sql import functions as F

from lexarium.functions.text import heading
from lexarium.operators import extraction


def split_long(paragraph, limit):
    if len(paragraph) <= limit:
        return [paragraph]
    out = []
    for sentence in filter(None, (s.strip(" ") for s in re.split(r"(?<=[.!?])\s+", paragraph))):
        if out and len(out[-1]) + 1 + len(sentence) <= limit:
            out[-1] += f" {sentence}"
        else:
            out.append(sentence)
    return out


def one_after_another(lines, limit):
    """A document's lines (page, text, heading outside and inside references) in one pass: chunks (section, title, kind, first page, last page, text) and the sections that stay."""
    sections, paragraphs, held, page = [("", "front")], [], [], 1

    def close():
        if held:
            paragraphs.append((len(sections) - 1, page, " ".join(held)))
            held.clear()

    for number, line, outside, inside in lines:
        head = inside if sections[-1][1] == "references" else outside
        if head is not None:
            close()
            sections.append((head.title, head.kind))
        elif not line:
            close()
        else:
            page = number
            held.append(line)
    close()
    size = [sum(len(t) for s, _, t in paragraphs if s == i) for i in range(len(sections))]
    into, last = {}, 0
    for i, (_, kind) in enumerate(sections):
        if i and kind == "body" and size[i] < 200 and sections[last][1] != "references":
            into[i] = last
        else:
            into[i] = last = i
    packs = []
    for s, number, text in paragraphs:
        for piece in split_long(text, limit):
            if packs and packs[-1][0] == into[s] and len(packs[-1][3]) + 2 + len(piece) <= limit:
                packs[-1][3] += f"\n\n{piece}"
                packs[-1][2] = number
            else:
                packs.append([into[s], number, number, piece])
    return [(s, *sections[s], a, b, t) for s, a, b, t in packs], [i for i in into if into[i] == i]


def document(rng):
    line = lambda: rng.choice(["A plain line of words here.", "short", "1. Author, A title. 2020.", "See [1]; and more text follows in this line of the page", "Longer sentence, with many words! And another? Yes. " * rng.randint(1, 6)])
    head = lambda: rng.choice(["Abstract", "1 Introduction", "2.1 Small Part", "References", "BIBLIOGRAPHY", "RESULTS OF TESTS", "III. Methods", "Appendix", "4 Conclusion", "7. Numbered entry of a list", "A OF B"])
    return ["\n".join(rng.choice([line, line, line, head, str])() for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 4))]


@pytest.mark.parametrize("limit", [1500, 120])
def test_columns_are_the_pass_over_lines(spark, limit):
    rng = random.Random(limit)
    rows = [(f"p{i:02d}", n, text) for i in range(60) for n, text in enumerate(document(rng), 1)] + [("e", 1, ""), ("n", 1, None), ("r", 1, "References\nIntroduction\nx\nMethods\ny")]
    pages = spark.createDataFrame(rows, "paper_id string, page_number int, text string")
    lines = pages.select("paper_id", "page_number", F.posexplode(F.concat(F.split(F.coalesce("text", F.lit("")), "\n"), F.array(F.lit("")))).alias("i", "line"))
    lines = lines.select("paper_id", "page_number", "i", F.trim("line").alias("line"), heading(F.col("line")).alias("outside"), heading(F.col("line"), True).alias("inside")).orderBy("paper_id", "page_number", "i").collect()
    want, stay, kinds = [], set(), set()
    for paper in dict.fromkeys(r.paper_id for r in lines):
        packs, kept = one_after_another([(r.page_number, r.line, r.outside, r.inside) for r in lines if r.paper_id == paper], limit)
        want += [(f"{paper}-c{n:04d}", f"{paper}-s{s:03d}", title, kind, a, b, t) for n, (s, title, kind, a, b, t) in enumerate(packs)]
        stay |= {f"{paper}-s{i:03d}" for i in kept}
        kinds |= {kind for _, _, kind, *_ in packs}
    got = extraction.chunks_of(pages, limit).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.section_id, r.section_title, r.section_kind, r.page_number, r.page_end, r.text) for r in got] == want
    assert all(r.char_count == len(r.text) for r in got) and kinds == {"front", "abstract", "body", "references"}
    assert {r.section_id for r in extraction.sections_of(pages).collect()} == stay


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([("p", 1, "x")], "paper_id string, page_number int, text string")
    plan = extraction.quality_flags(pages, extraction.chunks_of(pages))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_flags_of_reference_entries(spark):
    stubs = spark.createDataFrame([("a", "Of it."), ("b", " "), ("c", None)], "paper_id string, abstract string")
    assert {r.paper_id: r.flags for r in extraction.reference_flags(stubs).collect()} == {"a": [], "b": ["reference_without_abstract"], "c": ["reference_without_abstract"]}
