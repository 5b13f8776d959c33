"""What a task holds doesn't grow with the table: numbers, pairs of persons, persons of a name."""

import collections
import difflib
import random
import re

from pyspark.sql import functions as F

from lexarium.operators import evaluation, graph, metadata, persons
from lexarium.shared import numbered


def test_numbers_are_given_by_ranges(spark):
    rows = spark.range(5000).select(F.format_string("k%05d", (F.col("id") * 7) % 5000).alias("k"))
    got = {r.k: r.number for r in numbered(rows, "k").collect()}
    assert got == {f"k{i:05d}": i + 1 for i in range(5000)}
    assert numbered(rows.limit(0), "k").collect() == []


def test_questions_are_numbered_without_a_list_of_all_in_one_task(spark):
    edges = spark.range(9000).select((F.col("id") % 3).cast("string").alias("source_paper_id"), F.format_string("t%04d", F.col("id") % 3000).alias("target_paper_id")).distinct()
    edges = edges.unionByName(edges.withColumn("source_paper_id", F.concat(F.lit("x"), "source_paper_id"))).unionByName(edges.withColumn("source_paper_id", F.concat(F.lit("y"), "source_paper_id")))
    out = evaluation.derive_questions(edges)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r.qid for r in out.orderBy("anchor_paper_id").collect()] == [f"C{i + 1:02d}" for i in range(3000)]


def test_titles_meet_without_a_row_for_each_common_gram(spark):
    rng = random.Random(3)
    hexa = ["".join(rng.choices("0123456789abcdef ", k=rng.randint(2, 44))).strip() or "a" for _ in range(80)]
    near = ["".join(c if rng.random() > 0.08 else rng.choice("abc") for c in t) for t in hexa[:60]]
    asked = [(i, t) for i, t in enumerate(near + hexa[:20] + ["", "!?"])]
    known = [(i, t) for i, t in enumerate(hexa + hexa[:10])]
    plain = lambda t: " ".join(re.findall("[a-z0-9]+", t.lower()))
    want = {}
    for i, t in asked:
        found = [(-r, j) for j, u in known if plain(t) and plain(u) and (r := difflib.SequenceMatcher(None, plain(t), plain(u)).ratio()) >= 0.85]
        if found:
            want[i] = (min(found)[1], -min(found)[0])
    out = metadata.title_matches(spark.createDataFrame(asked, "candidate_id long, title string"), spark.createDataFrame(known, "title_id long, title string"))
    assert {r.candidate_id: (r.title_id, r.ratio) for r in out.collect()} == want
    assert len(want) > 40
    assert "gram#" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_persons_are_made_once_where_their_papers_lie(spark):
    rng = random.Random(5)
    rows = [(f"p{i % 90}", f"name:{rng.randint(0, 20)}") for i in range(400)]
    papers = {}
    for p, k in rows:
        papers.setdefault(p, set()).add(k)
    want = collections.Counter((a, b) for own in papers.values() for a in own for b in own if a != b)
    out = persons.coauthors(spark.createDataFrame(rows, "paper_id string, person_key string"))
    assert {(r.person_key, r.coauthor): r.n_papers for r in out.collect()} == want
    assert "(paper_id#" not in "".join(x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)


def test_details_are_gathered_for_the_first_persons_alone(spark):
    rows = [(f"p{i}", "a smith", "a smith", f"name:{i % 3}", "A" if i % 2 else "", "") for i in range(30)] + [("x", "a smith", "a smith", "name:1", "B", "O")]
    authors = spark.createDataFrame(rows, "paper_id string, name string, name_key string, person_key string, openalex_id string, orcid string")
    meta = spark.createDataFrame([(f"p{i}", f"t{i}", 1990 + i) for i in range(30)], "paper_id string, title string, year int")
    out = persons.candidates(authors, meta, "Smith", 1)
    (got,) = out.collect()
    assert (got.person_key, got.n_papers, got.ambiguous, got.openalex_id, got.orcid, got.first_year, got.last_year, got["rank"]) == ("name:1", 11, True, "A", "O", 1991, 2018, 1)
    assert got.newest_titles == ["t28", "t25", "t22"] and got.names == ["a smith"]
    assert "count(distinct" not in out._jdf.queryExecution().analyzed().toString()


def test_few_patterns_are_compared_where_the_texts_lie(spark):
    rng = random.Random(6)
    texts = [(str(i), "".join(rng.choices("abé😀 ", k=rng.randint(0, 80)))) for i in range(300)]
    whole = [t for _, t in texts if len(t) > 45]
    patterns = {t[s : s + n] for t in whole[:60] for s, n in [(rng.randint(0, 8), rng.choice([1, 3, 4, 6, 8, 12, 14, 15, 16, 23, 30]))]} | {"zzzz", ""}
    out = graph.texts_with(spark.createDataFrame(texts, "id string, text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    assert {tuple(r) for r in out.collect()} == {(i, p) for i, t in texts for p in patterns if p and p in t}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
