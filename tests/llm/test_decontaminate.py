import random

import numpy as np

from lexarium.llm import decontaminate as D


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def brute(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row = new
        best = max(best, max(row))
    return best


def test_alignment_equals_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        a, b = [[rng.randint(0, 4) for _ in range(rng.randint(1, 12))] for _ in range(2)]
        assert D.align(np.array(a, np.uint64), np.array(b, np.uint64))[0] == brute(a, b)


def test_copies_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, 30))) for i in range(6)] + [(90, None), (91, ""), (92, "one two")]
    filler = lambda n: " ".join(words(rng, n))
    edited = items[1][1].split()
    edited[5], edited[20] = "changed", "too"
    del edited[12]
    docs = [
        (1, f"{filler(50)} {items[0][1]} {filler(50)}"), (2, f"{filler(20)} {' '.join(edited).upper()}! {filler(9)}"), (3, filler(300)), (4, None), (5, ""), (6, f"x one, two y"), (7, items[3][1].replace(" ", "\n")), (7, items[3][1]),
        (8, " ".join(items[2][1].split()[:8]) + " " + filler(60)),
    ]
    docs = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, TEXT string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.score >= 0.999) for r in D.contamination(docs, bench).collect())
    assert got == [(1, 0, True), (2, 1, False), (6, 92, True), (7, 3, True), (7, 3, True)]
    left = sorted(r[0] for r in D.drop_contaminated(docs.toDF("doc_id", "text", "other"), bench).collect())
    assert left == [3, 4, 5, 8]
    assert D.contamination(docs.limit(0), bench).count() == 0 and D.contamination(docs, bench.limit(0)).count() == 0


def test_an_item_in_most_documents_is_still_found(spark):
    rng = random.Random(3)
    item = " ".join(words(rng, 25))
    docs = spark.createDataFrame([(i, item if i % 3 else " ".join(words(rng, 40))) for i in range(300)], "doc_id long, text string")
    got = {r.doc_id for r in D.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {i for i in range(300) if i % 3}


def pairs_of(spark, docs, items):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    return {(r.doc_id, r.item_id): r.score for r in D.contamination(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_front_edited_copies_of_an_item_that_is_in_most_documents(spark):
    rng = random.Random(4)
    item = words(rng, 36)
    edited = [w if k >= 18 or k % 3 != 2 else "changed" for k, w in enumerate(item)]
    spaced = [x for w in item for x in (w, "between")]
    rows = [" ".join(edited if i % 4 == 0 else spaced if i % 4 == 1 else item) + " " + " ".join(words(rng, 20)) for i in range(240)]
    got = pairs_of(spark, list(enumerate(rows)), [(1, " ".join(item))])
    assert set(got) == {(i, 1) for i in range(240)}
    assert abs(got[0, 1] - 0.75) < 1e-9 and got[1, 1] >= 0.5


def test_all_pairs_equal_brute_force(spark):
    rng = random.Random(8)
    common = words(rng, 12)
    some = lambda n: [rng.choice(common) for _ in range(n)]
    items = [some(rng.randint(1, 14)) for _ in range(25)]
    docs = [[*some(rng.randint(0, 8)), *[w for w in rng.choice(items) if rng.random() < 0.7], *words(rng, rng.randint(0, 9))] for _ in range(80)]
    got = pairs_of(spark, [(i, " ".join(d)) for i, d in enumerate(docs)], [(i, " ".join(x)) for i, x in enumerate(items)])
    want = {(i, j): brute(x, d) / (2 * len(x)) for i, d in enumerate(docs) for j, x in enumerate(items)}
    assert got == {k: v for k, v in want.items() if v >= 0.5}


def test_odd_rows(spark, odd_documents):
    """Null ids, a very long text, ties of items with one text, ids of another type, and repeated benchmark rows."""
    plain = odd_documents.toDF("doc_id", "text", "lang", "source", "n_chars", "other").select("doc_id", "text")
    long = next(r.text for r in plain.collect() if r.doc_id == 5)
    item = " ".join(long.split()[15_000:15_030])
    bench = spark.createDataFrame([(2.5, item), (2.5, item), (1.5, item), (None, "a text without an id"), (9.0, None)], "item_id double, text string")
    got = sorted(((r.doc_id, r.item_id, r.score) for r in D.contamination(odd_documents, bench).collect()), key=str)
    assert got == sorted([(i, j, 1.0) for i in (5, 6) for j in (1.5, 2.5)] + [(None, None, 1.0)], key=str)
    left = D.drop_contaminated(plain, bench).collect()
    assert sorted(str(r.doc_id) for r in left) == sorted(map(str, [1, 1, 2, 3, 4, 7]))
    assert D.drop_contaminated(plain, bench.limit(0)).count() == plain.count() and D.drop_contaminated(plain.limit(0), bench).count() == 0
