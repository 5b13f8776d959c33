import random
import re

import numpy as np

from lexarium.llm import near_dup, shingles


def brute(rows):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, n_groups=30, copies=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    rows = []
    for _ in range(n_groups):
        base = [word() for _ in range(rng.choice([3, 8, 40, 150]))]
        for _ in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 22))):
                own[rng.randrange(len(own))] = word().upper()
            rows.append((" " if rng.random() < 0.5 else "\n").join(own))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_components_equal_brute_force(spark):
    rows = corpus(7)
    got = {r.doc_id: r for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    assert len({w[1] for w in want.values()}) > 30


def test_large_group_of_loose_copies(spark):
    """Copies far apart from the smallest id's text, so that centres alone don't find all links."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: w[1] for i, w in brute(rows).items()}


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.75, 0.95):
        a = rng.integers(0, 2**63, 300).astype(np.uint64)
        n = int(300 * 2 * share / (1 + share))
        b = np.concatenate([a[:n], rng.integers(0, 2**63, 300 - n).astype(np.uint64)])
        s = shingles.superminhash([a, b], 256)
        assert abs((s[0] == s[1]).mean() - share) < 0.12
    # alone or with others, a text's signature is the same
    alone = shingles.superminhash([a], 72)
    assert (shingles.superminhash([b, a, b[:5]], 72)[1] == alone[0]).all()


def test_odd_rows(spark, odd_documents):
    got = near_dup.near_duplicates(odd_documents).collect()
    assert len(got) == odd_documents.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.kept for r in by[1]] == [True, True]
    assert by[2][0].n_shingles == by[3][0].n_shingles == by[4][0].n_shingles == 0 and by[3][0].kept
    assert by[6][0].component_id == 5 and not by[6][0].kept
    assert by[None][0].component_id is None and by[None][0].kept
    assert near_dup.near_duplicates(odd_documents.limit(0)).count() == 0


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (103, 102), (102, 101)], "a long, b long")
    got = {r.id: r.label for r in near_dup.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 104)}}


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    """Texts of many pieces, a word longer than a piece, and white space between."""
    import random

    from lexarium.llm import shingles

    rng = random.Random(2)
    texts = ["".join(rng.choice("abC \n\té") for _ in range(rng.randint(0, 300))).encode() for _ in range(60)] + [b"x" * 500 + b" y", b"", b"   ", b"word" + b" " * 400 + b"word"]
    whole, bounds = shingles.word_hashes(texts)
    for piece in (1, 7, 64):
        monkeypatch.setattr(shingles, "PIECE", piece)
        got, same = shingles.word_hashes(texts)
        assert (got == whole).all() and (same == bounds).all()
