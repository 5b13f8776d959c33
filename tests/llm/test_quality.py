import random
import re
from collections import Counter

import numpy as np

from lexarium.llm import quality as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts_equal_brute_force(spark, odd_documents):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["a", "b", "cd", "#", "é", "|"]) + rng.choice([" ", "\n", "", "\t", "  "]) for _ in range(rng.randint(0, 120)))) for i in range(400)]
    got = {r.doc_id: r for r in Q.quality_rules(spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")).collect()}
    for i, text in rows:
        r = got[i]
        want = brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, text
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_outliers_go_and_others_stay(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(80, 400))), "en", "s") for i in range(400)]
    rows += [(1000 + i, " ".join(word() + "###" for _ in range(200)), "en", "s") for i in range(5)]
    got = {r.doc_id: r for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[1000 + i].kept for i in range(5))
    assert sum(got[i].kept for i in range(400)) >= 396


def test_mcd_resists_contamination(spark):
    rng = np.random.default_rng(1)
    good = rng.normal([1, 2], [1, 0.5], (800, 2))
    bad = rng.normal([30, 30], 0.1, (150, 2))
    frame = spark.createDataFrame([(0, float(a), float(b)) for a, b in np.vstack([good, bad])], "g long, log_words double, symbols double")
    r = Q.mcd(frame, ["log_words", "symbols"], "g").first()
    assert abs(r.m_0 - 1) < 0.2 and abs(r.m_1 - 2) < 0.2
    assert 0.7 < r.l_0_0 < 1.5


def test_odd_rows(spark, odd_documents):
    out = Q.quality_rules(odd_documents).collect()
    assert len(out) == odd_documents.count()
    assert all(r.base_failed for r in out if r.doc_id in (2, 3, 4))
    assert Q.quality_rules(odd_documents.limit(0)).count() == 0


def test_a_document_beyond_the_quantile_of_one_in_a_million_goes(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(80, 400))), "en", "s") for i in range(400)]
    rows += [(1000 + i, " ".join(word() + "#" * (k % 2) for k in range(200)), "en", "s") for i in range(5)]
    got = {r.doc_id: r for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(36 < got[1000 + i].distance2 < 50 and not got[1000 + i].kept for i in range(5))
    assert sum(got[i].kept for i in range(400)) == 400


def numpy_mcd(x, floors, share=Q.SHARE):
    """The estimate by sorting: start at medians and quartiles, then fit the nearest share until nothing changes."""
    q = Q.chi2_quantile(share, x.shape[1])
    factor = share / Q._gamma_p(x.shape[1] / 2 + 1, q / 2)
    rank = lambda p: np.sort(x, axis=0)[max(0, int(np.ceil(p * len(x))) - 1)]
    m, c = rank(0.5), np.diag(((rank(0.75) - rank(0.25)) / 1.349) ** 2 + floors**2)
    for _ in range(Q.STEPS):
        d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        near = x[d2 <= np.sort(d2)[max(0, int(np.ceil(share * len(x))) - 1)]]
        m, new = near.mean(0), np.cov(near.T, bias=True) * factor + np.diag(floors**2)
        change, c = abs(np.linalg.slogdet(new)[1] - np.linalg.slogdet(c)[1]) / 2, new
        if change < Q.SETTLED:
            break
    return m, c


def test_estimates_and_distances_equal_numpy(spark):
    """Three levels at once: groups of 12 to 90 rows in two languages, small ones with their parents' share."""
    rng = np.random.default_rng(3)
    rows, at = [], 0
    for g, n in enumerate([12, 20, 25, 60, 90, 17]):
        for _ in range(n):
            rows.append((at, g, g % 2, *map(float, rng.normal([5 + 0.2 * g, 1.6, 0.1, 0, 0.3], [0.4 + 0.1 * g, 0.1, 0.2, 0.1, 0.3]))))
            at += 1
    names = Q.FEATURES
    frame = spark.createDataFrame(rows, "id long, own long, of long, " + ", ".join(f"{f} double" for f in names))
    state = Q.estimates(frame, names)
    got = {r.id: r.d2 for r in frame.join(state, "own").select("id", Q._d2(names).alias("d2")).collect()}
    x, own, of = np.array([r[3:] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    floors = np.array([Q.FLOORS[f] for f in names])

    def mix(estimate, parent, n):
        w = min(1, n / 25)
        return tuple(w * a + (1 - w) * b for a, b in zip(estimate, parent))

    corpus = numpy_mcd(x, floors)
    for language in (0, 1):
        parent = mix(numpy_mcd(x[of == language], floors), corpus, (of == language).sum())
        for g in np.unique(own[of == language]):
            m, c = mix(numpy_mcd(x[own == g], floors), parent, (own == g).sum())
            want = np.einsum("ij,jk,ik->i", x[own == g] - m, np.linalg.inv(c), x[own == g] - m)
            assert np.allclose([got[i] for i in np.flatnonzero(own == g)], want, rtol=1e-6), g


def test_an_outlier_of_its_own_small_group_goes(spark):
    """80 groups of 12 to 38 documents; one's outlier is no outlier of its language or the corpus."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    rows = []
    for g in range(80):
        for _ in range(12 + g % 27):
            n = 100 if g == 25 else int(60 * 2 ** rng.uniform(0, 6))
            rows.append((len(rows), " ".join(word() for _ in range(n)), f"l{g % 4}", f"s{g}"))
    odd = len(rows)
    rows.append((odd, " ".join(word() for _ in range(2600)), "l1", "s25"))
    schema = "doc_id long, text string, lang string, source string"
    out = {r.doc_id: r for r in Q.quality_rules(spark.createDataFrame(rows, schema)).collect()}
    assert not out[odd].kept and sum(not r.kept for r in out.values()) <= 3
    merged = Q.quality_rules(spark.createDataFrame([(i, t, lang, None) for i, t, lang, _ in rows], schema))
    assert {r.doc_id: r.kept for r in merged.collect()}[odd]


def test_large_states_are_spread(spark, monkeypatch):
    """Beyond the broadcast bound the join is by key and salt, with the same rows."""
    from lexarium.llm import common

    rng = np.random.default_rng(4)
    rows = [(i, i % 9, i % 3, *map(float, rng.normal(0, 1, 5))) for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, own long, of long, " + ", ".join(f"{f} double" for f in Q.FEATURES))
    distances = lambda: {r.id: round(r.d2, 6) for r in frame.join(Q.estimates(frame, Q.FEATURES), "own").select("id", Q._d2(Q.FEATURES).alias("d2")).collect()}
    want = distances()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert distances() == want


def test_plan_has_no_python(spark, odd_documents):
    plan = Q.quality_rules(odd_documents)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_one_document_and_ties(spark):
    row = [(1, "word " * 30 + " ".join(f"w{i}" for i in range(60)), "en", "s")]
    schema = "doc_id long, text string, lang string, source string"
    assert [r.kept for r in Q.quality_rules(spark.createDataFrame(row, schema)).collect()] == [True]
    assert [r.kept for r in Q.quality_rules(spark.createDataFrame(row * 7, schema)).collect()] == [True] * 7
