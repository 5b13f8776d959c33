import random

import pytest
from pyspark.sql import functions as F

from lexarium.llm import mixing
from lexarium.llm.mixing import budgets, epoch_rows, mix


def fill(amount, nodes):
    """Shares of one parent for nodes (weight, capacity), one node closed at a time."""
    out, open_ = [0.0] * len(nodes), [i for i, (w, c) in enumerate(nodes) if w > 0 and c > 0]
    while open_:
        level = amount / sum(nodes[i][0] for i in open_)
        tight = min(open_, key=lambda i: nodes[i][1] / nodes[i][0])
        if nodes[tight][1] > level * nodes[tight][0]:
            for i in open_:
                out[i] = level * nodes[i][0]
            break
        out[tight] = nodes[tight][1]
        amount -= nodes[tight][1]
        open_.remove(tight)
    return out


def brute_budgets(leaves, total, weights, max_epochs):
    """Shares as fractions, by recursion."""

    def room(prefix):
        if len(prefix) == 3:
            return float(max_epochs * leaves[prefix])
        names = {p[len(prefix)] for p in leaves if p[: len(prefix)] == prefix}
        return sum(room((*prefix, x)) for x in names if weights[len(prefix)].get(x, 1.0) > 0)

    def share(prefix, amount):
        if len(prefix) == 3:
            return {prefix: amount}
        names = sorted({p[len(prefix)] for p in leaves if p[: len(prefix)] == prefix})
        parts = fill(amount, [(weights[len(prefix)].get(x, 1.0), room((*prefix, x))) for x in names])
        out = {}
        for x, a in zip(names, parts):
            out |= share((*prefix, x), a)
        return out

    return share((), min(total, room(())))


def run(spark, leaves, total, weights, epochs=1):
    frame = spark.createDataFrame([(*p, n) for p, n in leaves.items()], "domain string, lang string, source string, n long")
    return {(r.domain, r.lang, r.source): r.budget for r in budgets(frame, total, weights, epochs).collect()}


def test_shortages_go_to_siblings_first(spark):
    leaves = {("d", "en", "a"): 5, ("d", "en", "b"): 1000, ("d", "de", "c"): 1000, ("e", "en", "f"): 1000}
    # the 45 that leaf a should have and hasn't go to its sibling b; the other language and domain keep their shares
    assert run(spark, leaves, 400, [{}, {}, {}]) == {("d", "en", "a"): 5, ("d", "en", "b"): 95, ("d", "de", "c"): 100, ("e", "en", "f"): 200}


def test_nodes_without_weight_have_no_room(spark):
    """A child of weight 0 takes nothing and holds nothing back from the others, at any level."""
    leaves = {("d0", "de", "a"): 1000, ("d1", "en", "b"): 1000}
    assert run(spark, leaves, 500, [{}, {"de": 0.0}, {}]) == {("d0", "de", "a"): 0, ("d1", "en", "b"): 500}
    leaves[("d0", "en", "c")] = 10
    assert run(spark, leaves, 500, [{}, {"de": 0.0}, {}]) == {("d0", "de", "a"): 0, ("d0", "en", "c"): 10, ("d1", "en", "b"): 490}
    assert sum(run(spark, leaves, 5000, [{}, {"de": 0.0}, {}]).values()) == 1010
    assert set(run(spark, leaves, 500, [{"d0": 0.0, "d1": 0.0}, {}, {}]).values()) == {0}


@pytest.mark.parametrize("seed", range(4))
def test_budgets_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    leaves = {(f"d{rng.randint(0, 2)}", f"l{rng.randint(0, 3)}", f"s{rng.randint(0, 9)}"): rng.choice([1, 3, 50, 1000, 40_000]) for _ in range(30)}
    weights = [{f"{c}{i}": rng.choice([0.0, 0.3, 1.0, 2.5]) for i in range(4)} for c in "dls"]
    total = rng.randint(1, 60_000)
    want = brute_budgets(leaves, total, weights, 2)
    got = run(spark, leaves, total, weights, 2)
    assert got.keys() == want.keys()
    assert all(abs(got[p] - want[p]) < 1 + 1e-6 and got[p] <= 2 * leaves[p] for p in want)
    assert sum(got.values()) == int(sum(want.values()) + 1e-6)
    # the fractions that are rounded up are the largest
    up = [want[p] % 1 for p in want if got[p] > want[p] + 1e-6]
    down = [want[p] % 1 for p in want if got[p] < want[p] - 1e-6]
    assert not up or not down or min(up) >= max(down) - 1e-6


def test_equal_fractions_are_told_apart(spark):
    got = run(spark, {("d", "l", f"s{i}"): 100 for i in range(7)}, 24, [{}, {}, {}])
    assert sorted(got.values()) == [3, 3, 3, 3, 4, 4, 4]


def test_a_large_tree_is_spread(spark, monkeypatch):
    from lexarium.llm import common

    leaves = {("d", f"l{i % 3}", f"s{i}"): 1 + i for i in range(60)}
    want = run(spark, leaves, 700, [{}, {"l0": 3.0}, {}])
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert run(spark, leaves, 700, [{}, {"l0": 3.0}, {}]) == want


def test_prefixes_equal_brute_force(spark, monkeypatch):
    """Whole epochs, and the longest prefix of one more in that epoch's own order."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 9)
    weights, share, epochs = [{}, {"en": 1.0, "de": 3.0}, {"s0": 2.0}], 0.9, 2
    docs = [(i, "w " * (1 + i % 7), "en" if i % 3 else "de", f"s{i % 4}") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    out = mix(df, None, weights, share, epochs).collect()
    row = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("doc_id", "text").alias("h")).collect()}
    places = {(r.row, r.epoch): r.k for r in spark.createDataFrame([(h, e) for h in row.values() for e in range(3)], "row long, epoch long").select("row", "epoch", mixing.epoch_key(17, F.col("epoch"), F.col("row")).alias("k")).collect()}
    have = {}
    for i, _, lang, s in docs:
        have[("all", lang, s)] = have.get(("all", lang, s), 0) + 1 + i % 7
    plan = run(spark, have, share * sum(have.values()), weights, epochs)
    want = {}
    for leaf, q in plan.items():
        full, rest = divmod(q, have[leaf])
        total = 0
        for place, n, i in sorted((places[row[i], full], 1 + i % 7, i) for i, _, lang, s in docs if ("all", lang, s) == leaf):
            total += n
            if full + (total <= rest):
                want[i] = (full + (total <= rest), full, place if total <= rest else None)
    assert {r.doc_id: (r.epochs, r.last_epoch, r.place) for r in out} == want
    each = epoch_rows(mix(df, None, weights, share, epochs)).collect()
    assert len(each) == sum(e for e, _, _ in want.values())
    assert all(r.place == places[row[r.doc_id], r.epoch] for r in each)
    orders = [[r.doc_id for r in sorted(each, key=lambda r: r.place) if r.epoch == e and r.last_epoch > 0 and r.epochs > 1] for e in (0, 1)]
    assert set(orders[0]) & set(orders[1]) and [x for x in orders[0] if x in set(orders[1])] != [x for x in orders[1] if x in set(orders[0])]


def test_odd_rows(spark, odd_documents):
    got = mix(odd_documents, total_share=1.0, max_epochs=1).collect()
    assert {r.doc_id for r in got} == {1, 5, 6, 7, None} and sum(r.doc_id == 1 for r in got) == 2
    assert mix(odd_documents.limit(0)).count() == 0
