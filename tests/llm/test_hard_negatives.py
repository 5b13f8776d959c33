import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexarium.llm import hard_negatives as module
from lexarium.llm.hard_negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=10):
    kept = {}
    for i, v, y in rows:
        if i is not None and v is not None and y is not None and None not in v and np.isfinite(np.array(v, float)).all():
            y = (y + 1) % 10 if i % 7 == 0 else y
            kept.setdefault(i, (y, [math.floor(256 * float(np.float32(c))) for c in v]))
    out = set()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905
    for i, (y, v) in kept.items():
        if i % every:
            continue
        scores = sorted((-dot(v, w), j) for j, (_, w) in kept.items() if j != i)
        for p, j in [x for x in scores if kept[x[1]][0] == y][:5]:
            band = [(s, m) for s, m in scores if kept[m][0] != y and 30 * -p <= 100 * -s <= 90 * -p][:10]
            out |= {(i, j, rank, m, -p, -s) for rank, (s, m) in enumerate(band, 1)}
    return out


def found(spark, rows, schema=SCHEMA):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = [tuple(r) for r in hard_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") % 10 == 0, label).collect()]
    assert len(got) == len(set(got))
    return set(got)


def sample(seed, n, dim, spread, labels=4):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, labels, n)
    centres = rng.normal(size=(labels, dim))
    x = centres[y] + spread * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, [float(c) for c in v], int(t)) for i, v, t in zip(range(n), x.astype(np.float32), y, strict=True)]


@pytest.mark.parametrize("spread", [0.2, 3.0])
def test_against_brute_force(spark, monkeypatch, spread):
    """Small leaves, so that both trees have several levels; tight labels are pruned, scattered ones aren't."""
    monkeypatch.setattr(module, "LEAF", 16)
    rows = sample(1, 1200, 12, spread)
    assert found(spark, rows) == brute(rows)


def test_groups_are_pruned(spark, monkeypatch):
    monkeypatch.setattr(module, "LEAF", 16)
    pairs = []
    real = module.opened
    monkeypatch.setattr(module, "opened", lambda *a: pairs.append((a[0][0].count() * a[1][0].count(), (p := real(*a)).count())) or p)
    rows = sample(2, 1200, 12, 0.05)
    assert found(spark, rows) == brute(rows)
    assert pairs[0][1] < 0.7 * pairs[0][0]


def test_ties_and_hot_rows(spark, monkeypatch):
    """A third of the rows one vector, coarse components: equal scores everywhere."""
    monkeypatch.setattr(module, "LEAF", 16)
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 0.5, 0.0], i % 3) if i % 3 == 0 else (i, [float(c) for c in rng.integers(-1, 2, 3)], int(rng.integers(0, 4))) for i in range(240)]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = sample(4, 60, 6, 1.0)
    rows += [(70, None, 1), (80, [None] * 6, 1), (90, [float("nan")] * 6, 1), (100, [0.1] * 6, None), (110, [], 2), (120, [0.5], 2), (None, [0.1] * 6, 1), (130, [0.0] * 6, 3), (140, [1e20] * 6, 1)]
    extra = [(*r, "x", 1) for r in rows + rows[:20]]
    wanted = brute([r for r in rows if r[0] != 140])
    assert found(spark, extra, SCHEMA + ", Label string, rank int") == wanted
    assert {a for a, *_ in wanted}


def test_large_components(spark):
    """Scores beyond what doubles hold exactly are still exact."""
    rows = [(i, [float(c) * 2**17 for c in v], y) for i, v, y in sample(5, 80, 4, 1.0)]
    assert found(spark, rows) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == set()
    assert found(spark, [(1, [0.5], 1)]) == set()
    assert found(spark, [(10, [0.5], 1)]) == set()
