import numpy as np
import pytest
from pyspark.sql import functions as F

from lexarium.llm.hash_forest import BITS, ascended, met, nearest

SCHEMA = "vec_id long, embedding array<float>"


def rows_of(x, ids=None):
    return [(int(i), [float(c) for c in v]) for i, v in zip(range(len(x)) if ids is None else ids, x, strict=True)]


def brute(rows, k=20, every=20):
    rows = {(i, tuple(np.float32(c) for c in v)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))}
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = (x * x[q]).sum(axis=1)
        out[int(ids[q])] = [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
    return out


def found(frame, **more):
    out = {}
    for q, rank, v, s in sorted(nearest(frame, F.col("vec_id") % 20 == 0, **more).collect()):
        out.setdefault(q, []).append((v, s))
        assert rank == len(out[q])
    return out


def sphere(seed, n, dim):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clusters(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    return (sphere(seed, 40, dim)[rng.integers(0, 40, n)] + spread * rng.normal(size=(n, dim)) / np.sqrt(dim)).astype(np.float32) * rng.uniform(0.5, 2, (n, 1)).astype(np.float32)


def recall(got, wanted):
    assert set(got) == set(wanted)
    for q, rows in got.items():
        assert [s for _, s in rows] == sorted((s for _, s in rows), reverse=True)
        assert len(rows) == len(wanted[q])
    return np.mean([len({v for v, _ in got[q]} & {v for v, _ in rows}) / max(1, len(rows)) for q, rows in wanted.items()])


@pytest.mark.parametrize("x", [sphere(1, 3000, 24), clusters(2, 3000, 24, 0.5)], ids=["sphere", "clusters"])
def test_recall_with_many_bins(spark, x):
    rows = rows_of(x)
    got = found(spark.createDataFrame(rows, SCHEMA), bin_rows=300, descent=32)
    assert recall(got, brute(rows)) >= 0.9


def test_hot_vectors(spark):
    """A third equal, a third nearly equal: every block of a bin is visited, copies go by id."""
    x = sphere(3, 900, 16)
    x[::3] = x[0]
    x[1::3] = x[1] + 1e-4 * sphere(4, 300, 16)
    rows = rows_of(x)
    got, wanted = found(spark.createDataFrame(rows, SCHEMA), bin_rows=40, descent=16), brute(rows)
    assert recall(got, wanted) >= 0.9
    assert [v for v, _ in got[0]] == [v for v, _ in wanted[0]] == list(range(3, 63, 3))


def test_odd_rows(spark):
    x = sphere(5, 60, 8)
    rows = rows_of(x)
    rows += [(100, None), (120, [None] * 8), (140, [float("nan")] * 8), (160, [float("inf")] * 8), (180, [0.0] * 8), (200, []), (None, [1.0] * 8), *rows[:9], *rows[:9]]
    rows += [(220, [1.0, 2.0]), (221, [3.0])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", VEC_ID string, rank int")
    padded = [(i, v + [0.0] * (8 - len(v)) if v else v) for i, v in rows if i is not None]
    got, wanted = found(frame), brute(padded)
    assert recall(got, wanted) == 1.0
    assert all(v == w and s == pytest.approx(t, abs=1e-12) for q in wanted for (v, s), (w, t) in zip(got[q], wanted[q], strict=True))
    assert len(found(spark.createDataFrame(rows[:7], SCHEMA))[0]) == 6


def test_one_vector_for_an_id(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [-1.0, 1.0]), (2, [0.5, 0.0])]
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert sorted(v for v, _ in got[0]) == [1, 2]


def test_empty(spark):
    assert nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []
    assert nearest(spark.createDataFrame([(1, [1.0])], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []


def test_level_keeps_the_wanted_share():
    assert ascended([1.0] * 5, 1.0, 21, 12, 0.95) == 0
    for cosine in (0.99, 0.9, 0.7):
        level = ascended([cosine] * 21, 1.0, 21, 12, 0.95)
        assert 0 < level < BITS and met(np.array([cosine]), level, 12) >= 0.95 > met(np.array([cosine]), level + 1, 12)
    assert ascended([0.1] * 21, 1.0, 21, 12, 0.95) == 0
