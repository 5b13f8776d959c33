import random
import zlib

import numpy as np

from lexarium.llm import language as L

SYLLABLES = {"aa": ["the", "tion", "er", "ing"], "bb": ["ción", "ñe", "dad", "que"], "cc": ["sch", "ung", "für", "keit"]}


def texts(n, seed=0):
    rng = random.Random(seed)
    return [(i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 90))), lang) for i in range(n) for lang in [rng.choice(sorted(SYLLABLES))]]


def test_held_out_accuracy(spark):
    rows = texts(400)
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    held = [(i, lang) for i, _, lang in rows if got[i].held_out]
    assert len(held) > 50 and np.mean([got[i].lang_pred == lang for i, lang in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = L.ByteCNN(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(1, 255, (4, L.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1])
    loss = lambda: -np.log(net.predict(x)[np.arange(4), y]).mean()
    g = net.gradients(x, y)
    for name in ("w", "b", "u", "c", "e"):
        for at in zip(*[rng.integers(0, s, 4) for s in net.p[name].shape]):
            if name == "w" and not net.mask[at]:
                continue
            old = net.p[name][at]
            net.p[name][at] = old + 1e-6
            up = loss()
            net.p[name][at] = old - 1e-6
            down = loss()
            net.p[name][at] = old
            assert abs((up - down) / 2e-6 - g[name][at]) < 1e-4


def test_odd_rows(spark, odd_documents):
    got = L.identify(odd_documents).collect()
    assert len(got) == odd_documents.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (2, 3, 4))
    assert all(r.lang_pred in ("en", "de", "zh") for r in got if r.doc_id in (1, 5, 6, 7))
    assert L.identify(odd_documents.limit(0)).count() == 0
    assert {r.lang_pred for r in L.identify(odd_documents.filter("doc_id = 2")).collect()} == {"und"}
