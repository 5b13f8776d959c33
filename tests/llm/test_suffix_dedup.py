import hashlib
import random

import numpy as np
import pytest

from lexarium.llm import suffix_dedup
from lexarium.llm.anchors import segments
from lexarium.llm.suffix_dedup import dedup_substrings, repeats_in


def brute(rows, width=100):
    """rows: (id, text) in order of ids."""
    seen, gone = set(), {}
    for i, text in rows:
        data = (text or "").encode()
        mark = np.zeros(len(data), bool)
        for k in range(len(data) - width + 1):
            s = data[k : k + width]
            if s in seen:
                mark[k : k + width] = True
            seen.add(s)
        gone[i] = (len(data), int(mark.sum()), int((np.diff(np.concatenate([[0], mark.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~mark])).hexdigest())
    return gone


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijé") for _ in range(rng.randint(2, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(14, 60))) for _ in range(8)]
    rows = []
    for i in range(90):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 5))]
        rows.append((i, " ".join(parts)))
    rows += [(200, "ab" * 150), (201, "x" * 400), (202, rows[5][1]), (203, rows[5][1] + "!"), (204, None)]
    return rows


@pytest.mark.parametrize("large", [4_000, 3, 1])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(suffix_dedup, "LARGE_GROUP", large)
    rows = corpus(large)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_equal_strings_share_an_anchor():
    rng = random.Random(5)
    common = "".join(rng.choice("abcdef ") for _ in range(130)).encode()
    a = bytes(rng.randrange(97, 123) for _ in range(777)) + common
    b = common + bytes(rng.randrange(97, 123) for _ in range(99))
    at = lambda text, start: next(int(h) for h, _, _, s, n, _ in zip(*segments(text, 100)) if s <= start < s + n)
    for k in range(31):
        assert at(a, 777 + k) == at(b, k)


def test_parts_keep_equal_strings_together():
    """Each start of a piece is in one part; equal strings are in parts of one group with the anchor at one distance."""
    rng = random.Random(7)
    for _ in range(50):
        anchor = bytes(rng.randrange(97, 99) for _ in range(32))
        around = bytes(rng.randrange(97, 99) for _ in range(68))
        pieces = [(around[-rng.randint(0, 68) :] + anchor + around, 0, 32) for _ in range(3)]
        pieces = [(d[: len(d) - rng.randint(0, 20)], d.index(anchor), 32) for d, _, _ in pieces]
        pieces = [(d, a, k) for d, a, k in pieces if len(d) >= 100 and a <= 68]
        for _ in range(8):
            seen, parts = {}, []
            for data, at, known in pieces:
                if known == 100:
                    continue
                cut = suffix_dedup.halves(data, at, known, 100)
                n = len(data) - 99
                assert sorted(s for _, first, count, _, _ in cut for s in range(first, first + count)) == list(range(max(0, at + known - 100), n))
                for group, first, count, place, grown in cut:
                    for s in range(first, first + count):
                        assert seen.setdefault(data[s : s + 100], group) == group
                    parts.append((data[first : first + count + 99], place, grown))
            pieces = parts
        assert all(len(d) == 100 for d, _, k in pieces if k == 100)


def test_kernel_equals_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        width = rng.choice([3, 8, 30])
        pool = [(rng.randint(0, 4), 1000 * k, "".join(rng.choice("ab") for _ in range(rng.randint(width, width + 60))).encode()) for k in range(rng.randint(1, 9))]
        seen = {}
        for i, (key, start, data) in enumerate(pool):
            for o in range(len(data) - width + 1):
                seen.setdefault(data[o : o + width], []).append((key, start + o, i, o))
        want = [np.zeros(len(d) - width + 1, bool) for _, _, d in pool]
        for places in seen.values():
            for _, _, i, o in sorted(places)[1:]:
                want[i][o] = True
        assert all((x == y).all() for x, y in zip(repeats_in(pool, width), want))


def test_odd_rows(spark, odd_documents):
    got = dedup_substrings(odd_documents).collect()
    assert len(got) == odd_documents.count()
    by = {r.doc_id: r for r in got}
    assert by[2].n_bytes == by[3].n_bytes == 0 and by[6].n_removed == by[6].n_bytes and by[1].n_removed == 0
    assert dedup_substrings(odd_documents.limit(0)).count() == 0
