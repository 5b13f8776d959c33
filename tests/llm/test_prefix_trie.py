import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest

from lexarium.llm import prefix_trie
from lexarium.llm.prefix_trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    whole = {c: own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[: h[c]] + own[c][h[c] :] for c in own}
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    children = defaultdict(list)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[x] for x in children[s]) or 1
        saved[s] = sum(saved[x] for x in children[s]) + (len(members[s]) - 1) * (s[-1][1] if s else 0)
    out = set()
    for s, m in members.items():
        end = ",".join(str(c) for c in m if len(whole[c]) == len(s))
        up = members[s[:-1]][0] if s else None
        out.add((m[0], len(s), up, len(m), len(children[s]), leaves[s], saved[s], hashlib.sha256(end.encode()).hexdigest()))
    return out


def found(spark, rows, schema=SCHEMA):
    got = [tuple(r) for r in conversation_trie(spark.createDataFrame(rows, schema)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def conversations(seed, n, depth, n_texts):
    rng = random.Random(seed)
    texts = [f"turn {i} " + "w " * rng.randint(0, 4) for i in range(n_texts)]
    return [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice(texts)) for c in rng.sample(range(-60, 4 * n), n) for t in range(rng.randint(1, depth))]


@pytest.mark.parametrize(("seed", "n", "depth", "n_texts"), [(1, 150, 5, 2), (2, 120, 9, 1)])
def test_against_brute_force(spark, seed, n, depth, n_texts):
    rows = conversations(seed, n, depth, n_texts)
    assert found(spark, rows) == brute(rows)


def test_sql(spark):
    rows = [(abs(c) + 1, *x) for c, *x in conversations(4, 80, 5, 2)]
    rows = [(c, None if t == 3 else t, r, x) for c, t, r, x in rows]
    con = duckdb.connect()
    con.register("conversations", pa.Table.from_pylist([dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in rows]))
    assert set(con.execute(prefix_trie.SQL).fetchall()) == found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = "word " * 200_000
    rows = [
        (0, None, None, None), (0, 1, "user", "a b"), (0, 1, "user", "a b"), (0, 1, "user", "c"), (20, 0, "", ""), (21, 5, "user", long),
        (22, 5, "user", long), (None, 0, "user", "nobody"), (41, 0, "user", "x"), (42, 0, "user", "x"), (7, None, "user", "n"), (7, None, "user", "m"),
    ]
    extra = [(*r, "z", 1) for r in rows]
    assert found(spark, extra, SCHEMA + ", TEXT string, Conv_ID int") == brute(rows)


def test_empty(spark):
    assert found(spark, []) == set()
    assert found(spark, [(None, 1, "user", "a")]) == set()


def test_long_chains_and_hot_groups(spark, monkeypatch):
    """Blocks of four depths and ids; a conversation of a third of all rows, a third of all conversations equal, chains that hang on chains."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    rows = [(0, t, "user", f"t{t} w") for t in range(40)]
    rows += [(c, t, "user", "same") for c in range(20, 41) for t in range(3)]
    rows += [(100 + 20 * k, t, "user", f"u{t}") for k in range(9) for t in range(2 * k + 1)]
    rows += [(300, 1, "user", "again")] * 30
    assert found(spark, rows) == brute(rows)


def test_chains_of_chains_double(spark):
    """Every conversation continues the one before: as many chains in a row as conversations."""
    rows = [(20 * k, t, "user", f"u{t} x y") for k in range(40) for t in range(k + 1)]
    assert found(spark, rows) == brute(rows)
