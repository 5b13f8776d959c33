"""Suffix-array deduplication: bytes in strings that start earlier too.

Equal strings share an anchor (see ``anchors``), so a text is cut into segments by anchor and only segments of one
anchor hash are compared. Segments with equal bytes (by two 64-bit hashes beside the anchor's) are one, with the first place
that they are found at. The different segments of a group, which is cut by the content around its anchor until it fits,
go through a suffix array: on its Burrows-Wheeler transform, intervals are extended backwards
breadth first, which gives common prefixes by increasing value; the search stops at the minimum length, and the borders
that no step has reached then hold longer common prefixes.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import K, segments
from .common import discard, materialise, pick, spread_join

#: Bytes that must repeat, symbols that one suffix array takes, and different segments above which a group is cut by content.
WIDTH, POOL, LARGE_GROUP = 100, 400_000, 4_000


def suffix_array(s: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first ``depth`` symbols at least (prefix doubling), and each one's place."""
    n = len(s)
    padded = np.concatenate([s.astype(np.int64), np.zeros(7, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(7):  # seven symbols of nine bits
        key = (key << 9) | padded[k : k + n]
    done = 7
    while True:
        order = np.argsort(key)
        step = np.ones(n, np.int64)
        ordered = key[order]
        step[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if done >= depth or rank[order[-1]] == n:
            break
        after = np.zeros(n, np.int64)
        after[: n - done] = rank[done:]
        key = rank * (n + 1) + after
        done *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def long_classes(s: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of ``s``, and for each of its entries a class: suffixes with ``width`` equal first symbols share it.

    The border between two neighbours gets its common prefix when an interval that ends there is first reached; each
    border is set once, so all levels together extend each suffix a few times. After level ``width - 1`` the search
    ends: what is unset has a common prefix of ``width`` or more.
    """
    n = len(s)
    order, place = suffix_array(s, width)
    before = order - 1  # the suffix that a backward step leads to; none from the first
    unset = np.ones(n + 1, bool)
    unset[0] = False
    low, high = np.array([0]), np.array([n])
    owner = np.empty(n, np.int64)
    for _ in range(width):
        sizes = high - low
        total = int(sizes.sum())
        which = np.repeat(np.arange(len(low)), sizes)
        index = np.arange(total) + np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        back = before[index]
        if (back < 0).any():
            which, back = which[back >= 0], back[back >= 0]
        if not len(back):
            break
        at = place[back]
        owner[at] = which
        at = np.sort(at)
        whose, symbol = owner[at], s[order[at]]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (whose[1:] != whose[:-1]) | (symbol[1:] != symbol[:-1])
        first = np.flatnonzero(new)
        lows, highs = at[first], at[np.append(first[1:], len(at)) - 1] + 1
        reached = unset[highs]
        if not reached.any():
            break
        low, high = lows[reached], highs[reached]
        unset[high] = False
    return order, np.cumsum(~unset[:n])


def repeats_in(pool: list[tuple], width: int = WIDTH) -> list[np.ndarray]:
    """For segments (key, start, bytes) of whole groups: which starts of each have a string that starts earlier in the pool."""
    if not pool:
        return []
    counts = np.array([len(b) - width + 1 for _, _, b in pool])
    data = np.frombuffer(b"".join(b for _, _, b in pool), np.uint8)
    sizes = counts + width  # with a separator
    ends = np.cumsum(sizes)
    s = np.zeros(int(ends[-1]), np.int16)
    inside = np.ones(len(s), bool)
    inside[ends - 1] = False
    s[inside] = data.astype(np.int16) + 1
    order, label = long_classes(s, width)
    segment = np.repeat(np.arange(len(pool)), sizes)
    offset = np.arange(len(s)) - np.repeat(ends - sizes, sizes)
    valid = offset[order] < counts[segment[order]]
    position, label = order[valid], label[valid]
    # the order of the segments' places, then of starts: the first of a class stays
    keys = {k: i for i, k in enumerate(sorted({k for k, _, _ in pool}))}
    rank = np.array([keys[k] for k, _, _ in pool])
    starts = np.array([a for _, a, _ in pool])
    own = segment[position]
    start = starts[own] + offset[position]
    by = np.lexsort((start, rank[own], label))
    later = np.zeros(len(by), bool)
    later[1:] = label[by][1:] == label[by][:-1]
    out = [np.zeros(c, bool) for c in counts]
    flat = np.zeros(len(s), bool)
    flat[position[by[later]]] = True
    for i, (e, z, c) in enumerate(zip(ends, sizes, counts)):
        out[i] = flat[e - z : e - z + c]
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, length) of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2])]


def _key(rows: DataFrame) -> DataFrame:
    """Rows with ``key``, by which documents are ordered: the id, or with the text's hash where ids repeat or are null (those come last)."""
    kind = dict(rows.dtypes)["id"]
    if rows.groupBy("id").agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col("id").isNull()).isEmpty():
        return rows.withColumn("key", F.col("id"))
    text_hash = F.lpad(F.hex(F.xxhash64("text")), 16, "0")
    number = F.lpad(F.hex(F.col("id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0") if kind in ("bigint", "int") else F.col("id").cast("string")
    return rows.withColumn("key", F.concat(F.when(F.col("id").isNull(), F.lit("z")).otherwise(F.concat(F.lit("a"), number)), F.lit(":"), text_hash))


def halves(data: bytes, at: int, known: int, width: int) -> list[tuple[bytes, int, int, bytes, int]]:
    """A piece cut in two by the content next to its anchor: (group, first start, number of starts, anchor, known bytes) of each part.

    All strings of a group's pieces hold its anchor: the ``known`` bytes from ``at`` on. Of the ``slack`` other bytes, a
    string has at least half before the anchor or more than the rest after it. So equal strings go to the same side,
    and there have those next bytes in common too, by which the group is cut; the anchor grows by them.
    """
    n, slack = len(data) - width + 1, width - known
    m = (slack + 1) // 2
    out = []
    for side, first, count, anchor, grown in ((b"<", 0, min(n, at - m + 1), at - m, known + m), (b">", max(0, at - m + 1), n - max(0, at - m + 1), at, known + slack - m + 1)):
        if count > 0:
            group = hashlib.blake2b(side + data[anchor : anchor + grown], digest_size=16).digest()
            out.append((group, first, count, anchor - first, grown))
    return out


def repeated_starts(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """``key, start, n``: runs of starts whose strings of ``width`` bytes also start earlier. ``rows``: key (unique with its text), text."""
    kind = dict(rows.dtypes)["key"]
    key_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def cut(batches):
        for batch in batches:
            parts = [segments(t.encode(), width) for t in batch.column("text").to_pylist()]
            row = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            h, c1, c2, start, n, anchor = (np.concatenate(x) for x in zip(*parts))
            for at in range(0, len(row), 100_000):
                to = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(x[to].view(np.int64)) for x in (h, c1, c2)], batch.column("key").take(pa.array(row[to])), pa.array(start[to].astype(np.int32)), *[pa.array(x[to].astype(np.int16)) for x in (n, anchor)]],
                    names=["h", "c1", "c2", "key", "start", "n", "anchor"],
                )

    places = materialise(rows.select("key", "text").mapInArrow(cut, f"h long, c1 long, c2 long, key {kind}, start int, n short, anchor short"), "places")
    twice = materialise(places.groupBy("h").agg(F.count("*").alias("size")).filter("size > 1"), "twice")
    shared = materialise(spread_join(places, twice, ["h"], places.count()).drop("size"), "shared")
    discard(places, twice)

    # equal segments are one, at their first place
    at, content = F.struct("key", "start"), ["h", "c1", "c2"]
    distinct = materialise(shared.groupBy(*content).agg(F.min(at).alias("first"), F.first("n").alias("n"), F.first("anchor").alias("anchor"), F.count("*").alias("size")), "segments")
    several = materialise(distinct.groupBy("h").agg(F.count("*").alias("members")).filter("members > 1"), "groups")
    copied = distinct.filter("size > 1").select(*content, "first", "size")
    copies = spread_join(shared, copied, content, shared.count()).filter(at != F.col("first")).select("key", "start", F.col("n").cast("int").alias("n"))
    marks = [materialise(copies, "marks")]
    discard(shared)

    # bytes of the segments that others of their group differ from
    asked = spread_join(distinct.drop("size"), several, ["h"], distinct.count(), "members")
    asked = asked.groupBy(F.col("first.key").alias("key")).agg(F.collect_list(F.struct("h", F.col("first.start").alias("start"), "n", "anchor", "members")).alias("asked"))
    schema = f"g binary, key {kind}, start int, anchor int, known int, bytes binary, members long"

    def fetch(batches):
        for batch in batches:
            out = []
            for key, text, asked in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "asked"))):
                data = text.encode()
                out += [(x["h"].to_bytes(8, "big", signed=True), key, x["start"], x["anchor"], K, data[x["start"] : x["start"] + x["n"] + width - 1], x["members"]) for x in asked]
            types = (pa.binary(), key_type, pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
            for first in range(0, len(out), 50_000):
                columns = zip(*out[first : first + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["g", "key", "start", "anchor", "known", "bytes", "members"])

    texts = rows.select("key", "text")
    texts = texts.dropDuplicates(["key"]) if kind == "string" else texts  # only such keys can repeat
    pieces = materialise(texts.join(asked, "key").mapInArrow(fetch, schema), "pieces")
    discard(distinct, several)

    def split(batches):
        """Pieces of groups that are too large, cut in two, with a digest of what must agree for two parts to be equal."""
        for batch in batches:
            out = []
            for key, start, anchor, known, data in zip(*(batch.column(c).to_pylist() for c in ("key", "start", "anchor", "known", "bytes"))):
                for group, first, count, place, grown in halves(data, anchor, known, width):
                    part = data[first : first + count + width - 1]
                    out.append((group, key, start + first, place, grown, part, hashlib.blake2b(group + place.to_bytes(2, "big") + part, digest_size=16).digest()))
            types = (pa.binary(), key_type, pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["g", "key", "start", "anchor", "known", "bytes", "d"])

    # groups that are too large are cut until they fit: after seven rounds at most all strings of a group are equal, and so one
    pools = [pieces.filter(F.col("members") <= LARGE_GROUP)]
    while not (large := pieces.filter(F.col("members") > LARGE_GROUP)).isEmpty():
        parts = materialise(large.mapInArrow(split, schema.replace("members long", "d binary")), "parts")
        firsts = materialise(parts.groupBy("d").agg(F.min(at).alias("first"), F.count("*").alias("size")), "firsts")
        named = materialise(spread_join(parts, firsts, ["d"], parts.count()).drop("size"), "named")
        marks.append(named.filter(at != F.col("first")).select("key", "start", (F.octet_length("bytes") - (width - 1)).cast("int").alias("n")))
        own = named.filter(at == F.col("first")).drop("first", "d")
        sizes = materialise(own.groupBy("g").agg(F.count("*").alias("members")).filter("members > 1"), "groups")
        pieces = materialise(spread_join(own, sizes, ["g"], named.count(), "members"), "pieces")
        discard(parts, firsts, sizes)
        pools.append(pieces.filter(F.col("members") <= LARGE_GROUP))

    def compare(batches):
        """Pools of whole groups; the rows come sorted by group."""
        pool: list[tuple] = []
        size, last = 0, None

        def flush():
            found = [(k, a + first, n) for (k, a, _), flags in zip(pool, repeats_in(pool, width)) for first, n in _runs(flags)]
            keys, starts, ns = zip(*found) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(starts, pa.int32()), pa.array(ns, pa.int32())], names=["key", "start", "n"])

        for batch in batches:
            for g, key, start, data in zip(*(batch.column(c).to_pylist() for c in ("g", "key", "start", "bytes"))):
                if size >= POOL and g != last:
                    yield flush()
                    pool, size = [], 0
                pool.append((key, start, data))
                size += len(data) + 1
                last = g
        yield flush()

    whole = reduce(DataFrame.unionByName, pools).select("g", "key", "start", "bytes")
    compared = whole.repartition("g").sortWithinPartitions("g").mapInArrow(compare, f"key {kind}, start int, n int")
    return reduce(DataFrame.unionByName, [*marks, compared])


def dedup_substrings(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept`` bytes on demand) of every row.

    A byte goes if a string of ``width`` bytes that covers it also starts earlier: in a document of a smaller id, or
    earlier in the same one. Strings are judged on the input; matches stay within documents.

    Nulls: a null text is empty; rows with a null id come after all others. Rows that repeat an id are documents in the
    order of their texts' hashes; rows equal in id and text are one document, each with its result. An empty table
    gives no rows. Texts are whole; further columns are ignored.
    """
    rows = _key(pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit(""))))
    kinds = dict(rows.dtypes)
    marks = repeated_starts(rows, width).groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("marks"))

    def cut(batches):
        for batch in batches:
            n_bytes, removed, spans, digests, texts = [], [], [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist()):
                data = text.encode()
                pieces, at, total, n = [], 0, 0, 0
                for x in sorted((m["start"], m["start"] + m["n"] + width - 1) for m in found or ()):
                    if x[0] > at or not n:  # a new span; one that begins where the last ended joins it
                        pieces.append(data[at : x[0]])
                        n += 1
                        total += x[1] - x[0]
                        at = x[1]
                    elif x[1] > at:
                        total += x[1] - at
                        at = x[1]
                kept = b"".join([*pieces, data[at:]])
                for column, value in zip((n_bytes, removed, spans, digests, texts), (len(data), total, n, hashlib.sha256(kept).hexdigest(), kept)):
                    column.append(value)
            ints = [pa.array(c, pa.int64()) for c in (n_bytes, removed, spans)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *ints, pa.array(digests, pa.string()), *([pa.array(texts, pa.binary())] if keep_text else [])], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])])

    both = rows.join(marks, "key", "left").select("id", "text", "marks")
    return both.mapInArrow(cut, f"{id_col} {kinds['id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)

