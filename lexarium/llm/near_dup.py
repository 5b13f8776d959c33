"""MinHash near-duplicates: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

Texts with one set are one vertex. In each bucket (texts that share a band) candidates are compared with a centre, not
with each other; links make components; only buckets that still hold several components are looked at again, first
around other centres, at last by an exact prefix filter on their rare shingles (small buckets: pair by pair). So a group
of copies costs rows in proportion to its size, and no link between components is missed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, pick, spread_join
from .shingles import band_keys, shingle_sets, superminhash

#: Signature places, and places in a band: a pair at similarity 0.75 shares no band with probability 2e-6.
PLACES, ROWS = 72, 3
#: Buckets of more texts than this are first compared around further centres, this many times.
LARGE_BUCKET, CENTRES = 16, 1


def _fingerprints(rows: DataFrame) -> DataFrame:
    """``id, n, digest, bands`` of every row: set size, digest of the set and band keys (both null without words)."""
    kind = dict(rows.dtypes)["id"]

    def run(batches):
        for batch in batches:
            sets = shingle_sets([(t or "").encode() for t in batch.column("text").to_pylist()])
            some = [i for i, s in enumerate(sets) if len(s)]
            keys = np.empty((len(sets), PLACES // ROWS), np.int64)
            for at in range(0, len(some), 512):
                part = some[at : at + 512]
                keys[part] = band_keys(superminhash([sets[i] for i in part], PLACES), ROWS)
            empty = np.array([not len(s) for s in sets], bool)
            offsets = pa.array(np.arange(0, keys.size + 1, PLACES // ROWS), pa.int32(), mask=np.append(empty, False))
            digests = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), digests, pa.ListArray.from_arrays(offsets, pa.array(keys.ravel(), pa.int64()))], names=["id", "n", "digest", "bands"])

    return rows.mapInArrow(run, f"id {kind}, n long, digest binary, bands array<long>")


def _sets(rows: DataFrame) -> DataFrame:
    """``id, set``: the sorted shingle hashes of each row as bytes."""
    kind = dict(rows.dtypes)["id"]

    def run(batches):
        for batch in batches:
            sets = shingle_sets([(t or "").encode() for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "set"])

    return rows.mapInArrow(run, f"id {kind}, set binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar enough, by their whole sets."""
    kind = dict(pairs.dtypes)["a"]

    def run(batches):
        for batch in batches:
            left, right = batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()
            keep = []
            for x, y in zip(left, right):
                small, large = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
                if 100 * len(small) < percent * len(large):
                    keep.append(False)
                    continue
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                both = int((large[at] == small).sum())
                keep.append(100 * both >= percent * (len(small) + len(large) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, f"a {kind}, b {kind}")


def _by_prefix(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of other labels that may be similar, by rare shingles; exact. ``sets``: id, set, label.

    Shingles are put in one order, those of fewest texts first. Of two similar texts the first common shingle is so
    early in both that what follows can still make the overlap. Copies of one text have their common shingles last, so
    texts that are too far from it meet only where they share what is rare. A shingle's rows are joined as those outside
    its most frequent label with all of other labels.
    """
    kind = dict(sets.dtypes)["id"]

    def split(batches):
        for batch in batches:
            parts = [np.frombuffer(x, np.int64) for x in batch.column("set").to_pylist()]
            sizes = np.array([len(p) for p in parts], np.int64)
            row = np.repeat(np.arange(len(parts)), sizes)
            tokens = np.concatenate(parts) if parts else np.empty(0, np.int64)
            for at in range(0, len(row), 200_000):
                own = pa.array(row[at : at + 200_000])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(own), batch.column("label").take(own), pa.array(sizes[row[at : at + 200_000]]), pa.array(tokens[at : at + 200_000])], names=["id", "label", "n", "token"])

    tokens = sets.select("id", "label", "set").mapInArrow(split, f"id {kind}, label {kind}, n long, token long")
    counted = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("df")), "token")
    lists = counted.groupBy("id", "label", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    reach = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    rows = lists.select("id", "label", "n", F.posexplode(F.slice("t", F.lit(1), reach)).alias("at", "x")).filter("x.df > 1").select("id", "label", "n", "at", "x.token")
    rows = materialise(rows, "prefixes")
    shared = rows.groupBy("token", "label").agg(F.count("*").alias("k")).groupBy("token").agg(F.count("*").alias("labels"), F.max(F.struct("k", F.col("label").alias("main"))).alias("c")).filter("labels > 1").select("token", "c.main")
    rows = rows.join(shared, "token")
    left = rows.filter("label <> main").select("token", F.col("id").alias("a"), F.col("label").alias("label_a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    need = F.ceil(percent * (F.col("n_a") + F.col("n")) / (100 + percent))
    early = F.least(F.col("n_a") - F.col("at_a"), F.col("n") - F.col("at")) >= need
    sizes = 100 * F.least("n", "n_a") >= percent * F.greatest("n", "n_a")
    return left.join(rows, "token").filter((F.col("label_a") != F.col("label")) & sizes & early).select("a", F.col("id").alias("b"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``id, label`` of every vertex with a link (``a, b``): the smallest vertex that can be reached.

    Alternates large-star and small-star steps until no edge changes: each step links a vertex's neighbours to the
    smallest of them. Steps are aggregations and joins; edges are written between rounds.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    state = _state(edges)
    while state[0]:
        sym = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = sym.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        before, edges = edges, materialise(small, "links")
        discard(before)
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(roots)


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` of every row.

    Words are what is between ASCII white space, A-Z lower-cased; a text's set has its distinct 5-word shingles, or
    all its words as one if they are fewer. Texts are linked if 100 * intersection >= ``percent`` * union;
    ``component_id`` is the smallest id that can be reached by links, ``kept`` whether it is the row's own.

    Nulls: a null text, like one without words, has an empty set and is linked with nothing; a row without id is
    linked with nothing (component null, kept). Repeated rows are copies: all share the component, and rows with its
    id are kept. Rows that share an id but not a text are one vertex: linked by any of the texts, and in one component. An empty table gives no rows. Texts are read whole; further columns are ignored.
    """
    rows = pick(docs, id=id_col, text=text_col)
    prints = materialise(_fingerprints(rows).withColumn("digest", F.when(F.col("id").isNotNull(), F.col("digest"))), "fingerprints")
    # one vertex for each set: copies are gathered within the map tasks already
    vertices = prints.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    vertices = materialise(vertices, "vertices")
    keys = vertices.select(F.explode("bands").alias("key"), "id")
    shared = keys.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("last"), F.count("*").alias("size")).filter("centre <> last").drop("last")
    shared = materialise(shared, "shared")
    # a band of a large group of near copies is one key
    buckets = materialise(spread_join(keys, shared, ["key"], PLACES // ROWS * vertices.count()), "buckets")
    n_buckets = buckets.count()
    discard(shared)
    candidates = buckets.select("id").distinct()
    # of copies of a text, the vertex's own row alone goes on: (id, text) rows of other ids aren't candidates
    sets = materialise(_sets(rows.join(candidates, "id", "left_semi")), "sets")

    tested = materialise(buckets.filter("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = materialise(_verified(tested, sets, percent), "verified")
    labels = materialise(components(links), "labels")
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for turn in range(CENTRES + 1):
        placed = materialise(buckets.join(labels, "id", "left").select("key", "id", "size", F.coalesce("label", "id").alias("label")), "placed")
        several = placed.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.first("size").alias("rows"), F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), F.col("id").alias("centre"), F.col("label").alias("main"))).alias("c")).filter("x <> y").select("key", "rows", "c.centre", "c.main")
        open_ = spread_join(placed, materialise(several, "several"), ["key"], n_buckets, "rows").drop("rows")
        small, large = open_.filter(F.col("size") <= LARGE_BUCKET), open_.filter(F.col("size") > LARGE_BUCKET)
        if turn < CENTRES:
            found = large.filter("label <> main").select(F.col("centre").alias("a"), F.col("id").alias("b"))
        else:
            other = small.select("key", F.col("id").alias("b"), F.col("label").alias("label_b"))
            direct = small.join(other, "key").filter("label <> label_b and id < b").select(F.col("id").alias("a"), "b")
            found = direct.unionByName(_by_prefix(sets.join(large.select("id", "label").distinct(), "id"), percent))
        fresh = materialise(ordered(ordered(found).join(ordered(tested), ["a", "b"], "left_anti")), "pairs")
        if fresh.isEmpty():
            continue
        tested = tested.unionByName(fresh)
        more = materialise(_verified(fresh, sets, percent), "verified")
        if not more.isEmpty():
            known = labels.filter("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b"))
            labels = materialise(components(known.unionByName(more)), "labels")
    named = vertices.select("digest", "id").join(labels, "id", "left").select("digest", F.coalesce("label", "id").alias("component"))
    out = prints.select("id", "n", "digest").join(named, "digest", "left").withColumn("component", F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


#: The same result as SQL: all shingles joined to themselves, links followed to the end.
SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM t)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM t UNION SELECT links.x, reach.r FROM reach JOIN links ON links.y = reach.doc_id)
SELECT t.doc_id, coalesce(max(n.n), 0)::bigint AS n_shingles, min(r) AS component_id, t.doc_id = min(r) AS kept
FROM t JOIN reach ON reach.doc_id = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id GROUP BY t.doc_id
"""
