"""Approximate nearest neighbours by largest inner product: a forest of sorted arrays of long hash strings.

A tree names every vector by the signs of BITS random projections, one bit each, and keeps them sorted, so the vectors that
share a prefix of the query's string are one run. A query descends to its longest prefixes with enough vectors in every
tree, and scores those; then it ascends in all trees at once, to the prefix length at which its neighbours were met with
the wanted probability. That length follows from the scores found: vectors at an angle a agree in a bit with probability
1 - a / pi, whatever the data are, and the scores found can only be too low, which only makes the run longer. Where runs of
all trees would hold more than the table, the query takes the root of one tree, which is exact.

Every run is searched whole; none is capped. Inner products become angles by one more component, which fills every vector
up to the longest one's length and is zero in queries. Arrays are cut at a fixed prefix into bins, bins of many rows into
blocks by digest (a query visits all of them), so a task holds one block. Equal vectors are one row with their smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, materialise, spread_join
from .vectors import packed, single, squared_norm, unpacked, usable

#: Trees, bits of a hash string, and the share of neighbours that a query expects to meet.
TREES, BITS, TARGET = 12, 60, 0.95
#: Vectors of a bin on average, and those that the longest prefix of a tree holds at least.
BIN, DESCENT = 32_768, 512

HITS = "key binary, score double, ids array<long>"


def planes(dim: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim + 1, trees * BITS))


def hashes(x: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """(rows, trees) hash strings as integers, first bit highest."""
    bits = (x @ normals > 0).reshape(len(x), -1, BITS)
    return bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def with_hashes(vectors: DataFrame, dim: int, kind: str, trees: int, longest: float, seed: int) -> DataFrame:
    """``digest, ids, vec, asked`` with the hash strings of the vector as a row (filled up to the longest) and as a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals = planes(dim, trees, seed)
        lists = lambda h: pa.ListArray.from_arrays(pa.array(np.arange(0, h.size + 1, trees), pa.int32()), pa.array(h.ravel()))
        for batch in batches:
            if not len(batch):
                continue
            x = unpacked(batch.column("vec"), kind).astype(np.float64)
            norm2 = (x * x).sum(axis=1)
            row = np.column_stack([x, np.sqrt(np.maximum(0, longest * longest - norm2))])
            query = np.column_stack([x, np.zeros(len(x))])
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(hashes(row, normals)), lists(hashes(query, normals))], names=[*batch.schema.names, "rows", "queries"])

    return vectors.mapInArrow(run, "digest binary, ids array<long>, vec binary, asked boolean, rows array<long>, queries array<long>")


class Block:
    """The vectors of one block, sorted by hash string."""

    def __init__(self, parts: list[pa.RecordBatch], kind: str, k: int):
        self.hash = np.concatenate([p.column("hash").to_numpy() for p in parts])
        self.ids = [x for p in parts for x in p.column("ids").to_pylist()]
        self.x = np.concatenate([unpacked(p.column("vec"), kind) for p in parts])
        self.k = k

    def descended(self, strings: np.ndarray, least: int) -> np.ndarray:
        """The longest prefix lengths whose runs have ``least`` vectors, 0 if the block has fewer."""
        level, open_ = np.zeros(len(strings), np.int64), np.ones(len(strings), bool)
        while open_.any():
            lo, hi = self.runs(strings, level + open_)
            open_ &= (hi - lo >= least) & (level < BITS)
            level += open_
        return level

    def runs(self, strings: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo = strings >> (BITS - level) << (BITS - level)
        return np.searchsorted(self.hash, lo), np.searchsorted(self.hash, lo + (np.int64(1) << (BITS - level)))

    def hits(self, keys: list[bytes], queries: np.ndarray, strings: np.ndarray, level: np.ndarray, floors: np.ndarray, slack: np.ndarray) -> Iterator[tuple]:
        """(key, score, ids) of the k best of each query's run that reach its floor, ties included."""
        lo, hi = self.runs(strings, level)
        order = np.lexsort((hi, lo))
        cuts = np.flatnonzero(np.diff(lo[order]) | np.diff(hi[order])) + 1
        for group in np.split(order, cuts):
            a, b = lo[group[0]], hi[group[0]]
            if a == b:
                continue
            rows = self.x[a:b].astype(np.float64)
            for at in range(0, len(group), 64):
                part = group[at : at + 64]
                scores = queries[part] @ rows.T
                for i, s in zip(part, scores, strict=True):
                    near = np.flatnonzero(s >= floors[i] - slack[i])
                    if len(near) > self.k:
                        least = -np.partition(-s[near], self.k - 1)[self.k - 1]
                        near = near[s[near] >= least - slack[i]]
                    exact = (rows[near] * queries[i]).sum(axis=1)
                    if len(near) > self.k:
                        keep = exact >= np.sort(exact)[-self.k]
                        near, exact = near[keep], exact[keep]
                    for j, e in zip(near, exact, strict=True):
                        yield keys[i], float(e), self.ids[a + j]


def searched(rows: DataFrame, probes: DataFrame, kind: str, k: int, descent: int, longest: float) -> DataFrame:
    """Hits of ``probes`` (place, block, hash, digest, vec, level, floor; level -1: descend) in ``rows`` (place, block, hash, ids, vec).

    A task takes its blocks one after the other: rows first, in the order of their strings, then probes, batch by batch.
    """
    columns = ["place", "block", "hash", "ids", "vec", "digest", "level", "floor"]
    left = rows.withColumns({"digest": F.lit(None).cast("binary"), "level": F.lit(None).cast("int"), "floor": F.lit(None).cast("double")})
    both = left.select(*columns).unionByName(probes.withColumn("ids", F.lit(None).cast("array<long>")).select(*columns))
    both = both.repartition("place", "block").sortWithinPartitions("place", "block", F.col("level").asc_nulls_first(), "hash")

    def out(found: list[tuple]) -> pa.RecordBatch:
        keys, scores, ids = ([f[i] for f in found] for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(scores, pa.float64()), pa.array(ids, pa.list_(pa.int64()))], names=["key", "score", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, block = None, [], None
        for batch in batches:
            places, blocks = batch.column("place").to_numpy(), batch.column("block").to_numpy()
            asks = batch.column("level").is_valid().to_numpy(zero_copy_only=False)
            for piece in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(places) | np.diff(blocks) | np.diff(asks)) + 1):
                if not len(piece):
                    continue
                rows, where = batch.slice(piece[0], len(piece)), (places[piece[0]], blocks[piece[0]])
                if where != at:
                    at, parts, block = where, [], None
                if not asks[piece[0]]:
                    parts.append(rows)
                    continue
                if block is None:
                    block, parts = Block(parts, kind, k) if parts else None, []
                if block is None:
                    continue
                queries = unpacked(rows.column("vec"), kind).astype(np.float64)
                strings, level = rows.column("hash").to_numpy(), rows.column("level").to_numpy().astype(np.int64)
                level = np.where(level < 0, block.descended(strings, descent), level)
                slack = 1e-12 * longest * np.sqrt((queries * queries).sum(axis=1))
                found = []
                for hit in block.hits(rows.column("digest").to_pylist(), queries, strings, level, rows.column("floor").to_numpy(), slack):
                    found.append(hit)
                    if len(found) == 10_000:
                        yield out(found)
                        found = []
                yield out(found)

    return both.mapInArrow(run, HITS)


def met(cosines: np.ndarray, level: int, trees: int) -> np.ndarray:
    """Probability that vectors at these cosines share ``level`` bits with the query in one of the trees."""
    return 1 - (1 - (1 - np.arccos(np.clip(cosines, -1, 1)) / np.pi) ** level) ** trees


def ascended(scores: list[float], reach: float, k: int, trees: int, target: float) -> int:
    """The longest prefix at which the neighbours at these scores, the query's own vector apart, are met with the wanted probability; 0 if runs of all trees would hold more than the table."""
    if len(scores) < k:
        return 0
    cosines = np.sort(np.array(scores))[::-1][1:k] / reach if reach else np.zeros(1)
    for level in range(BITS, 0, -1):
        if trees >= 2.0**level:
            return 0
        if met(cosines, level, trees).mean() >= target:
            return level
    return 0


def nearest(embeddings: DataFrame, asked, k: int = 20, trees: int = TREES, target: float = TARGET, bin_rows: int = BIN, descent: int = DESCENT, seed: int = 7, vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row with condition ``asked`` on vec_id the ``k`` best others by inner product.

    Scores are products of the original vectors in double precision; equal scores go by smaller vec_id. Rows whose id or
    vector is null, or whose vector is zero or has a null, NaN or infinite component, take no part. Missing components
    of shorter vectors are zero. A repeated row counts once; of different vectors with one id the first in byte order counts.
    With fewer than ``k`` others all are listed; an empty table has no rows. Extra columns play no part.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings, vec_id="vec_id", vector=vector)
    kind = "f4" if "float" in dict(rows.dtypes)["vector"] else "f8"
    rows = rows.withColumn("norm2", squared_norm(F.col("vector"))).filter("norm2 > 0")
    dim, norm2, n = rows.agg(F.max(F.size("vector")), F.max("norm2"), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest, wanted = float(np.sqrt(norm2)), k + 1
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "vector")
    rows = materialise(packed(rows, dim, kind), "vectors")
    rows = single(rows, "digest")
    asking = materialise(rows.filter(asked).select("vec_id", "digest"), "asking")
    sizes = materialise(asking.groupBy("digest").agg(F.count("*").alias("size")), "asking-sizes")

    smallest = F.dense_rank().over(Window.partitionBy("digest").orderBy("vec_id"))
    own = rows.withColumn("place", smallest).filter(F.col("place") <= wanted).groupBy("digest")
    own = own.agg(F.sort_array(F.collect_set("vec_id")).alias("ids"), F.first("vec").alias("vec"))
    own = own.join(sizes.select("digest", F.lit(True).alias("asked")), "digest", "left")
    own = own.select("digest", "ids", "vec", F.coalesce("asked", F.lit(False)).alias("asked"))
    own = materialise(with_hashes(own, dim, kind, trees, longest, seed), "hashed")

    prefix = max(0, int(np.ceil(np.log2(max(1, n / bin_rows)))))
    in_bin = F.shiftrightunsigned("hash", BITS - prefix)
    index = own.select("digest", "ids", "vec", F.posexplode("rows").alias("tree", "hash"))
    index = index.withColumn("place", F.shiftleft(F.col("tree").cast("long"), prefix) + in_bin)
    large = index.groupBy("place").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * bin_rows)
    large = materialise(large.select("place", F.ceil(F.col("n") / bin_rows).cast("int").alias("blocks")), "large-bins")
    n_large = large.count()
    blocks = F.coalesce("blocks", F.lit(1))
    index = lookup(index, large, "place", F.xxhash64("digest"), "left", n_large)
    index = index.withColumn("block", F.pmod(F.xxhash64("digest"), blocks).cast("int"))

    def probing(queries: DataFrame) -> DataFrame:
        """Probes of ``queries`` (digest, vec, tree, hash, level, floor): every block of every bin that shares the prefix."""
        bits = F.when(F.col("level") < 0, prefix).otherwise(F.least("level", F.lit(prefix)))
        first = F.expr("shiftleft(shiftright(bin, wide), wide)")
        q = queries.withColumns({"bin": in_bin, "wide": F.lit(prefix) - bits}).withColumn("bin", F.explode(F.sequence(first, first + F.expr("shiftleft(1L, wide)") - 1)))
        q = q.withColumn("place", F.shiftleft(F.col("tree").cast("long"), prefix) + F.col("bin"))
        q = lookup(q, large, "place", F.xxhash64("digest"), "left", n_large)
        return q.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).select("place", "block", "hash", "digest", "vec", "level", "floor")

    queries = own.filter("asked").select("digest", "vec", "queries")
    each = queries.select("digest", "vec", F.posexplode("queries").alias("tree", "hash"))
    first = each.withColumns({"level": F.lit(-1), "floor": F.lit(float("-inf"))})
    found = materialise(searched(index, probing(first), kind, wanted, descent, longest), "descended")

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = unpacked(batch.column("vec"), kind).astype(np.float64)
            best = [[f["score"] for f in b or ()] for b in batch.column("best").to_pylist()]
            level = [ascended(b, longest * float(np.sqrt(v @ v)), wanted, trees, target) for b, v in zip(best, x, strict=True)]
            floor = [min(b) if len(b) >= wanted else float("-inf") for b in best]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(level, pa.int32()), pa.array(floor, pa.float64())], names=["digest", "vec", "queries", "level", "floor"])

    climbing = queries.join(best_of(found, wanted).withColumnRenamed("key", "digest"), "digest", "left")
    climbing = climbing.mapInArrow(levels, "digest binary, vec binary, queries array<long>, level int, floor double")
    climbing = materialise(climbing, "climbing").select("digest", "vec", "level", "floor", F.posexplode("queries").alias("tree", "hash"))
    climbing = climbing.filter("level > 0 or tree = 0")
    more = materialise(searched(index, probing(climbing), kind, wanted, descent, longest), "ascended")

    lists = best_of(found.unionByName(more), wanted).withColumnRenamed("key", "digest")
    lists = materialise(lists.join(sizes, "digest"), "lists")
    pairs = spread_join(asking, lists, ["digest"], asking.count()).withColumn("best", F.filter("best", lambda b: b["vec_id"] != F.col("vec_id")))
    pairs = pairs.select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice("best", 1, k)).alias("rank", "hit"))
    return pairs.select("query_id", (F.col("rank") + 1).alias("rank"), "hit.vec_id", "hit.score")


def best_of(hits: DataFrame, k: int) -> DataFrame:
    """``key, best``: the k best (score, vec_id) of each key, best first; a hit of several trees counts once."""
    each = hits.select("key", "score", F.explode("ids").alias("vec_id"))
    place = F.dense_rank().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    best = each.withColumn("place", place).filter(F.col("place") <= k).groupBy("key", "place")
    best = best.agg(F.first("score").alias("score"), F.first("vec_id").alias("vec_id")).groupBy("key")
    best = best.agg(F.array_sort(F.collect_list(F.struct("place", "score", "vec_id"))).alias("best"))
    return best.withColumn("best", F.transform("best", lambda b: F.struct(b["score"].alias("score"), b["vec_id"].alias("vec_id"))))
