"""Hard negatives by dual-tree search: for each anchor the nearest rows of its label, and for each of those the nearest rows of other labels within a band of its score.

Candidates are a packed tree: rows are routed through a tree of principal-axis cuts (fitted on a bounded sample), sorted in that
order and cut into leaves; eight neighbours make the node above. Anchors are a tree over the same order. A node has the box,
centre, radius, greatest length and label range of its rows, exact over all of them. Pairs of nodes are opened from the
roots on, a level a join on the parents; the interval that holds all inner products of a pair drops it, with all anchors
of its group, once no anchor can gain from it. Leaf pairs that stay are scored exactly, a candidate leaf in memory at a time.

Thresholds come from the leaf that an anchor lies in: its first matches there bound what other leaves must reach. Scores are
integers below 2^56, so that all comparisons are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .vectors import packed, single, squared_norm, unpacked, usable

#: Rows of a candidate leaf, and levels of the tree between candidate leaves and groups of anchors.
LEAF, GROUP = 4096, 1
#: Rows of the sample that the cuts are fitted on, levels of cuts, and rows below which a node isn't cut.
SAMPLE, CUTS, LEAST = 8192, 8, 32
#: Vectors of this length or more take no part.
LONGEST = 2.0**28
NEVER = -(2**62)


def fitted(sample: np.ndarray, levels: int = CUTS) -> tuple[np.ndarray, np.ndarray]:
    """Directions and cuts of a binary tree, node 1 the root, 2i and 2i+1 below i: the main axis of the node's rows, at their median."""
    axes, cuts = np.zeros((1 << levels, sample.shape[1])), np.zeros(1 << levels)
    node = np.ones(len(sample), np.int64)
    rng = np.random.default_rng(1)
    for i in range(1, 1 << levels):
        x = sample[node == i]
        if len(x) < LEAST:
            continue
        centred = x - x.mean(axis=0)
        v = rng.normal(size=x.shape[1])
        for _ in range(12):
            v = centred.T @ (centred @ v)
            v /= np.linalg.norm(v) or 1.0
        axes[i], cuts[i] = v, np.median(x @ v)
        node[node == i] = 2 * i + (x @ v > cuts[i])
    return axes, cuts


def routed(x: np.ndarray, axes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last node of each row, and its place along the axis of the node before."""
    node, along = np.ones(len(x), np.int64), np.zeros(len(x))
    while len(x) and node[0] < len(cuts):
        along = np.einsum("ij,ij->i", x, axes[node])
        node = 2 * node + (along > cuts[node])
    return node, along


def in_order(rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` (vec_id, label, vec) with ``leaf``: numbers of runs of LEAF rows in the order of the cuts, from 0 on."""
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").collect()
    axes, cuts = fitted(np.array([np.frombuffer(r.vec, kind) for r in drawn]).astype(np.float64))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                node, along = routed(unpacked(batch.column("vec"), kind).astype(np.float64), axes, cuts)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node), pa.array(along)], names=[*batch.schema.names, "node", "along"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            run = (seen + np.arange(len(batch))) // LEAF
            seen += len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(run)], names=[*batch.schema.names, "run"])

    way = rows.select("vec_id", "label", "vec").mapInArrow(route, "vec_id long, label long, vec binary, node long, along double")
    way = way.repartitionByRange("node", "along", "vec_id").sortWithinPartitions("node", "along", "vec_id")
    way = way.select("vec_id", "label", "vec", F.spark_partition_id().alias("part"))
    runs = materialise(way.mapInArrow(cut, "vec_id long, label long, vec binary, part int, run long"), "runs")
    sizes = sorted(runs.groupBy("part").agg(F.max("run") + 1).collect())  # one row for each partition
    starts = np.cumsum([0, *(n for _, n in sizes)])
    first = rows.sparkSession.createDataFrame([(p, int(s)) for (p, _), s in zip(sizes, starts, strict=False)], "part int, first long")
    return runs.join(F.broadcast(first), "part").select("vec_id", "label", "vec", (F.col("first") + F.col("run")).alias("leaf"))


NODE = "number long, n long, lo array<double>, hi array<double>, centre array<double>, radius double, length double, least long, most long"


def leaves(rows: DataFrame, number: Column, kind: str) -> DataFrame:
    """The nodes (see NODE) that ``number`` deals ``rows`` to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("number").to_numpy()
            out = []
            for i in np.unique(numbers):
                own = batch.filter(pa.array(numbers == i))
                x, label = unpacked(own.column("vec"), kind).astype(np.float64), own.column("label").to_numpy()
                centre = x.mean(axis=0)
                far = np.sqrt(((x - centre) ** 2).sum(axis=1).max())
                length = np.sqrt((x * x).sum(axis=1).max())
                out.append((int(i), len(x), x.min(axis=0).tolist(), x.max(axis=0).tolist(), centre.tolist(), float(far), float(length), int(label.min()), int(label.max())))
            names = [c.split()[0] for c in NODE.split(", ")]
            kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.float64())] * 3, pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=names)

    parts = rows.select(number.alias("number"), "label", "vec").mapInArrow(run, NODE)
    return merged(parts, F.col("number"))


def merged(nodes: DataFrame, number: Column) -> DataFrame:
    """The node of each ``number`` from its parts: a few batches of a leaf, or eight nodes below."""
    names = [c.split()[0] for c in NODE.split(", ")][1:]
    parts = nodes.groupBy(number.alias("number")).agg(F.collect_list(F.struct(*names)).alias("p"), F.sum("n").alias("n"), F.max("length").alias("length"), F.min("least").alias("least"), F.max("most").alias("most"))
    first = F.get("p", F.lit(0))
    fold = lambda field, f: F.aggregate("p", first[field], lambda a, p: F.zip_with(a, p[field], f))
    zero = F.transform(first["centre"], lambda x: F.lit(0.0))
    total = F.aggregate("p", zero, lambda a, p: F.zip_with(a, p["centre"], lambda x, y: x + y * p["n"]))
    parts = parts.withColumns({"lo": fold("lo", lambda x, y: F.least(x, y)), "hi": fold("hi", lambda x, y: F.greatest(x, y)), "total": total})
    parts = parts.withColumn("centre", F.transform("total", lambda x: x / F.col("n")))
    gap = lambda p: F.sqrt(F.aggregate(F.zip_with(p["centre"], F.col("centre"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    radius = F.array_max(F.transform("p", lambda p: gap(p) + p["radius"]))
    return parts.withColumn("radius", radius).select(*[c.split()[0] for c in NODE.split(", ")])


def levels(bottom: DataFrame) -> list[DataFrame]:
    """``bottom`` and the levels above it, each written, the last one node."""
    out = [materialise(bottom, "nodes")]
    while out[-1].agg(F.max("number")).first()[0]:
        out.append(materialise(merged(out[-1], F.shiftright("number", 3)), "nodes"))
    return out


def interval(a: str, b: str) -> tuple[Column, Column]:
    """Bounds of all inner products between a row of node ``a`` and one of node ``b`` (prefixes of columns): by boxes, by balls and by lengths, a little widened."""
    c = lambda side, name: F.col(f"{side}_{name}")
    corners = F.arrays_zip(c(a, "lo"), c(a, "hi"), c(b, "lo"), c(b, "hi"))
    products = lambda z: [z[f"{a}_{x}"] * z[f"{b}_{y}"] for x in ("lo", "hi") for y in ("lo", "hi")]
    box = F.aggregate(corners, F.lit(0.0), lambda s, z: s + F.least(*products(z))), F.aggregate(corners, F.lit(0.0), lambda s, z: s + F.greatest(*products(z)))
    middle = F.aggregate(F.zip_with(c(a, "centre"), c(b, "centre"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda side: F.sqrt(F.aggregate(c(side, "centre"), F.lit(0.0), lambda s, x: s + x * x))
    spread = norm(a) * c(b, "radius") + norm(b) * c(a, "radius") + c(a, "radius") * c(b, "radius")
    product = c(a, "length") * c(b, "length")
    slack = product * 1e-9 + 1e-3
    return F.greatest(box[0], middle - spread, -product) - slack, F.least(box[1], middle + spread, product) + slack


def opened(anchors: list[DataFrame], candidates: list[DataFrame], gain, wanted: DataFrame) -> DataFrame:
    """Leaf pairs (group, leaf) that ``gain`` keeps, opened from the pair of roots; ``wanted`` has each group's thresholds (number, low, high)."""
    low, high = F.min("low").alias("low"), F.max("high").alias("high")
    wants = [wanted.groupBy("number").agg(low, high)]
    for _ in anchors[1:]:
        wants.append(wants[-1].groupBy(F.shiftright("number", 3).alias("number")).agg(low, high))
    side = lambda nodes, s: nodes.toDF(*[f"{s}_{c}" for c in nodes.columns])
    pairs = wanted.sparkSession.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("c"))
    for step in range(max(len(anchors), len(candidates)) - 1, -1, -1):
        a, c = min(step, len(anchors) - 1), min(step, len(candidates) - 1)
        left = side(anchors[a].join(wants[a], "number"), "a")
        right = side(candidates[c], "c")
        up = lambda s, nodes: F.shiftright(f"{s}_number", 3 if step < len(nodes) - 1 else 0)
        pairs = pairs.join(left.withColumn("a", up("a", anchors)), "a").join(right.withColumn("c", up("c", candidates)), "c")
        pairs = pairs.filter(gain(*interval("a", "c"))).select(F.col("a_number").alias("a"), F.col("c_number").alias("c"))
    return pairs.select(F.col("a").alias("group"), F.col("c").alias("leaf"))


HITS = "anchor long, match long, match_score long, hit long, score long"


def scored(rows: DataFrame, probes: DataFrame, kind: str, exact: bool, most: int) -> DataFrame:
    """The first ``most`` matches within each leaf of every probe (leaf, vec_id, label, vec, wins): for each of its windows
    (id, score, lo, hi; ``same``: of equal labels) the rows of the leaf with lo <= score <= hi, best first, ties by id.

    ``exact``: whether doubles hold all scores. Rows of a leaf come first, then its probes, batch by batch.
    """
    names = ["leaf", "vec_id", "label", "vec", "wins"]
    window = "array<struct<id:long,score:long,lo:long,hi:long,same:boolean>>"
    both = rows.withColumn("wins", F.lit(None).cast(window)).select(*names).unionByName(probes.select(*names))
    both = both.repartition("leaf").sortWithinPartitions("leaf", F.col("wins").isNotNull())

    def out(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(5)], names=["anchor", "match", "match_score", "hit", "score"])

    def first(score: np.ndarray, ids: np.ndarray, near: np.ndarray) -> np.ndarray:
        if len(near) > most:
            least = -np.partition(-score[near], most - 1)[most - 1]
            near = near[score[near] >= least]
        return near[np.lexsort((ids[near], -score[near]))][:most]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.float64 if exact else np.int64
        at, parts, x = None, [], None
        for batch in batches:
            leaf, asks = batch.column("leaf").to_numpy(), batch.column("wins").is_valid().to_numpy(zero_copy_only=False)
            for piece in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(leaf) | np.diff(asks)) + 1):
                if not len(piece):
                    continue
                own = batch.slice(piece[0], len(piece))
                if leaf[piece[0]] != at:
                    at, parts, x = leaf[piece[0]], [], None
                if not asks[piece[0]]:
                    parts.append(own)
                    continue
                if x is None:
                    x = np.concatenate([unpacked(p.column("vec"), kind) for p in parts]).astype(number)
                    ids, labels = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("vec_id", "label"))
                anchors, theirs, wins = own.column("vec_id").to_pylist(), own.column("label").to_numpy(), own.column("wins").to_pylist()
                vectors = unpacked(own.column("vec"), kind).astype(number)
                for some in range(0, len(vectors), 64):
                    scores = (vectors[some : some + 64] @ x.T).astype(np.int64)
                    found = []
                    for i, score in enumerate(scores, some):
                        same = (labels == theirs[i]) & (ids != anchors[i])
                        for w in wins[i]:
                            allowed = same if w["same"] else labels != theirs[i]
                            near = np.flatnonzero(allowed & (score >= w["lo"]) & (score <= w["hi"]))
                            found += [(anchors[i], w["id"], w["score"], ids[j], score[j]) for j in first(score, ids, near)]
                    yield out(found)

    return both.mapInArrow(run, HITS)


def best(hits: DataFrame, most: int) -> DataFrame:
    """``hits`` with ``rank``, the first ``most`` of each (anchor, match)."""
    place = F.row_number().over(Window.partitionBy("anchor", "match").orderBy(F.desc("score"), "hit"))
    return hits.withColumn("rank", place).filter(F.col("rank") <= most)


def hard_negatives(embeddings: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, vector: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` is a condition on vec_id, ``label`` an expression of vec_id and label. Scores are inner products of the
    components floor(scale * x). Negatives have another label and low/100 to high/100 of the positive's score. Equal scores
    go by smaller vec_id. Rows without id, label or vector, or with a null, NaN or infinite component, take no part, nor do
    vectors whose integer length reaches 2^28. Missing components of shorter vectors are zero. A repeated row counts
    once; of different rows with one id the first by label and bytes counts. A positive whose band is empty (a negative
    score) or holds no row has no rows. Extra columns play no part.
    """
    spark = embeddings.sparkSession
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = usable(embeddings, vec_id="vec_id", label="label", vector=vector).filter("label is not null")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("vector"))
    rows = rows.withColumn("norm2", squared_norm(F.col("vector"))).filter(F.col("norm2") < LONGEST**2)
    dim, norm2, largest = rows.agg(F.max(F.size("vector")), F.max("norm2"), F.max(F.greatest(F.array_max("vector"), -F.array_min("vector")))).first()
    if dim is None:
        return empty
    kind, exact = "i2" if (largest or 0) < 2**15 else "i4", norm2 < 2.0**53
    rows = materialise(packed(rows.drop("norm2"), dim, kind), "vectors")
    rows = materialise(in_order(single(rows, "label", "digest"), kind), "ordered")
    group = F.shiftright("leaf", 3 * GROUP)
    asking = materialise(rows.filter(anchors).withColumn("group", group), "anchors")
    if asking.isEmpty():
        return empty
    above, below = levels(leaves(asking, F.col("group"), kind)), levels(leaves(rows, F.col("leaf"), kind))

    def window(lo, hi, same: bool, id_=F.lit(None).cast("long"), score=F.lit(None).cast("long")) -> Column:
        as_long = lambda x: x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long")
        return F.struct(id_.alias("id"), score.alias("score"), as_long(lo).alias("lo"), as_long(hi).alias("hi"), F.lit(same).alias("same"))

    def found(probes: DataFrame, most: int, label_: str) -> DataFrame:
        return materialise(scored(rows, probes, kind, exact, most), label_)

    # positives: the own leaf's matches, then all pairs of nodes that can hold better ones
    seeds = found(asking.withColumn("wins", F.array(window(NEVER, -NEVER, same=True))), positives, "first-positives")
    floors = seeds.groupBy("anchor").agg(F.count("*").alias("n"), F.min("score").alias("lo")).filter(F.col("n") == positives)
    known = asking.join(floors.select(F.col("anchor").alias("vec_id"), "lo"), "vec_id", "left").withColumn("lo", F.coalesce("lo", F.lit(NEVER)))
    wanted = known.groupBy(F.col("group").alias("number")).agg(F.min("lo").alias("low"), F.lit(0).cast("long").alias("high"))
    alike = (F.col("a_least") <= F.col("c_most")) & (F.col("c_least") <= F.col("a_most"))
    pairs = opened(above, below, lambda lo, hi: alike & (hi >= F.col("a_low")), wanted)
    probes = pairs.join(known.drop("leaf"), "group").withColumn("wins", F.array(window(F.col("lo"), -NEVER, same=True)))
    matches = best(found(probes, positives, "positives"), positives).select("anchor", F.col("hit").alias("id"), "score")
    matches = materialise(matches.filter("score >= 0"), "matches")

    # negatives: the same within the band of each positive
    bands = matches.selectExpr("anchor", "id", "score", f"(score * {low} + 99) div 100 AS lo", f"(score * {high}) div 100 AS hi")
    asked = lambda b: asking.join(b.groupBy(F.col("anchor").alias("vec_id")).agg(F.collect_list(window(F.col("lo"), F.col("hi"), False, F.col("id"), F.col("score"))).alias("wins")), "vec_id")
    seeds = found(asked(bands), negatives, "first-negatives")
    floors = seeds.groupBy("anchor", F.col("match").alias("id")).agg(F.count("*").alias("n"), F.min("score").alias("found")).filter(F.col("n") == negatives)
    bands = bands.join(floors, ["anchor", "id"], "left").withColumn("lo", F.coalesce("found", "lo")).drop("n", "found")
    known = materialise(asked(bands), "bands")
    wanted = known.select(F.col("group").alias("number"), F.array_min(F.col("wins.lo")).alias("low"), F.array_max(F.col("wins.hi")).alias("high"))
    unlike = (F.col("a_least") != F.col("a_most")) | (F.col("c_least") != F.col("c_most")) | (F.col("a_least") != F.col("c_least"))
    pairs = opened(above, below, lambda lo, hi: unlike & (hi >= F.col("a_low")) & (lo <= F.col("a_high")), wanted)
    out = best(found(pairs.join(known.drop("leaf"), "group"), negatives, "negatives"), negatives)
    return out.select(
        F.col("anchor").alias("anchor_id"), F.col("match").alias("positive_id"), "rank", F.col("hit").alias("negative_id"), F.col("match_score").alias("positive_score"), F.col("score").alias("negative_score")
    )


#: The rows of the query from all scores of the anchors.
SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS y, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.y = b.y AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT a, b AS positive, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
), n AS (
  SELECT p.a, positive, ps, b, score, row_number() OVER (PARTITION BY p.a, positive ORDER BY score DESC, b) AS k
  FROM p JOIN s ON s.a = p.a AND NOT same AND 30 * ps <= 100 * score AND 100 * score <= 90 * ps
)
SELECT a AS anchor_id, positive AS positive_id, k::int AS rank, b AS negative_id, ps AS positive_score, score AS negative_score FROM n WHERE k <= 10
"""
