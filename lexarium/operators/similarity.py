"""Threshold-bounded similarity join of sparse vectors: all pairs above a cosine, or each paper's nearest, both exact.

Papers that share their heaviest term are neighbours in sort order and are cut into panels. A panel is an inverted index of
its papers in one task's memory; papers visit panels, some at a time, and a visit adds up exact products: frequent terms of the
panel as a dense product, the others along their lists. The sum over a paper's terms of its weight times the panel's
largest weight of the term bounds its similarity to every paper there, so a panel that can't hold a match is not visited.
For nearest neighbours (``nearest_of``) a task holds many panels, and the bound to reach rises from the threshold to the k-th best match
so far; papers move once for each row or column of a grid of tasks. Products are made in single precision first; only pairs that can
be among the first are added up in double precision.

Terms are compared by 64-bit hashes, or by exact numbers in order of their frequency (``Coded``), of which a paper moves as a few bytes each. For all pairs there are MOST_PANELS panels at most, so a paper is shuffled as often at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import numbered
from ..shared import keep as _keep

#: Papers of a panel at least, and panels at most.
PANEL, MOST_PANELS = 1024, 256
#: A term is dense in a panel if one paper in so many has it. Numbers of a block of similarities.
DENSE, CELLS = 16, 4_000_000
#: Decimals that similarities are rounded to before they are compared: sums of doubles come in no fixed order.
DECIMALS = 9
#: What a product in single precision of vectors of length 1 is off by, at most, and pairs that are added up at once in double precision.
ROUGH, PAIRS = 1e-4, 4_096
#: Terms whose numbers are broadcast.
COMMON = 200_000


def panels(vectors: DataFrame, keep=_keep) -> DataFrame:
    """``panel, paper_id, terms, weights`` of ``vectors`` (paper_id, term, df, w): terms of one paper alone are left out, as they make no pair."""
    pairs = F.sort_array(F.collect_list(F.struct(F.xxhash64("term").alias("t"), "w")))
    lead = F.max_by("term", F.struct("w", "term")).alias("lead")
    papers = vectors.filter("df > 1").groupBy("paper_id").agg(pairs.alias("p"), lead)
    papers = keep(papers.select("paper_id", "lead", F.col("p.t").alias("terms"), F.col("p.w").alias("weights")), "papers")
    n = papers.count()
    size = max(PANEL, -(-n // (MOST_PANELS // 2)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            run = pa.array((seen + np.arange(len(batch))) // size, pa.int64())
            seen += len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, run], names=[*batch.schema.names, "run"])

    parts = max(1, -(-n // size))
    rows = papers.repartitionByRange(parts, "lead", "paper_id").sortWithinPartitions("lead", "paper_id").withColumn("part", F.spark_partition_id())
    rows = rows.select("paper_id", "terms", "weights", "part").mapInArrow(cut, "paper_id string, terms array<long>, weights array<double>, part int, run long")
    return keep(rows.withColumn("panel", F.shiftleft(F.col("part").cast("long"), 32) + F.col("run")).drop("part", "run"), "panels")


def visits(rows: DataFrame, floors: DataFrame) -> DataFrame:
    """``paper_id, panel, floor``: the panels that can hold a match for each paper, given what it has to reach (``floors``)."""
    each = rows.select("paper_id", "panel", F.explode(F.arrays_zip("terms", "weights")).alias("p")).select("paper_id", "panel", F.col("p.terms").alias("t"), F.col("p.weights").alias("w"))
    largest = each.groupBy("t", "panel").agg(F.max("w").alias("most"))
    bound = each.drop("panel").join(largest, "t").groupBy("paper_id", "panel").agg(F.sum(F.col("w") * F.col("most")).alias("bound"))
    return bound.join(floors, "paper_id").filter(F.col("bound") >= F.col("floor") - 1e-6).select("paper_id", "panel", "floor")


class Panel:
    """An inverted index of papers: entries sorted by term; terms that many papers have as rows of a matrix."""

    def __init__(self, parts: list[pa.RecordBatch]):
        self.ids = np.array([i for p in parts for i in p.column("paper_id").to_pylist()], object)
        self.rank = np.argsort(np.argsort(self.ids))
        row, term, self.m = *_entries([p.column("terms") for p in parts]), len(self.ids)
        weight = np.concatenate([p.column("weights").flatten().to_numpy() for p in parts])
        order = np.argsort(term, kind="stable")
        self.row, self.weight = row[order].astype(np.int32), weight[order]
        self.term, self.start, self.count = np.unique(term[order], return_index=True, return_counts=True)
        self.most = np.maximum.reduceat(self.weight, self.start) if len(self.term) else self.weight
        self.dense = np.flatnonzero(self.count >= max(2, self.m / DENSE))
        self.column = np.full(len(self.term), -1)
        self.column[self.dense] = np.arange(len(self.dense))
        self.fixed: np.ndarray | None = None

    def matrix(self) -> np.ndarray:
        """The frequent terms as rows of a matrix: made when it is used, unless it is ``fixed``."""
        if self.fixed is not None:
            return self.fixed
        out = np.zeros((len(self.dense), self.m))
        for k, t in enumerate(self.dense):
            own = slice(self.start[t], self.start[t] + self.count[t])
            out[k, self.row[own]] = self.weight[own]
        return out

    def find(self, term: np.ndarray, spots: np.ndarray | None = None) -> np.ndarray:
        """The places of terms, -1 for others. ``spots``: an array of -1 for all terms, where these are numbered from 0."""
        if spots is None:
            at = np.minimum(np.searchsorted(self.term, term), len(self.term) - 1)
            return np.where(self.term[at] == term, at, -1)
        spots[self.term] = np.arange(len(self.term))
        at = spots[term]
        spots[self.term] = -1
        return at

    def similarities(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """(n, papers of the panel) products of vectors whose entries are given."""
        if not len(self.term):
            return np.zeros((n, self.m))
        wide, out = self.parts(row, self.find(term), weight, n)
        return out + wide @ self.matrix()

    def parts(self, row: np.ndarray, at: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The dense terms of vectors whose entries are given (``at``: places of their terms), and the products of the others."""
        known = at >= 0
        row, at, weight = row[known], at[known], weight[known]
        column = self.column[at]
        wide = np.zeros((n, len(self.dense)))
        wide[row[column >= 0], column[column >= 0]] = weight[column >= 0]
        row, at, weight = row[column < 0], at[column < 0], weight[column < 0]
        count = self.count[at]
        entry = np.repeat(self.start[at] - np.cumsum(count) + count, count) + np.arange(count.sum())
        cell = np.repeat(row, count) * self.m + self.row[entry]
        return wide, np.bincount(cell, np.repeat(weight, count) * self.weight[entry], n * self.m).astype(float, copy=False).reshape(n, self.m)


def _entries(lists: list[pa.ListArray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of the entries of list columns that follow each other."""
    sizes = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists])
    return np.repeat(np.arange(len(sizes)), sizes), np.concatenate([x.flatten().to_numpy() for x in lists])


def matches(rows: DataFrame, asked: DataFrame, k: int | None) -> DataFrame:
    """``a, b, similarity`` of the visits ``asked`` (paper_id, panel, floor): within the panel the first ``k`` at the floor or above, or without k all with a < b."""
    probes = rows.drop("panel").join(asked, "paper_id").select("panel", "floor", "paper_id", "terms", "weights")
    both = rows.select("panel", F.lit(None).cast("double").alias("floor"), "paper_id", "terms", "weights").unionByName(probes)
    both = both.repartition("panel").sortWithinPartitions("panel", F.col("floor").isNotNull())

    def found(panel: Panel, some: pa.RecordBatch) -> pa.RecordBatch:
        ids, floors = some.column("paper_id").to_pylist(), some.column("floor").to_numpy()
        row, term = _entries([some.column("terms")])
        scores = np.round(panel.similarities(row, term, some.column("weights").flatten().to_numpy(), len(ids)), DECIMALS)
        out = []
        for i, s in enumerate(scores):
            near = np.flatnonzero(s >= floors[i])
            near = near[panel.ids[near] != ids[i]] if k else near[panel.ids[near] > ids[i]]
            if k and len(near) > k:
                near = near[s[near] >= -np.partition(-s[near], k - 1)[k - 1]]
                near = near[np.lexsort((panel.rank[near], -s[near]))][:k]
            out += [(ids[i], panel.ids[j], s[j]) for j in near]
        return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["a", "b", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, panel = None, [], None
        for batch in batches:
            where, asks = batch.column("panel").to_numpy(), batch.column("floor").is_valid().to_numpy(zero_copy_only=False)
            for piece in np.split(np.arange(len(batch)), np.flatnonzero((np.diff(where) != 0) | np.diff(asks)) + 1):
                if not len(piece):
                    continue
                if where[piece[0]] != at:
                    at, parts, panel = where[piece[0]], [], None
                if not asks[piece[0]]:
                    parts.append(batch.slice(piece[0], len(piece)))
                    continue
                if panel is None:
                    panel, parts = Panel(parts), []
                step = max(1, CELLS // panel.m)
                for first in range(0, len(piece), step):
                    yield found(panel, batch.slice(piece[0] + first, min(step, len(piece) - first)))

    return both.mapInArrow(run, "a string, b string, similarity double")


def similar_pairs(vectors: DataFrame, least: float, keep=_keep) -> DataFrame:
    """``a, b, similarity`` (a < b) of all pairs of papers at ``least`` or above. ``keep`` writes a table and reads it back."""
    rows = panels(vectors, keep)
    return matches(rows, visits(rows, rows.select("paper_id", F.lit(least).alias("floor"))), None)


#: Papers that a task holds as panels, at most.
GROUP = 65_536


def as_rows(vectors: DataFrame, key: str = "paper_id", weight: str = "w") -> DataFrame:
    """``paper_id, terms, weights`` of ``vectors`` (key, term, df, weight), a row each; where these are dealt by key, none moves. Terms of one paper alone make no pair."""
    pairs = F.sort_array(F.collect_list(F.struct(F.xxhash64("term").alias("t"), F.col(weight).alias("w"))))
    rows = vectors.filter("df > 1").groupBy(F.col(key).alias("paper_id")).agg(pairs.alias("p"))
    return rows.select("paper_id", F.col("p.t").alias("terms"), F.col("p.w").alias("weights"))


def _apart(spark, n: int) -> list[int]:
    """``n`` numbers that a hash partitioning in ``n`` parts deals to a part each."""
    part = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    return [r.id for r in spark.range(40 * n).groupBy(part.alias("part")).agg(F.min("id").alias("id")).collect()]


def _grid(n_rows: int, n_probes: int, tasks: int) -> tuple[int, int]:
    """Groups of rows and slices of probes, a task for each of both: of the grids with tasks enough the one that moves the least."""
    least = max(1, -(-n_rows // GROUP))
    return min(((g, max(1, -(-tasks // g))) for g in range(least, max(least, tasks) + 1)), key=lambda x: x[1] * n_rows + x[0] * n_probes)


def nearest_of(rows: DataFrame, probes: DataFrame, k: int, least: float, n_rows: int, n_probes: int, read: Callable | None = None, n_terms: int = 0) -> DataFrame:
    """``a, b, similarity, r``: the first ``k`` of ``rows`` (``as_rows``, written) for each of ``probes`` (the same) at ``least`` or above but itself, ties by id.

    A probe enters a panel only if the bound of the panel reaches its floor, which rises from ``least`` to its k-th best so far; only
    the first k of each task of the grid (``_passed``) leave it. ``read`` and ``n_terms`` as ``Coded`` has them.
    """
    spots: dict = {}

    def step(held: list[Panel], some: pa.RecordBatch) -> pa.RecordBatch:
        if n_terms and not spots:
            spots[0] = np.full(n_terms, -1, np.int32)
        return _first(held, some, k, least, spots.get(0))

    found = _passed(rows, probes, n_rows, n_probes, step, "a string, b string, similarity double", read)
    order = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)


def sharing(rows: DataFrame, probes: DataFrame, need: Callable[[np.ndarray], np.ndarray], n_rows: int, n_probes: int) -> DataFrame:
    """``a, b``: which of ``probes`` and which of ``rows`` (``paper_id, terms, weights`` of ones) share as many terms as ``need`` says of the sum of their numbers of terms; one at least."""
    return _passed(rows, probes, n_rows, n_probes, lambda held, some: _sharing(held, some, need), "a string, b string")


def _passed(rows: DataFrame, probes: DataFrame, n_rows: int, n_probes: int, step: Callable[[list[Panel], pa.RecordBatch], pa.RecordBatch], schema: str, read: Callable | None = None) -> DataFrame:
    """What ``step`` makes of panels and passing probes, over a grid of tasks: each holds a group of rows as panels, and a slice of the probes passes by.

    What moves is the rows once for each slice and the probes once for each group, not a pair, and memory is bounded by GROUP.
    """
    spark = rows.sparkSession
    groups, slices = _grid(n_rows, n_probes, spark.sparkContext.defaultParallelism)
    own = _apart(spark, groups * slices)
    own += [own[0]] * (groups * slices - len(own))
    place = lambda g, s: F.get(F.array(*map(F.lit, own)), (g * slices + s).cast("int")).cast("int").alias("cell")
    dealt = lambda n: F.pmod(F.xxhash64("paper_id"), F.lit(n))
    each = lambda n, f: F.explode(F.array(*[f(F.lit(i)) for i in range(n)])).alias("cell")
    columns = ["paper_id", "terms", "weights"] if read is None else rows.columns
    both = rows.select(each(slices, lambda s: place(dealt(groups), s)), F.lit(False).alias("probe"), *columns)
    both = both.unionByName(probes.select(each(groups, lambda g: place(g, dealt(slices))), F.lit(True).alias("probe"), *columns))
    both = both.repartition(groups * slices, "cell").sortWithinPartitions("cell", "probe", *(["lead"] if "lead" in columns else []))

    plain = read or (lambda batch: batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held = None, [], []

        def hold(all_: bool) -> None:
            """Make panels of the rows that wait, PANEL at a time."""
            while sum(map(len, parts)) >= PANEL or all_ and parts:
                table = pa.Table.from_batches(parts).combine_chunks()
                held.append(Panel(table.slice(0, PANEL).to_batches()))
                parts[:] = table.slice(PANEL).to_batches()

        for batch in batches:
            where, asks = batch.column("cell").to_numpy(), batch.column("probe").to_numpy(zero_copy_only=False)
            for piece in np.split(np.arange(len(batch)), np.flatnonzero((np.diff(where) != 0) | np.diff(asks)) + 1):
                if not len(piece):
                    continue
                if where[piece[0]] != at:
                    at, parts, held = where[piece[0]], [], []
                if not asks[piece[0]]:
                    parts.append(plain(batch.slice(piece[0], len(piece))))
                    hold(False)
                    continue
                hold(True)
                if held:
                    some = max(1, CELLS // max(p.m for p in held))
                    for first in range(0, len(piece), some):
                        yield step(held, plain(batch.slice(piece[0] + first, min(some, len(piece) - first))))

    return both.mapInArrow(run, schema)


def _sharing(held: list[Panel], some: pa.RecordBatch, need: Callable[[np.ndarray], np.ndarray]) -> pa.RecordBatch:
    """The pairs of a batch of probes and all panels that share terms enough."""
    ids = np.array(some.column("paper_id").to_pylist(), object)
    row, term = _entries([some.column("terms")])
    weight, size = some.column("weights").flatten().to_numpy(), np.bincount(row, minlength=len(ids))
    out = []
    for panel in held:
        if not len(panel.term):
            continue
        shared = panel.similarities(row, term, weight, len(ids))
        sizes = np.bincount(panel.row, minlength=panel.m)
        enough = np.maximum(need(np.arange(size.max() + sizes.max() + 1)), 1)
        lowest = np.minimum.accumulate(enough[::-1])[::-1]  # of any sum from there on
        i, j = np.nonzero(shared >= lowest[size + sizes.min()][:, None])
        real = shared[i, j] >= enough[size[i] + sizes[j]]
        out.append((ids[i[real]], panel.ids[j[real]]))
    a, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])


def _first(held: list[Panel], some: pa.RecordBatch, k: int, least: float, spots: np.ndarray | None = None) -> pa.RecordBatch:
    """The first ``k`` of all panels for each probe of a batch, ties by id.

    ``floor`` is what a product in single precision has to reach: k papers are at the k-th best of these less ROUGH at least, so whatever
    is among the first k is at that less ROUGH twice.
    """
    ids = np.array(some.column("paper_id").to_pylist(), object)
    row, term = _entries([some.column("terms")])
    weight = some.column("weights").flatten().to_numpy()
    n = len(ids)
    floor = np.full(n, least - ROUGH)
    best = np.full((n, k), -np.inf, np.float32)
    out: list = []

    def cut() -> None:
        """Of what is found for each probe, the first k."""
        i, b, s = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((np.argsort(np.argsort(b)), -s, i))
        order = order[np.arange(len(order)) - np.searchsorted(i[order], i[order]) < k]
        out[:] = [(i[order], b[order], s[order])]

    for panel in held:
        if not len(panel.term):
            continue
        at = panel.find(term, spots)
        keep = np.bincount(row, np.where(at >= 0, weight * panel.most[at], 0.0), n) >= floor
        if not keep.any():
            continue
        enters = np.flatnonzero(keep)
        number = np.cumsum(keep) - 1
        own = keep[row]
        wide, thin = panel.parts(number[row[own]], at[own], weight[own], len(enters))
        matrix = panel.matrix()
        rough = wide.astype(np.float32) @ matrix.astype(np.float32)
        rough += thin
        spot = {p: i for i, p in enumerate(panel.ids)}
        self_ = [(i, j) for i, j in ((i, spot.get(x)) for i, x in enumerate(ids[enters])) if j is not None]
        if self_:
            rough[tuple(np.array(self_).T)] = -np.inf
        many = np.flatnonzero((rough >= floor[enters][:, None]).sum(axis=1) > k)
        if len(many):
            kth = np.partition(rough[many], panel.m - k, axis=1)[:, panel.m - k]
            floor[enters[many]] = np.maximum(floor[enters[many]], kth - 2 * ROUGH)
        i, j = np.nonzero(rough >= floor[enters][:, None])
        if not len(i):
            continue
        met = rough[i, j]
        order = np.lexsort((-met, i))
        place = np.arange(len(order)) - np.searchsorted(i, i)  # ``i`` is sorted
        top = np.full((len(enters), k), -np.inf, np.float32)
        top[i[place < k], place[place < k]] = met[order][place < k]
        best[enters] = np.sort(np.hstack([best[enters], top]), axis=1)[:, -k:]
        floor[enters] = np.maximum(floor[enters], best[enters, 0] - 2 * ROUGH)
        good = met >= floor[enters][i]
        i, j = i[good], j[good]
        columns = matrix.T.copy()
        exact = [thin[x, y] + np.einsum("ij,ij->i", wide[x], columns[y]) for x, y in ((i[z : z + PAIRS], j[z : z + PAIRS]) for z in range(0, len(i), PAIRS))]
        score = np.round(np.concatenate(exact), DECIMALS)
        real = score >= least
        out.append((enters[i[real]], panel.ids[j[real]], score[real]))
        if sum(len(x[0]) for x in out) > 8 * n * k:
            cut()
    if not out:
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.string(), pa.string(), pa.float64())], names=["a", "b", "similarity"])
    cut()
    i, b, s = out[0]
    return pa.RecordBatch.from_arrays([pa.array(ids[i], pa.string()), pa.array(b, pa.string()), pa.array(s, pa.float64())], names=["a", "b", "similarity"])


@dataclass
class Coded:
    """Vectors as a few bytes a term. ``rows``: paper_id, norm, lead, codes, tfs (written), of texts with a term that another has too.

    Terms of two texts or more are numbered by frequency, most frequent first, so a df belongs to a run of numbers: ``first`` and ``df``
    of each run are all that weights need (of P entries there are the square root of 2P runs at most).
    """

    rows: DataFrame
    n: int
    n_terms: int
    first: np.ndarray
    df: np.ndarray
    n_docs: int

    def idf(self, code: np.ndarray) -> np.ndarray:
        return np.log((1.0 + self.n_docs) / (1.0 + self.df[np.searchsorted(self.first, code, side="right") - 1])) + 1.0

    def read(self) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        """What makes ``paper_id, terms, weights`` of a batch of ``rows``."""
        idf, first, df, n_docs = Coded.idf, self.first, self.df, self.n_docs
        own = Coded(None, 0, 0, first, df, n_docs)

        def plain(batch: pa.RecordBatch) -> pa.RecordBatch:
            get = lambda name: batch.column(batch.schema.names.index(name))
            step, offsets = _spelled(get("codes"))
            tf, _ = _spelled(get("tfs"))
            total = np.concatenate([[0], np.cumsum(step)])
            code = total[1:] - np.repeat(total[offsets[:-1]], np.diff(offsets))
            weight = tf * idf(own, code) / np.repeat(get("norm").to_numpy(), np.diff(offsets))
            at = pa.array(offsets.astype(np.int32))
            return pa.RecordBatch.from_arrays([get("paper_id"), pa.ListArray.from_arrays(at, pa.array(code)), pa.ListArray.from_arrays(at, pa.array(weight))], names=["paper_id", "terms", "weights"])

        return plain

    def nearest(self, k: int, least: float, some: DataFrame | None = None) -> DataFrame:
        """As ``nearest_of`` for the papers ``some`` (its one column), or all."""
        probes, n = self.rows, self.n
        if some is not None:
            asked = _keep(some.select(F.col(some.columns[0]).alias("paper_id")).distinct(), "asked")
            n = asked.count()
            probes = self.rows.join(F.broadcast(asked) if n <= COMMON else asked, "paper_id", "left_semi")
        return nearest_of(self.rows, probes, k, least, self.n, n, self.read(), self.n_terms)


def _spell(x: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Whole numbers of 0 or more as bytes, seven bits each, the last of a number below 128: a value for each of ``sizes`` that follow each other."""
    n = 1 + sum((x >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    begin = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint8)
    for k in range(5):
        some = np.flatnonzero(n > k)
        out[begin[some] + k] = (x[some] >> 7 * k & 127) | np.where(n[some] > k + 1, 128, 0)
    ends = np.append(begin, len(out))[np.concatenate([[0], np.cumsum(sizes)])]
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


def _spelled(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ``_spell``, and where those of each value begin."""
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], np.uint8)[ends[0] : ends[-1]] if values.buffers()[2] is not None else np.zeros(0, np.uint8)
    last = data < 128
    begin = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]) if len(data) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begin, len(data)))
    place = np.arange(len(data)) - np.repeat(begin, sizes)
    x = np.add.reduceat((data & 127).astype(np.int64) << 7 * place, begin) if len(data) else np.zeros(0, np.int64)
    return x, np.searchsorted(begin, ends - ends[0])


def coded(rows: DataFrame, key: str, df: DataFrame, n_docs: int) -> Coded:
    """``Coded`` of ``rows`` (``key, terms, tfs``, as ``packed.counted`` gives them) and ``df`` (term, df).

    The numbers of the COMMON most frequent terms are broadcast. Only the entries of others that are not of their text alone go to their
    terms, and come back as a list for each text.
    """
    spark = rows.sparkSession
    order = F.struct((-F.col("df")).alias("n"), F.col("term"))
    terms = numbered(df.filter("df > 1").select(order.alias("o")), "o", "code")
    terms = terms.select(F.col("o.term").alias("term"), (-F.col("o.n")).alias("df"), (F.col("code") - 1).cast("int").alias("code"))
    runs = terms.groupBy("df").agg(F.min("code").alias("first"), F.count("*").alias("n")).orderBy("first").collect()
    n_terms = sum(r.n for r in runs)
    own = Coded(None, 0, n_terms, np.array([r.first for r in runs], np.int64), np.array([r.df for r in runs], float), n_docs)
    known = spark.sparkContext.broadcast([r.term for r in terms.filter(F.col("code") < COMMON).select("term", "code").orderBy("code").collect()])
    alone = (np.log((1.0 + n_docs) / 2.0) + 1.0) ** 2 if n_docs else 1.0

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = pa.array(known.value, pa.string())
        for batch in batches:
            lists, tf = batch.column(1), batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            coded_ = lists.flatten().dictionary_encode()
            code = pc.fill_null(pc.index_in(coded_.dictionary, common), -1).to_numpy(zero_copy_only=False)[coded_.indices.to_numpy(zero_copy_only=False)] if len(tf) else np.zeros(0, np.int32)
            owner = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
            good = code >= 0
            ends = lambda x: pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[x], minlength=len(batch)))]).astype(np.int32))
            rare = pa.ListArray.from_arrays(ends(~good), lists.flatten().take(pa.array(np.flatnonzero(~good))))
            made = [pa.ListArray.from_arrays(ends(x), pa.array(y)) for x, y in ((good, code[good].astype(np.int32)), (good, tf[good].astype(np.int32)), (~good, tf[~good].astype(np.int32)))]
            rest = np.bincount(owner[~good], tf[~good].astype(float) ** 2, len(batch)).astype(float)  # of nothing numpy makes whole numbers
            yield pa.RecordBatch.from_arrays([batch.column(0), made[0], made[1], rare, made[2], pa.array(rest)], names=["paper_id", "codes", "tfs", "rare", "rare_tfs", "rest"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, code = _entries([batch.column(1)])
            tf = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            rest = batch.column(3).to_numpy().copy()
            if batch.num_columns > 4:
                more = batch.column(4)
                sizes = pc.fill_null(pc.list_value_length(more), 0).to_numpy(zero_copy_only=False)
                own_ = np.repeat(np.arange(len(batch)), sizes)
                flat = more.flatten()
                rare, rare_tf = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
                rest -= np.bincount(own_, rare_tf.astype(float) ** 2, len(batch))
                owner, code, tf = np.concatenate([owner, own_]), np.concatenate([code, rare]), np.concatenate([tf, rare_tf])
            order = np.lexsort((code, owner))
            owner, code, tf = owner[order], code[order].astype(np.int64), tf[order].astype(np.int64)
            sizes = np.bincount(owner, minlength=len(batch))
            norm = np.sqrt(np.bincount(owner, (tf * own.idf(code)) ** 2, len(batch)) + rest * alone) if len(code) else np.zeros(len(batch))
            begins = np.diff(owner, prepend=-1) != 0
            step = np.where(begins, code, np.diff(code, prepend=0))
            lead = np.zeros(len(batch), np.int32)
            lead[owner[begins]] = code[begins]
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(norm), pa.array(lead), _spell(step, sizes), _spell(tf, sizes)], names=["paper_id", "norm", "lead", "codes", "tfs"])
            yield made.filter(pa.array(sizes > 0))

    halves = rows.select(F.col(key).cast("string").alias("paper_id"), "terms", "tfs").mapInArrow(split, "paper_id string, codes array<int>, tfs array<int>, rare array<string>, rare_tfs array<int>, rest double")
    schema = "paper_id string, norm double, lead int, codes binary, tfs binary"
    if n_terms <= COMMON:
        out = halves.select("paper_id", "codes", "tfs", "rest").mapInArrow(spell, schema)
    else:
        each = halves.select("paper_id", F.explode(F.arrays_zip("rare", "rare_tfs")).alias("p")).select("paper_id", F.col("p.rare").alias("term"), F.col("p.rare_tfs").alias("tf"))
        more = each.join(terms.filter(F.col("code") >= COMMON).select("term", "code"), "term").groupBy("paper_id").agg(F.collect_list(F.struct("code", "tf")).alias("more"))
        out = halves.select("paper_id", "codes", "tfs", "rest").join(more, "paper_id", "left").mapInArrow(spell, schema)
    out = _keep(out, "coded")
    return replace(own, rows=out, n=out.count())


def nearest(vectors: DataFrame, k: int, least: float, keep=_keep) -> DataFrame:
    """``a, b, similarity, r``: the first ``k`` papers of each at ``least`` or above, ties by id."""
    rows = keep(as_rows(vectors), "papers")
    n = rows.count()
    return nearest_of(rows, rows, k, least, n, n)
