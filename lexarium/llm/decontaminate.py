"""Benchmark decontamination: rare word seeds, then Smith-Waterman alignment.

The test items are a query set against all documents, taken in blocks of bounded size. A block is held by every worker;
documents never move. A first pass counts in how many documents each word of the block is; an item's seeds are its
words without the commonest, as many left out as the threshold allows. A second pass aligns the item with each document
that has enough of its seeds; the score is the alignment's share of the item aligned with itself, so edits, gaps and
insertions cost a little each. Both bounds before the alignment are exact: no pair that reaches the threshold is lost.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import pick
from .shingles import blocks, marks_as_white, word_hashes

#: Bytes of item texts in a block, score from which a passage counts as a copy, cells of a table of windows by items.
BLOCK_BYTES, THRESHOLD, CELLS = 4_000_000, 0.5, 4_000_000
#: Alignment: a match, a mismatch or a gap of one word.
MATCH, MISMATCH, GAP = 2, -1, -1
_WHITE = marks_as_white()


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score, and the end of it in the passage. Rows are items' words; a row's gaps are a running maximum."""
    across = np.arange(len(passage) + 1) * -GAP
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(passage == word, MATCH, MISMATCH), np.maximum(row[1:] + GAP, 0))
        row = np.maximum.accumulate(new + across) - across
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def least_score(size: int, threshold: float) -> int:
    """The least alignment score of an item of ``size`` words that reaches the threshold."""
    return max(1, math.ceil(threshold * MATCH * size - 1e-9))


def expand(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after another, and for each the index of its range."""
    n = stops - starts
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + starts[owner], owner


@dataclass
class Block:
    """Items as word hashes and their distinct words: sorted, from ``bounds`` on the items of each, and the other way round.

    ``weights`` tell how often an item has the word. The same for seeds alone; of an item's, a window must have ``need``.
    """

    ids: list
    items: list[np.ndarray]
    vocabulary: np.ndarray
    bounds: np.ndarray
    word_items: np.ndarray
    weights: np.ndarray
    item_bounds: np.ndarray
    item_words: np.ndarray
    seed_bounds: np.ndarray | None = None
    seed_items: np.ndarray | None = None
    seed_weights: np.ndarray | None = None
    need: np.ndarray | None = None

    @staticmethod
    def of(ids: list, texts: list[str | None]) -> Block:
        items, keep = [], []
        for i, text in zip(ids, texts):
            words, _ = word_hashes([(text or "").encode()], _WHITE)
            if len(words):
                items.append(words)
                keep.append(i)
        vocabulary, k = np.unique(np.concatenate([*items, np.empty(0, np.uint64)]), return_inverse=True)
        owner = np.repeat(np.arange(len(items)), [len(w) for w in items])
        pairs, weights = np.unique(k.astype(np.int64) * max(1, len(items)) + owner, return_counts=True)
        word, item = np.divmod(pairs, max(1, len(items)))
        return Block(keep, items, vocabulary, np.searchsorted(word, np.arange(len(vocabulary) + 1)), item, weights, np.searchsorted(np.sort(item), np.arange(len(items) + 1)), word[np.lexsort((word, item))])

    def seeds(self, counts: np.ndarray, threshold: float) -> Block:
        """The block with seeds by ``counts``, the documents of each word of the vocabulary.

        A score of s takes s / MATCH matched places of an item at least. Leaving out places leaves as many fewer to be
        found; the commonest words go while half of the matches needed is still asked of the others.
        """
        size = np.array([len(w) for w in self.items])
        least = np.array([-(-least_score(n, threshold) // MATCH) for n in size.tolist()])
        word = np.repeat(np.arange(len(self.vocabulary)), np.diff(self.bounds))
        order = np.lexsort((word, -counts[word], self.word_items))
        before = np.cumsum(self.weights[order])
        first = np.searchsorted(self.word_items[order], np.arange(len(size)))
        before -= np.repeat(before[first] - self.weights[order][first], np.diff([*first, len(order)]))
        left_out = np.zeros(len(word), bool)
        left_out[order] = before <= (least // 2)[self.word_items[order]]
        need = least - np.bincount(self.word_items, self.weights * left_out, len(size)).astype(np.int64)
        keep = ~left_out
        return replace(self, seed_bounds=np.searchsorted(word[keep], np.arange(len(self.vocabulary) + 1)), seed_items=self.word_items[keep], seed_weights=self.weights[keep], need=need)


class Finder:
    """Places in words where a hash of a sorted list is: a bit table first, then a search."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.table = np.zeros(1 << 20, bool)
        self.table[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places, and the first index in the list of the hash there."""
        if not len(self.hashes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero(self.table[(runs >> np.uint64(44)).astype(np.int64)])
        k = np.searchsorted(self.hashes, runs[at])
        k[k == len(self.hashes)] = 0
        hit = self.hashes[k] == runs[at]
        return at[hit], k[hit]


def _places(texts: list[str | None], finder: Finder):
    """For each block of texts: index of its first, bounds of words, words, and place, text and number in the vocabulary of those in it."""
    for first, block in blocks([(t or "").encode() for t in texts]):
        words, bounds = word_hashes(block, _WHITE)
        at, k = finder(words)
        yield first, bounds, words, at, np.searchsorted(bounds, at, "right") - 1, k


def _count(block: Block):
    def run(batches):
        size = len(block.vocabulary)
        total, finder = np.zeros(size, np.int64), Finder(block.vocabulary)
        for batch in batches:
            for _, _, _, _, doc, k in _places(batch.column("text").to_pylist(), finder):
                total += np.bincount(np.unique(doc * size + k) % size, minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["k", "docs"])

    return run


def _likely(block: Block, windows: np.ndarray, k: np.ndarray, n_windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows and items of which they have the seeds that are needed."""
    n_items, size = len(block.items), len(block.vocabulary)
    window, word = np.divmod(np.unique(windows * size + k), size)
    step = max(1, CELLS // n_items)
    out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for low in range(0, n_windows, step):
        a, b = np.searchsorted(window, [low, low + step])
        j, owner = expand(block.seed_bounds[word[a:b]], block.seed_bounds[word[a:b] + 1])
        table = np.bincount((window[a:b] - low)[owner] * n_items + block.seed_items[j], block.seed_weights[j], step * n_items)
        w, i = np.nonzero(table.reshape(step, n_items) >= block.need)
        out.append((w + low, i))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _candidates(block: Block, bounds: np.ndarray, at: np.ndarray, doc: np.ndarray, k: np.ndarray, least: np.ndarray):
    """(document, item, first place, place after the last, hits) of all pairs whose alignment can reach the least score.

    An alignment that reaches it spans a bounded number of words: a window of twice as many must have the seeds that
    the item needs. Then every word of a passage that isn't the item's costs one at least, so the best sum over a run
    of places, 2 for the item's words and -1 for others, bounds the alignment's score.
    """
    n_items, size, cost = len(block.items), len(block.vocabulary), min(-MISMATCH, -GAP)
    sizes = np.array([len(w) for w in block.items])
    span = int((sizes + (MATCH * sizes - least) // cost).max())
    n = -(-np.diff(bounds) // span)
    base = np.cumsum(n) - n
    own = (at - bounds[doc]) // span
    later = own > 0
    window, item = _likely(block, np.concatenate([base[doc] + own, (base[doc] + own - 1)[later]]), np.concatenate([k, k[later]]), int(n.sum()))
    pairs = np.unique(np.repeat(np.arange(len(n)), n)[window] * n_items + item)
    if not len(pairs):
        return
    # the places of each pair: of the item's words in the document
    keys = doc * size + k
    by_word = np.argsort(keys, kind="stable")
    keys = keys[by_word]
    d, i = np.divmod(pairs, n_items)
    j, pair = expand(block.item_bounds[i], block.item_bounds[i + 1])
    wanted = d[pair] * size + block.item_words[j]
    j, owner = expand(np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right"))
    pair, place = pair[owner], at[by_word[j]]
    order = np.argsort(pair * int(bounds[-1]) + place)
    pair, place = pair[order], place[order]
    first = np.searchsorted(pair, np.arange(len(pairs)))
    # the sum from one hit to another is the difference of their values + MATCH; pairs are set apart, so that one running minimum does for all
    value = (MATCH + cost) * (np.arange(len(pair)) - first[pair]) - cost * (place - place[first][pair])
    value -= pair * (int(value.max()) - int(value.min()) + 1)
    bound = np.maximum.reduceat(value - np.minimum.accumulate(value), first) + MATCH
    last = np.append(first[1:], len(pair)) - 1
    for g in np.flatnonzero(bound >= least[i]).tolist():
        yield int(d[g]), int(i[g]), int(place[first[g]]), int(place[last[g]]) + 1, int(last[g] - first[g] + 1)


def _hits(block: Block, texts: list[str | None], threshold: float, finder: Finder):
    """(text, item, score, seeds, first word, end word) of every text and item whose alignment reaches the threshold."""
    least = np.array([least_score(len(w), threshold) for w in block.items])
    for first, bounds, words, at, doc, k in _places(texts, finder):
        for d, i, a, b, n in _candidates(block, bounds, at, doc, k, least):
            query = block.items[i]
            score, end = align(query, words[a:b])
            if score >= least[i]:
                back = align(query[::-1], words[a : a + end][::-1])[1]
                end += a - int(bounds[d])
                yield first + d, i, score / (MATCH * len(query)), n, end - back, end


def _blocks(rows: DataFrame, benchmark: DataFrame, threshold: float, item_col: str, text_col: str):
    """Blocks of the benchmark with their seeds by the counts over all rows, one after another."""
    items = pick(benchmark, item=item_col, text=text_col).distinct()  # so that a block is no larger than its share
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / BLOCK_BYTES))
    for b in range(n_blocks):
        own = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == b).orderBy("item", "text").collect()
        block = Block.of([r.item for r in own], [r.text for r in own])
        if not block.items:
            continue
        counts = np.zeros(len(block.vocabulary), np.int64)
        for r in rows.select("text").mapInArrow(_count(block), "k long, docs long").groupBy("k").agg(F.sum("docs").alias("docs")).collect():
            counts[r.k] = r.docs
        yield block.seeds(counts, threshold)


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Copies of test items in documents: ``id_col, item_id, score, n_seeds, first_word, end_word``, one row for each pair.

    Words are compared without case (A-Z) and ASCII marks. ``score`` is 1 for a whole verbatim copy. All
    pairs at the threshold are found; ``n_seeds`` counts the words of the document that are the item's.

    Nulls: null or wordless texts and items have no matches; null ids are carried. Repeated rows each have their
    matches; items of one text each match, repeated rows of the benchmark once. Empty tables give no rows. Texts are read whole; further columns are ignored.
    """
    rows = pick(docs, id=id_col, text=text_col)
    kinds = dict(rows.dtypes) | {"item": dict(benchmark.dtypes)[item_col]}
    schema = f"{id_col} {kinds['id']}, {item_col} {kinds['item']}, score double, n_seeds long, first_word long, end_word long"
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)

    def search(block: Block):
        def run(batches):
            finder = Finder(block.vocabulary)
            for batch in batches:
                got = list(_hits(block, batch.column("text").to_pylist(), threshold, finder))
                columns = list(zip(*got)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(columns[0], pa.int64())), pa.array([block.ids[i] for i in columns[1]], item_type), pa.array(columns[2], pa.float64()), *[pa.array(c, pa.int64()) for c in columns[3:]]],
                    names=[id_col, item_col, "score", "n_seeds", "first_word", "end_word"],
                )

        return run

    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(rows, benchmark, threshold, item_col, item_text_col):
        out = out.unionByName(rows.mapInArrow(search(block), schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a copy of a test item. Columns must have distinct names.

    Nulls: a row with a null text stays, as does any row beside null or wordless items. Repeated rows go or stay together.
    Empty tables: no rows of an empty ``docs``, all rows beside an empty benchmark. Texts are read whole.
    """
    rows = pick(docs, text=text_col)
    out = docs

    def clean(block: Block):
        def run(batches):
            finder = Finder(block.vocabulary)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[h[0] for h in _hits(block, batch.column(text_col).to_pylist(), threshold, finder)]] = False
                yield batch.filter(pa.array(keep))

        return run

    for block in _blocks(rows, benchmark, threshold, item_col, item_text_col):
        out = out.mapInArrow(clean(block), docs.schema)
    return out
