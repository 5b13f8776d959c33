"""Mixing sources to target weights: hierarchical budgets and seeded epochs.

Weights are propagated through a domain-language-source tree. A node whose documents can't fill its share gives the
rest to its siblings; only what they can't take goes up to the siblings of an ancestor. Each leaf's budget is then
whole epochs of its documents plus the longest prefix that fits of one more epoch, each epoch in an order of its own
seed. The tree is a table: each level is shared out by aggregations, so that its number of leaves doesn't matter.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, lookup, materialise, pick, words

LEVELS = ["domain", "lang", "source"]
#: Documents of a leaf in a range of its seeded order, about: no task orders a whole leaf.
RANGE_ROWS = 4096
#: Bits of a key that a round of the search for a rank looks at.
DIGIT = 12


def epoch_key(seed: int, epoch: Column, row: Column) -> Column:
    """The place of a row (a hash of it) in an epoch's order: a number from 0 on, smallest first."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch, row), 1)


def _weight(name: Column, weights: Mapping[str, float]) -> Column:
    """The weight of a node by its name: 1 where none is given."""
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*[x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.element_at(table, name), F.lit(1.0))


def water_fill(nodes: DataFrame, parents: DataFrame, on: str) -> DataFrame:
    """``nodes`` (``on`` of the parent, ``node``, ``w``, ``cap``) with ``budget``: the parents' (``on``, ``budget``) by weight, what a full node can't take going to its siblings.

    Each round finds the level ``budget / weight`` of what is left for the open nodes of every parent at once; nodes
    that it fills are closed with what they can take. Rounds end when no node is closed any more; nodes without weight
    or room have nothing. Both inputs are written tables.
    """
    salt, n = F.xxhash64("node"), parents.count()
    state = lookup(nodes.withColumns({"open": (F.col("w") > 0) & (F.col("cap") > 0), "level": F.lit(0.0)}), parents, on, salt, n=n)
    n_open = -1
    while True:
        left = F.first("budget") - F.coalesce(F.sum(F.when(~F.col("open") & (F.col("w") > 0), F.col("cap"))), F.lit(0.0))
        levels = state.groupBy(on).agg((left / F.sum(F.when(F.col("open"), F.col("w")))).alias("level"))
        levels = levels.select(on, F.coalesce("level", F.lit(0.0)).alias("level"))
        new = lookup(state.drop("level"), levels, on, salt, n=n).withColumn("open", F.col("open") & (F.col("cap") > F.col("w") * F.col("level")))
        before, state = state, materialise(new, "mix-nodes")
        if n_open >= 0:
            discard(before)
        now = state.agg(F.count_if("open")).first()[0]
        if now == n_open or now == 0:
            break
        n_open = now
    share = F.when(F.col("open"), F.col("w") * F.col("level")).when(F.col("w") > 0, F.col("cap")).otherwise(0.0)
    return state.withColumn("budget", share).drop("open", "level")


def _least_of_first(keys: DataFrame, n: int) -> int:
    """The ``n``-th largest of the 62-bit numbers ``key``: their digits from the top, one count of all by digit in a round."""
    low, bits = 0, 62
    while bits > 0:
        step = min(DIGIT, bits)
        bits -= step
        own = keys.filter((F.col("key") >= low) & (F.col("key") <= low + (1 << (bits + step)) - 1))
        counts = own.groupBy(F.shiftright(F.col("key") - low, bits).alias("digit")).agg(F.count("*").alias("n")).collect()  # at most 2 ** DIGIT rows
        for r in sorted(counts, key=lambda r: -r.digit):
            if r.n >= n:
                low += r.digit << bits
                break
            n -= r.n
    return low


def _whole(leaves: DataFrame, total: int) -> DataFrame:
    """``leaves`` with ``budget`` in whole tokens that sum up to ``total``: the largest fractions are rounded up, ties by a hash of the path."""
    floor = F.floor(F.col("budget") + 1e-9)
    fraction = F.greatest(F.col("budget") - floor, F.lit(0.0))
    key = F.shiftleft(F.least(F.floor(fraction * (1 << 30)), F.lit((1 << 30) - 1)), 32) + F.shiftrightunsigned(F.xxhash64(*LEVELS), 32)
    keyed = materialise(leaves.withColumns({"whole": floor.cast("long"), "key": F.when(F.col("budget") + 1e-9 < F.col("cap"), key).otherwise(-1)}), "mix-whole")
    missing = total - (keyed.agg(F.sum("whole")).first()[0] or 0)
    room = keyed.filter("key >= 0")
    if missing <= 0:
        return keyed.withColumn("budget", F.col("whole"))
    bound = _least_of_first(room, missing) if room.count() > missing else -1
    above = room.filter(F.col("key") > bound).count()
    # equal keys at the bound are a few at most: paths whose 32-bit hashes are equal
    tied = room.filter((F.col("key") == bound) & (bound >= 0)).select(*LEVELS, F.row_number().over(Window.partitionBy("key").orderBy(*LEVELS)).alias("tie")).filter(F.col("tie") <= missing - above)
    up = (F.col("key") >= 0) & ((F.col("key") > bound) | F.col("tie").isNotNull())
    return keyed.join(tied, LEVELS, "left").withColumn("budget", F.col("whole") + up.cast("long"))


def budgets(leaves: DataFrame, total: float, weights: list[Mapping[str, float]], max_epochs: int) -> DataFrame:
    """``domain, lang, source, n, budget``: whole tokens for each leaf (``domain, lang, source, n`` tokens there are).

    ``weights``: for each level name -> weight, 1 if absent. A node can take what its children of a weight can, so that
    weight 0 anywhere on a path has no room; a leaf can take ``max_epochs`` times its tokens. The budgets sum up to the
    whole part of ``total``, or to the room of the tree where that is less.
    """
    path = lambda depth: F.xxhash64(F.lit(depth), *LEVELS[:depth])
    w = [_weight(F.col(c), weights[i]) for i, c in enumerate(LEVELS)]
    tree = leaves.withColumns({f"w{i}": x for i, x in enumerate(w)} | {f"p{d}": path(d) for d in range(len(LEVELS) + 1)})
    room = F.when((F.col("w0") > 0) & (F.col("w1") > 0) & (F.col("w2") > 0), F.col("n") * float(max_epochs)).otherwise(0.0)
    tree = materialise(tree.withColumn("cap", room), "mix-tree")
    can = tree.agg(F.coalesce(F.sum("cap"), F.lit(0.0))).first()[0]
    amount = min(float(total), can)
    shared = materialise(tree.select(F.col("p0").alias("parent")).distinct().withColumn("budget", F.lit(amount)), "mix-shared")
    for depth in range(1, len(LEVELS) + 1):
        nodes = tree.groupBy(F.col(f"p{depth - 1}").alias("parent"), F.col(f"p{depth}").alias("node")).agg(F.first(f"w{depth - 1}").alias("w"), F.sum("cap").alias("cap"))
        filled = water_fill(materialise(nodes, "mix-level"), shared, "parent")
        shared = materialise(filled.select(F.col("node").alias("parent"), "budget"), "mix-shared")
    out = tree.select(*LEVELS, "n", "cap", F.col("p3").alias("parent")).join(shared, "parent").drop("parent")
    return _whole(out, math.floor(amount + 1e-6)).select(*LEVELS, "n", "budget")


def mix(docs: DataFrame, domain: Column | None = None, weights: list[Mapping[str, float]] | None = None, total_share: float = 0.5, max_epochs: int = 4, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that the mixture uses: ``id_col, domain, lang, source, n_tokens, epochs, last_epoch, place``.

    ``epochs`` is how often a document is used: in each of its leaf's whole epochs, and in ``last_epoch`` (numbered from
    0, the one that is cut) if it is within the prefix. ``place`` is its place in that epoch's order, null if it isn't in
    it; ``epoch_rows`` gives the places in all epochs. ``domain`` is an expression over ``lang`` and ``source`` (default:
    one domain); ``weights`` holds a mapping for each level (domain, language, source). The budget is ``total_share`` of
    the tokens (words) there are.

    Nulls: a null text has no token; a null language or source is the leaf value ''; a null id is kept. Documents
    without a token are never used. Repeated rows (equal in id and text) are documents of their own at one place: a
    prefix has some or all of them. An empty table gives no rows. Texts are counted whole; further columns are ignored.
    """
    weights = weights or [{}, {}, {}]
    rows = pick(docs, id=id_col, text=text_col, lang=lang_col, source=source_col)
    rows = rows.select("id", F.xxhash64("id", "text").alias("row"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.size(words(F.col("text"))).cast("long").alias("n_tokens"))
    rows = rows.withColumn("domain", F.lit("all") if domain is None else F.coalesce(domain.cast("string"), F.lit(""))).filter("n_tokens > 0")
    rows = materialise(rows.withColumn("leaf", F.xxhash64(*LEVELS)), "mix-docs")
    leaves = materialise(rows.groupBy("leaf", *LEVELS).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")), "mix-leaves")
    total = leaves.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    plan = budgets(leaves.select(*LEVELS, "n"), total_share * total, weights, max_epochs)
    quota = plan.filter("budget > 0").join(leaves.select("leaf", "docs", *LEVELS), LEVELS)
    whole = F.floor(F.col("budget") / F.col("n"))
    quota = materialise(quota.select("leaf", whole.alias("full"), (F.col("budget") - whole * F.col("n")).alias("rest"), F.ceil(F.col("docs") / RANGE_ROWS).alias("ranges")), "mix-quota")

    used = lookup(rows, quota, "leaf", F.col("row")).withColumn("key", epoch_key(seed, F.col("full"), F.col("row")))
    # the upper 31 bits of the key, scaled to the number of ranges
    used = used.withColumn("range", F.shiftright(F.shiftright("key", 32) * F.col("ranges"), 31))
    used = materialise(used.drop("ranges"), "mix-used")
    ahead = used.groupBy("leaf", "range").agg(F.sum("n_tokens").alias("n"))
    ahead = ahead.withColumn("ahead", F.sum("n").over(Window.partitionBy("leaf").orderBy("range")) - F.col("n")).drop("n")
    within = Window.partitionBy("leaf", "range").orderBy("key", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = used.join(ahead, ["leaf", "range"]).withColumn("upto", F.col("ahead") + F.sum("n_tokens").over(within))
    inside = F.col("upto") <= F.col("rest")
    placed = placed.withColumn("epochs", F.col("full") + inside.cast("long")).filter("epochs > 0")
    return placed.select(F.col("id").alias(id_col), *LEVELS, "n_tokens", "epochs", F.col("full").alias("last_epoch"), F.when(inside, F.col("key")).alias("place"), F.col("row").alias("row_hash"))


def epoch_rows(mixed: DataFrame, seed: int = 17) -> DataFrame:
    """A row of ``mix`` for each time that its document is used: with ``epoch`` and ``place``, by which an epoch is to be read."""
    rows = mixed.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_epoch"))))
    rows = rows.filter((F.col("epoch") < F.col("last_epoch")) | F.col("place").isNotNull())
    return rows.withColumn("place", epoch_key(seed, F.col("epoch"), F.col("row_hash")))
