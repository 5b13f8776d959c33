"""Conversation prefix trie: what conversations share from their beginning, as a tree whose nodes are named by their smallest member.

Every distinct sequence of first d turns is a node; the conversations that start with it are its members, and the smallest of
them owns it. A conversation that owns depth d owns all deeper ones of its own, so its nodes are one chain from its first
owned depth to its end. That depth is found by binary search, for all conversations at once: a round joins one prefix digest
of each conversation to the minima of the prefix digests, and reads only the depths that the round can ask for. The last
owner above tells where the chain hangs, so that the chains form the tree; sums go from chains to the chains above by
pointer doubling, so that a chain of k chains takes log2(k) rounds.

No group has to fit into a task: positions are ranks within sorted ranges plus the counts of the ranges before, running
digests and sums go by blocks of 4,096 depths, and lists of members are hashed piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, pick, spread_join, words

#: Depths, and conversation ids, of a piece that one window or one list holds.
BLOCK = 4096

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def block_of(number: Column) -> Column:
    return F.floor(number / BLOCK).cast("long")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, digest of role and text, n_words of the text), turns in order, null first, ties by digest.

    Null role or text is empty; rows without conv_id have no conversation. Rows are sorted in ranges, so one conversation
    may lie in many; a range starts with at most one conversation that began earlier, so offsets are as few as ranges.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")]
    rows = pick(conversations, "conv_id", "turn", "role", "text").filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.size(words(text)).cast("long").alias("n_words"),
        F.monotonically_increasing_id().alias("row"),
    )
    ranges = materialise(rows.repartitionByRange(*key).withColumn("range", F.spark_partition_id()), "turn-ranges")
    sizes = ranges.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begun = sizes.withColumn("before", F.sum("n").over(before)).filter("before > 0").drop("n")
    rank = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*key[1:]))
    placed = ranges.withColumn("rank", rank.cast("long")).join(F.broadcast(begun), ["conv_id", "range"], "left")
    return placed.select("conv_id", (F.coalesce("before", F.lit(0)) + F.col("rank")).alias("pos"), "digest", "n_words")


def sizes_of(turns: DataFrame) -> DataFrame:
    """(conv_id, n) of turns."""
    return turns.groupBy("conv_id").agg(F.max("pos").alias("n"))


def spliced(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations with the first h turns of their family's first, h = crc32(id) % ``most``, then their own from h on.

    ``turns`` are written ``ordered_turns``. Returns the turns (conv_id, n, pos, digest, n_words) and the conversations
    (conv_id, n), those without turns included.
    """
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    sizes = materialise(sizes_of(turns), "conversation-sizes")
    first = F.col("conv_id") - F.col("conv_id") % family
    firsts = sizes.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("first"), F.col("n").alias("n_first"))
    convs = sizes.withColumnsRenamed({"n": "size"}).withColumns({"h": head, "first": first}).join(firsts, "first", "left")
    taken = F.least("h", F.coalesce("n_first", F.lit(0)))
    convs = convs.withColumn("k", taken).withColumn("n", F.col("k") + F.greatest(F.col("size") - F.col("h"), F.lit(0)))
    convs = materialise(convs.select("conv_id", "first", "size", "h", "k", "n"), "spliced")
    heads = turns.filter((F.col("pos") < most) & (F.col("conv_id") % family == 0)).withColumnsRenamed({"conv_id": "first"})
    taken_rows = convs.filter("k > 0").select("conv_id", "first", "n", "k").join(heads, "first").filter("pos <= k")
    own = spread_join(turns, convs.select("conv_id", "n", "h", "k", "size"), ["conv_id"], turns.count()).filter("pos > h")
    own = own.withColumn("pos", F.col("pos") - F.col("h") + F.col("k"))
    columns = ["conv_id", "n", "pos", "digest", "n_words"]
    return taken_rows.select(*columns).unionByName(own.select(*columns)), convs.select("conv_id", "n")


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, n, pos, digest, n_words) with two 64-bit digests p and q of the turns up to and with each.

    A prefix digest is the xor of hashes of (place, turn's SHA-256): two sequences agree by chance once in 2^128.
    """
    block = block_of(F.col("pos") - 1)
    rows = turns.withColumns({"block": block, "p": F.xxhash64("pos", "digest"), "q": F.xxhash64("digest", F.lit("q"), "pos")})
    upto = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.filter(F.col("n") > BLOCK).groupBy("conv_id", "block").agg(F.bit_xor("p").alias("bp"), F.bit_xor("q").alias("bq"))
    whole = whole.select("conv_id", "block", F.bit_xor("bp").over(before).alias("bp"), F.bit_xor("bq").over(before).alias("bq"))
    out = rows.withColumns({c: F.bit_xor(c).over(upto) for c in "pq"}).join(whole, ["conv_id", "block"], "left")
    out = out.withColumns({c: F.col(c).bitwiseXOR(F.coalesce(f"b{c}", F.lit(0))) for c in "pq"})
    return out.select("conv_id", "n", "pos", "n_words", "p", "q")


def first_owned(convs: DataFrame, prefix: DataFrame, minima: DataFrame, root: int, n_convs: int, deepest: int) -> DataFrame:
    """(conv_id, n, at, above): the deepest depth that the conversation doesn't own (0: none), and that depth's owner.

    One round for each power of two, highest first: it asks for depth ``at`` + step, whose lowest set bit is the step, so
    the rounds together read each prefix once.
    """
    state = convs.withColumns({"at": F.lit(0).cast("long"), "above": F.lit(root).cast("long")})
    step = 1 << deepest.bit_length() >> 1
    while step:
        asked = prefix.filter(F.col("pos").bitwiseAND(-F.col("pos")) == step).select("conv_id", "pos", "p", "q")
        going = state.filter(F.col("at") + step <= F.col("n")).withColumn("pos", F.col("at") + step)
        going = materialise(going.join(asked, ["conv_id", "pos"]), "asked")
        found = spread_join(going, minima.select("pos", "p", "q", "owner", F.col("n_convs").alias("size")), ["pos", "p", "q"], n_convs)
        other = F.col("owner") < F.col("conv_id")
        found = found.select("conv_id", "n", F.when(other, F.col("pos")).otherwise(F.col("at")).alias("at"), F.when(other, F.col("owner")).otherwise(F.col("above")).alias("above"))
        state = materialise(state.filter(F.col("at") + step > F.col("n")).unionByName(found), "searched")
        step >>= 1
    return state


def summed_up(chains: DataFrame) -> DataFrame:
    """``chains`` (conv_id, above, saved, leaves) with sums over all chains below each, itself included; pointers double."""
    while not chains.filter("above is not null").isEmpty():
        sums = chains.filter("above is not null").groupBy(F.col("above").alias("conv_id"))
        sums = materialise(sums.agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"), F.count("*").alias("size")), "chain-sums")
        higher = sums.select("conv_id", "size").join(chains.select("conv_id", F.col("above").alias("next")), "conv_id")
        higher = materialise(higher.withColumnsRenamed({"conv_id": "above"}), "chain-pointers")
        hanging = chains.filter("above is not null")
        moved = spread_join(hanging, higher, ["above"], chains.count()).withColumn("above", F.col("next")).drop("next", "size")
        moved = moved.unionByName(chains.filter("above is null")).join(sums, "conv_id", "left")
        saved, leaves = (F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("saved", "leaves"))
        chains = materialise(moved.select("conv_id", "above", saved.alias("saved"), leaves.alias("leaves")), "chains")
    return chains.drop("above")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (conv_id, depth, ends_sha256) for each run of pieces of a list; the pieces come in order, one at a time."""
    last, sha = None, None
    for batch in batches:
        done = []
        for conv, depth, piece in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "piece")), strict=True):
            if (conv, depth) == last:
                sha.update(b",")
            else:
                if last:
                    done.append((*last, sha.hexdigest()))
                last, sha = (conv, depth), hashlib.sha256()
            sha.update(piece.encode())
        yield _rows(done)
    if last:
        yield _rows([(*last, sha.hexdigest())])


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = {"conv_id": pa.int64(), "depth": pa.int64(), "ends_sha256": pa.string()}
    return pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in found], k) for i, (c, k) in enumerate(kinds.items())})


def ends(members: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of ``members`` (conv_id, depth, member): ids in pieces of neighbours, hashed as a stream."""
    ids = F.transform(F.array_sort(F.collect_list("member")), lambda x: x.cast("string"))
    pieces = members.groupBy("conv_id", "depth", F.expr(f"member div {BLOCK}").alias("block")).agg(F.array_join(ids, ",").alias("piece"))
    pieces = pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "block")
    return pieces.select("conv_id", "depth", "piece").mapInArrow(_hashed, "conv_id long, depth long, ends_sha256 string")


def suffix_sums(nodes: DataFrame, *columns: str) -> DataFrame:
    """``nodes`` (conv_id, depth, owner_n, ...) with each column summed over the depths of the chain from the node's on."""
    rows = nodes.withColumn("block", block_of(F.col("depth")))
    down = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.filter(F.col("owner_n") >= BLOCK).groupBy("conv_id", "block").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    whole = whole.select("conv_id", "block", *[F.sum(f"_{c}").over(below).alias(f"_{c}") for c in columns])
    out = rows.withColumns({c: F.sum(c).over(down) for c in columns}).join(whole, ["conv_id", "block"], "left")
    return out.withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in columns}).drop("block", *[f"_{c}" for c in columns])


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, n, pos from 1, digest, n_words) and ``convs`` (conv_id, n), one row each.

    conv_id: smallest member; depth; parent_conv_id: smallest member of the parent (root: null); n_convs: members;
    n_children; n_leaves: childless nodes of the subtree; saved_tokens: over the subtree, (members - 1) times the words of
    the last turn; ends_sha256: of the ids of the members that end here, ascending and comma-joined.

    A conversation without turns is a member of the root alone; without conversations there is no node. Equal conversations
    share all nodes, which belong to the smallest. Extra columns play no part.
    """
    spark = convs.sparkSession
    convs = materialise(convs.select("conv_id", "n"), "conversations")
    root, deepest, n_convs = convs.agg(F.min("conv_id"), F.max("n"), F.count("*")).first()
    if root is None:
        return spark.createDataFrame([], NODES)
    prefix = materialise(prefixes(turns), "prefixes")
    minima = prefix.groupBy("pos", "p", "q").agg(
        F.min("conv_id").alias("owner"), F.min_by("n", "conv_id").alias("owner_n"), F.count("*").alias("n_convs"), F.max("n_words").alias("n_words")
    )
    minima = materialise(minima, "prefix-minima")
    placed = first_owned(convs, prefix, minima, root, n_convs, deepest)

    is_root, owns = F.col("conv_id") == root, F.col("at") < F.col("n")
    hung = placed.filter(owns & ~is_root).select("conv_id", "n", "at", "above")
    chains = hung.unionByName(placed.filter(is_root).select("conv_id", "n", F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("above")))
    members = placed.select(F.when(owns | is_root, F.col("conv_id")).otherwise(F.col("above")).alias("conv_id"), F.col("n").alias("depth"), F.col("conv_id").alias("member"))

    saved = ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved")
    nodes = minima.select(F.col("owner").alias("conv_id"), F.col("pos").alias("depth"), "owner_n", "n_convs", saved)
    top = convs.filter(is_root).select("conv_id", F.lit(0).cast("long").alias("depth"), F.col("n").alias("owner_n"), F.lit(n_convs).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("saved"))
    nodes = nodes.unionByName(top)

    forks = hung.select(F.col("above").alias("conv_id"), F.col("at").alias("n")).distinct().withColumn("fork", F.lit(1))
    own = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"))
    own = chains.join(forks, ["conv_id", "n"], "left").join(own, "conv_id")
    own = materialise(own.select("conv_id", "above", "saved", F.when(F.col("fork").isNull(), 1).otherwise(0).cast("long").alias("leaves")), "chains")
    total = summed_up(own)

    branches = hung.join(total, "conv_id").groupBy(F.col("above").alias("conv_id"), F.col("at").alias("depth"))
    branches = branches.agg(F.count("*").alias("branches"), F.sum("saved").alias("saved_below"), F.sum("leaves").alias("leaves_below"))
    tops = hung.select("conv_id", (F.col("at") + 1).alias("depth"), "above")
    key = ["conv_id", "depth"]
    nodes = nodes.join(branches, key, "left").join(tops, key, "left").join(ends(members), key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    children = (zero("branches") + F.when(F.col("depth") < F.col("owner_n"), 1).otherwise(0)).cast("long")
    nodes = nodes.withColumn("n_children", children).withColumns(
        {"saved": F.col("saved") + zero("saved_below"), "leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long") + zero("leaves_below")}
    )
    nodes = suffix_sums(nodes, "saved", "leaves")
    parent = F.when(F.col("depth") > 0, F.coalesce("above", "conv_id"))
    return nodes.select(
        "conv_id",
        "depth",
        parent.alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """``prefix_trie`` of the spliced ``conversations`` (conv_id, turn, role, text)."""
    turns, convs = spliced(materialise(ordered_turns(conversations), "turns"))
    return prefix_trie(turns, convs)


#: The same rows from lists of whole sequences; crc32 bit by bit, as SQL has none.
SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, digest, n_words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos
  FROM (SELECT conv_id, turn, sha256(length(role)::varchar || ':' || role || text) AS digest,
               len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words FROM t) d
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS first,
         xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
             lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t) u
), turns AS (
  SELECT conv_id, digest, n_words, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth
  FROM (SELECT c.conv_id, 0 AS own, pos, digest, n_words FROM c JOIN o ON o.conv_id = c.first AND o.pos <= c.h
        UNION ALL SELECT c.conv_id, 1, pos, digest, n_words FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h) r
), prefixes AS (
  SELECT conv_id, depth, n_words, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), nodes AS (
  SELECT path, depth, min(conv_id) AS owner, count(*) AS n_convs, (count(*) - 1) * max(n_words) AS saved FROM prefixes GROUP BY path, depth
), parents AS (
  SELECT *, CASE WHEN depth > 0 THEN left(path, 64 * (depth - 1)) END AS up FROM nodes
), children AS (
  SELECT up AS path, count(*) AS n FROM parents WHERE up IS NOT NULL GROUP BY up
), below AS (
  SELECT a.path, sum(a.saved) AS saved_tokens, count(*) FILTER (WHERE a.leaf) AS n_leaves
  FROM (SELECT left(p.path, 64 * k) AS path, p.saved, ch.n IS NULL AS leaf
        FROM (SELECT path, saved, unnest(range(0, depth + 1)) AS k FROM parents) p LEFT JOIN children ch ON ch.path = p.path) a GROUP BY a.path
), ends AS (
  SELECT path, string_agg(conv_id::varchar, ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, arg_max(path, depth) AS path FROM prefixes GROUP BY conv_id) e GROUP BY path
)
SELECT n.owner AS conv_id, n.depth::bigint AS depth, u.owner AS parent_conv_id, n.n_convs::bigint AS n_convs,
       coalesce(ch.n, 0)::bigint AS n_children, b.n_leaves::bigint AS n_leaves, b.saved_tokens::bigint AS saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256
FROM parents n JOIN below b ON b.path = n.path LEFT JOIN parents u ON u.path = n.up
LEFT JOIN children ch ON ch.path = n.path LEFT JOIN ends e ON e.path = n.path
"""
