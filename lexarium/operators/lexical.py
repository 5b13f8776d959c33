"""Lexical scoring: postings, TF-IDF and BM25 weights, rank fusion, phrase search.

The index is relational: ``postings(term, chunk_id, tf, w_tfidf, w_bm25)``. Scoring a batch of queries is one join of
postings with the queries' terms; only the terms' postings are read.
"""

from __future__ import annotations

import math
from collections import deque
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DomainError, check_count
from ..shared import keep, keep_by
from . import similarity

K1, B, RRF_K = 1.5, 0.75, 60
TOKEN = r"[\p{L}\p{N}_]{2,}"
#: Decimals that scores are rounded to before ranks are taken: sums of doubles come in no fixed order.
DECIMALS = 9
SCORINGS = ("hybrid", "tfidf", "bm25")
#: Terms that are noise in keywords: fixed values.
NOISE = ["et", "al", "arxiv", "preprint", "doi", "isbn", "issn", "eds", "pp", "vol", "url", "http", "https", "www", "org", "com", "html", "pdf", "based"]


#: Ranges of terms, and of chunks, that the index tables are partitioned by: a query reads the ranges that it asks for only.
TERM_BUCKETS = 64
#: Asked keys that become literals of the plan; more are joined.
LITERALS = 2_000


def bucket(key: Column) -> Column:
    """The range of a term or a chunk."""
    return F.pmod(F.xxhash64(key), F.lit(TERM_BUCKETS)).cast("int")


def only(table: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of an index table whose ``key`` is among ``wanted`` (its one column).

    A few keys are collected and become literals, with their buckets where the table has these, so files and row groups are skipped;
    more than LITERALS meet the table in a join.
    """
    wanted = wanted.select(F.col(wanted.columns[0]).alias(key)).distinct()
    some = wanted.select(key, bucket(F.col(key)).alias("b")).limit(LITERALS + 1).collect()
    if len(some) > LITERALS:
        return table.join(wanted, key, "left_semi")
    rows = table.filter(F.col("bucket").isin(sorted({r.b for r in some}))) if "bucket" in table.columns else table
    return rows.filter(F.col(key).isin(sorted(r[key] for r in some)))


#: Tables that ``hold`` keeps at most; older ones are let go, and computed again if they are still read.
HELD = 8
_held: deque[DataFrame] = deque()


def hold(rows: DataFrame) -> DataFrame:
    """``rows`` persisted, as several steps of a search read them, until ``let_go`` or until HELD others came after."""
    _held.append(rows.persist())
    while len(_held) > HELD:
        _held.popleft().unpersist()
    return rows


def let_go() -> None:
    """Unpersist what searches hold: to be called when their results are collected."""
    while _held:
        _held.popleft().unpersist()


def settled(rows: DataFrame, most: int = LITERALS) -> DataFrame:
    """``rows`` as a local table if they are ``most`` at most, so that a small result isn't computed again by each reader."""
    some = rows.limit(most + 1).collect()
    return rows if len(some) > most else rows.sparkSession.createDataFrame(some, rows.schema)


def tokens(text: Column) -> Column:
    """Lower-case words of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def postings(chunks: DataFrame) -> DataFrame:
    """``term, chunk_id, tf``; counted in the map tasks first."""
    return chunks.select("chunk_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))


def term_stats(post: DataFrame) -> DataFrame:
    """``term, df``."""
    return post.groupBy("term").agg(F.count("*").alias("df"))


def chunk_lengths(chunks: DataFrame) -> DataFrame:
    """``chunk_id, n_tokens`` of every chunk that isn't blank, those without a token too."""
    return chunks.filter(F.trim("text") != "").select("chunk_id", F.size(tokens(F.col("text"))).cast("long").alias("n_tokens"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: number of chunks and their mean length (1 if that is 0)."""
    mean = F.coalesce(F.avg("n_tokens"), F.lit(0.0))
    return lengths.agg(F.count("*").alias("n_docs"), F.when(mean > 0, mean).otherwise(1.0).alias("avg_len"))


#: Terms whose document frequency is broadcast at most: those of the most postings.
FREQUENT = 100_000


def term_counts(rows: DataFrame, key: str, words: Column, stop: list[str] | None = None) -> DataFrame:
    """``key, term, tf`` of rows (``key``, text), written by ``key``: only texts move. A row without words, or with ``stop`` words, has an entry with a null term."""
    spark = rows.sparkSession
    dealt = rows.select(key, "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    each = dealt.select(key, F.explode_outer(words).alias("term"))
    if stop:
        each = each.withColumn("term", F.when(~F.col("term").isin(stop), F.col("term")))
    return keep_by(each.groupBy(key, "term").agg(F.count("term").alias("tf")), key, "counts", dealt=True)


def with_df(counts: DataFrame, key: str) -> DataFrame:
    """The terms of ``counts`` (``term_counts``) with ``df``, still dealt by ``key``.

    Frequent terms have most of the postings and are few, so their df is broadcast. The others of each key go to their term for
    it, and come back as one map for a key.
    """
    counts = counts.filter("term is not null")
    df = keep(counts.groupBy("term").agg(F.count("*").alias("df")), "df")
    often = F.col("df") > (df.agg(F.sum("df")).first()[0] or 0) / FREQUENT
    rows = counts.join(F.broadcast(df.filter(often)), "term", "left")
    rare = rows.filter("df is null").select(key, "term").join(df.filter(~often), "term")
    rare = rare.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("rare"))
    return rows.join(rare, key, "left").withColumn("df", F.coalesce("df", F.col("rare")[F.col("term")])).drop("rare")


def weight_parts(chunks: DataFrame) -> DataFrame:
    """``term, chunk_id, tf, df, n_tokens, norm, n_docs, avg_len``: what the weights of ``weighted`` are made of, dealt by chunk."""
    counts = term_counts(chunks.filter(F.trim("text") != ""), "chunk_id", tokens(F.col("text")))
    one = corpus_stats(counts.groupBy("chunk_id").agg(F.sum("tf").alias("n_tokens"))).first()
    rows = with_df(counts, "chunk_id").withColumns({"n_docs": F.lit(one.n_docs), "avg_len": F.lit(one.avg_len)})
    own = Window.partitionBy("chunk_id")
    raw = _raw()
    return rows.select("term", "chunk_id", "tf", "df", F.sum("tf").over(own).alias("n_tokens"), F.sqrt(F.sum(raw * raw).over(own)).alias("norm"), "n_docs", "avg_len")


def _raw() -> Column:
    return F.col("tf") * (F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0)


def with_weights(parts: DataFrame) -> DataFrame:
    """``weighted`` from ``weight_parts``."""
    bm25 = F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (K1 + 1.0) / (F.col("tf") + K1 * (1.0 - B + B * F.col("n_tokens") / F.col("avg_len")))
    return parts.select("term", "chunk_id", "tf", "df", "n_docs", (_raw() / F.col("norm")).alias("w_tfidf"), bm25.alias("w_bm25"))


def weighted(chunks: DataFrame) -> DataFrame:
    """``term, chunk_id, tf, w_tfidf, w_bm25``: rows of TF-IDF have length 1; BM25 has k1 1.5 and b 0.75."""
    return with_weights(weight_parts(chunks))


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term, qtf`` of queries (``query_id, query``)."""
    return queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


#: Rows of a counted table that may be broadcast.
BROADCAST_ROWS = 200_000


def small(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows``, to be broadcast if they are counted to be ``most`` at most. They should be cheap to count."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def is_packed(index) -> bool:
    """Whether an index has a row for each chunk (``packed.Packed``) instead of postings."""
    return not isinstance(index, DataFrame)


def scores(index: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, chunk_id, score_tfidf, score_bm25`` of all chunks with a term of the query.

    The terms of a query set are few, so they meet the index where it lies; where that is by chunk (``keep_by``), scores are
    added up there too. Repeated terms count each time. Of an index with a row for each chunk (``packed.Packed``) no hit is a row.
    """
    if is_packed(index):
        from . import packed

        return packed.scores(index, queries)
    asked = settled(query_terms(queries.filter("query_id is not null")))
    known = index.join(small(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.first(F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    by_term = settled(asked.join(known, "term"), 10 * LITERALS)
    norms = by_term.groupBy("query_id").agg(F.sqrt(F.sum(F.pow(F.col("qtf") * F.col("idf"), 2))).alias("norm"))
    hits = index.select("term", "chunk_id", "w_tfidf", "w_bm25").join(small(by_term.join(norms, "query_id")), "term")
    summed = hits.groupBy("query_id", "chunk_id").agg(F.sum(F.col("w_tfidf") * F.col("qtf") * F.col("idf")).alias("t"), F.sum(F.col("w_bm25") * F.col("qtf")).alias("b"), F.first("norm").alias("norm"))
    return summed.select("query_id", "chunk_id", F.round(F.col("t") / F.col("norm"), DECIMALS).alias("score_tfidf"), F.round("b", DECIMALS).alias("score_bm25"))


#: Rows between the marks of a list that is ranked, on average: a task's share. One row in SAMPLED is looked at for marks.
RANGE, SAMPLED, MOST_MARKS = 131_072, 16_384, 1_023


def spread_ranks(rows: DataFrame, keys: list[str], score: str, item: str = "chunk_id", held: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``rank``, highest score first, ties by item, without a list of a key's rows in one task.

    A sample gives marks that cut a list into ranges; rows are counted by range, the counts before a range are its
    offset, and rows are ranked within their range. A list shorter than RANGE is one range. ``held`` are the same rows
    where they can be read for marks and counts at less cost. Only the ranking itself moves rows.
    """
    held = rows if held is None else held
    order = F.struct((-F.col(score)).alias("s"), F.col(item).alias("c"))
    drawn = held.filter(F.pmod(F.xxhash64(item), F.lit(SAMPLED)) == 0).groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("drawn"))
    step = F.greatest(F.lit(max(1, RANGE // SAMPLED)), F.ceil(F.size("drawn") / MOST_MARKS)).cast("int")
    marks = small(settled(drawn.select(*keys, F.filter("drawn", lambda x, i: (i + 1) % step == 0).alias("marks")).filter(F.size("marks") > 0)), LITERALS)
    none = F.expr("filter(array(struct(cast(0 as double) as s, cast('' as string) as c)), x -> false)")
    in_range = lambda df: df.join(marks, keys, "left").withColumn("range", _slot(F.coalesce("marks", none.cast(dict(marks.dtypes)["marks"])), order)).drop("marks")
    counts = in_range(held.select(*keys, score, item)).groupBy(*keys, "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = counts.select(*keys, "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")).filter("offset > 0")
    within = F.row_number().over(Window.partitionBy(*keys, "range").orderBy(F.desc(score), item))
    placed = in_range(rows).withColumn("within", within).join(small(settled(offsets)), [*keys, "range"], "left")
    return placed.withColumn("rank", (F.coalesce("offset", F.lit(0)) + F.col("within")).cast("long")).drop("range", "within", "offset")


def ranked(scored: DataFrame, score: str, item: str = "chunk_id", limit: int | None = None) -> DataFrame:
    """``query_id, item, rank``: positive scores, highest first, ties by item. With a limit only the first are sorted, without one lists are ranked by ranges."""
    some = scored.filter(F.col(score) > 0)
    if limit is None:
        return spread_ranks(some.select("query_id", item, score), ["query_id"], score, item).select("query_id", item, "rank")
    order = Window.partitionBy("query_id").orderBy(F.desc(score), item)
    return some.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query_id", item, "rank")


#: The two scores of a scored row, each with the list that it is ranked in.
LISTS = ("score_tfidf", "score_bm25")


def fuse_rankings(rankings: list[DataFrame], item: str = "chunk_id") -> DataFrame:
    """Reciprocal-rank fusion: ``query_id, item, score``, the sum of 1 / (60 + rank) over the lists that have the item."""
    both = reduce(DataFrame.unionByName, rankings)
    return both.groupBy("query_id", item).agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 12).alias("score"))


def _slot(marks: Column, key: Column) -> Column:
    """How many of the sorted ``marks`` come before ``key``: a binary search in ten steps, so for up to 1,023 marks."""
    steps = F.array(*[F.lit(1 << b) for b in range(9, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(marks, at + s - 1) < key, at + s).otherwise(at))


def _reciprocal(ranks: list[Column]) -> Column:
    """The fused score of an item by its ranks, null where a list lacks it."""
    return F.round(reduce(lambda a, b: a + b, [F.coalesce(1.0 / (RRF_K + r), F.lit(0.0)) for r in ranks]), 12)


def hybrid(scored: DataFrame, k: int | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Fused scores. For the first ``k`` alone it ranks no whole list.

    An item outside the first 60 + 2k of both lists scores less than the k-th of either list alone does, so only the
    others are candidates. The candidates of a query lie in its lists as marks (an array each); every scored row finds the
    marks that it lies between, rows are counted there, and a candidate's rank is the running sum: no scored row moves but
    the candidates. ``wanted`` (``query_id, chunk_id``, MOST_MARKS of a query at most) are candidates given. Without either each
    scored row moves twice, to its range of either list. The scores are read more than once, so they should be held (``hold``).
    """
    scored = scored.select("query_id", "chunk_id", *LISTS)
    if k is None and wanted is None:
        rows = scored
        for name in LISTS:
            rows = spread_ranks(rows, ["query_id"], name, held=scored).withColumnRenamed("rank", f"rank_{name}")
        ranks = [F.when(F.col(n) > 0, F.col(f"rank_{n}")) for n in LISTS]
        return rows.filter("score_tfidf > 0 or score_bm25 > 0").select("query_id", "chunk_id", _reciprocal(ranks).alias("score"))
    key = lambda n: F.struct((-F.col(n)).alias("s"), F.col("chunk_id").alias("c"))
    if wanted is not None:
        heads = scored.join(small(wanted), ["query_id", "chunk_id"], "left_semi")
    else:
        order = [Window.partitionBy("query_id").orderBy(F.desc(n), "chunk_id") for n in LISTS]
        heads = [scored.filter(F.col(n) > 0).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= RRF_K + 2 * k).drop("r") for n, w in zip(LISTS, order, strict=True)]
        heads = heads[0].unionByName(heads[1]).distinct()
    marks = heads.groupBy("query_id").agg(*[F.array_sort(F.collect_list(F.when(F.col(n) > 0, key(n)))).alias(f"marks_{n}") for n in LISTS])
    marks = small(settled(marks), LITERALS)
    places = F.array(*[F.when(F.col(n) > 0, F.struct(F.lit(i).alias("list"), _slot(F.col(f"marks_{n}"), key(n)).alias("slot"))) for i, n in enumerate(LISTS)])
    placed = scored.join(marks.select("query_id", *[f"marks_{n}" for n in LISTS]), "query_id").select("query_id", F.explode(F.array_compact(places)).alias("p")).select("query_id", "p.*")
    counts = placed.groupBy("query_id", "list", "slot").agg(F.count("*").alias("n"))  # as many rows as marks, whatever is scored
    ranks = counts.withColumn("rank", F.sum("n").over(Window.partitionBy("query_id", "list").orderBy("slot")))
    items = F.get(F.when(F.col("list") == 0, F.col(f"marks_{LISTS[0]}")).otherwise(F.col(f"marks_{LISTS[1]}")), F.col("slot"))["c"]
    return fuse_rankings([ranks.join(marks, "query_id").select("query_id", items.alias("chunk_id"), "rank").filter("chunk_id is not null")])


def final_scores(scored: DataFrame, scoring: str = "hybrid", k: int | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """``query_id, chunk_id, score`` by a scoring; positive ones only, and only ``wanted`` (query_id, chunk_id) if these are given."""
    if scoring not in SCORINGS:
        raise DomainError("invalid_input", f"unknown scoring {scoring!r}", allowed=SCORINGS)
    if wanted is not None:
        most = wanted.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if scoring == "hybrid" and most <= MOST_MARKS:
            return hybrid(scored, wanted=wanted)
        return final_scores(scored, scoring).join(small(wanted), ["query_id", "chunk_id"], "left_semi")
    if scoring == "hybrid":
        return hybrid(scored, k)
    return scored.select("query_id", "chunk_id", F.col(f"score_{scoring}").alias("score")).filter("score > 0")


def search(index: DataFrame, queries: DataFrame, k: int = 5, scoring: str = "hybrid", chunks: DataFrame | None = None, paper_filter: DataFrame | None = None, scored: DataFrame | None = None, final: DataFrame | None = None) -> DataFrame:
    """The first ``k`` chunks of each query: ``query_id, rank, chunk_id, score``.

    ``paper_filter`` (``query_id, paper_id``, or ``paper_id`` for all queries) is applied after scores are made from the whole corpus, as ranks are the
    corpus's. ``scored`` are the queries' scores where they are known already, ``final`` the final ones. With ``chunks`` that have ``document_kind``, references go behind full texts among the chosen.
    """
    check_count("k", k)
    if final is None and scored is None and is_packed(index):
        final, paper_filter = _packed_final(index, queries, k, scoring, chunks, paper_filter)
    elif final is None:
        final = final_scores(hold(scores(index, queries)) if scored is None else scored, scoring, None if paper_filter is not None else k)
    out = final
    if paper_filter is not None:
        out = out.join(chunks.select("chunk_id", "paper_id"), "chunk_id").join(paper_filter, paper_filter.columns, "left_semi").drop("paper_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    out = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if chunks is not None and "document_kind" in chunks.columns:
        out = settled(out, 10 * LITERALS)
        kinds = chunks.select("chunk_id", "document_kind").join(small(out.select("chunk_id").distinct()), "chunk_id", "left_semi")
        out = demote_references(out.join(kinds, "chunk_id", "left")).drop("document_kind")
    return out.select("query_id", "rank", "chunk_id", "score")


def _packed_final(index, queries: DataFrame, k: int, scoring: str, chunks: DataFrame | None, paper_filter: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Final scores that have the first ``k`` of each query, and the filter that is left to apply."""
    from . import packed

    if scoring not in SCORINGS:
        raise DomainError("invalid_input", f"unknown scoring {scoring!r}", allowed=SCORINGS)
    if paper_filter is None:
        return packed.first(index, queries, k, scoring), None
    if scoring == "hybrid" and paper_filter.columns == ["paper_id"]:
        own = chunks.select("chunk_id", "paper_id").join(paper_filter.distinct(), "paper_id", "left_semi").select("chunk_id", F.lit("in").alias("own"))
        return packed.first_of_groups(index, queries, own, k).drop("own"), None
    if scoring == "hybrid":
        return packed.fused(index, queries).drop("own"), paper_filter
    return final_scores(packed.scores(index, queries), scoring), paper_filter


def demote_references(hits: DataFrame) -> DataFrame:
    """The same hits, full texts first, otherwise in their order."""
    order = Window.partitionBy("query_id").orderBy((F.coalesce("document_kind", F.lit("full")) == "reference").cast("int"), "rank")
    return hits.withColumn("rank", F.row_number().over(order))


def scores_by_paper(index: DataFrame, queries: DataFrame, chunks: DataFrame, scoring: str = "hybrid") -> DataFrame:
    """``query_id, paper_id, scores``: all positive scores of each paper's chunks, highest first."""
    if scoring == "hybrid" and is_packed(index):
        from . import packed

        return packed.fused_by_own(index, queries, chunks.select("chunk_id", F.col("paper_id").alias("own"))).withColumnRenamed("own", "paper_id")
    out = final_scores(hold(scores(index, queries)), scoring).join(chunks.select("chunk_id", "paper_id"), "chunk_id")
    return out.groupBy("query_id", "paper_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"))


def forward(weights: DataFrame) -> DataFrame:
    """``chunk_id, vector`` (array of term, w): the TF-IDF vector of each chunk, as a snapshot stores it beside the postings."""
    return weights.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("term", F.col("w_tfidf").alias("w")))).alias("vector"))


#: Seeds that go to the rows of an index in blocks, at most.
MANY_SEEDS = 4_096


def chunk_neighbors(index: DataFrame, seeds: DataFrame, k: int = 5, vectors: DataFrame | None = None) -> DataFrame:
    """``seed_id, rank, chunk_id, score``: the k nearest chunks by cosine of each seed (``seed_id``), without itself.

    With ``vectors`` (``forward``) the vectors of a few seeds are read first, by their ids, and then the postings of their terms only.
    Otherwise the seeds' vectors pass by all vectors (``similarity.nearest_of``), without a row for each pair; over an index with a
    row for each chunk they go to the rows (``packed.neighbors``), more than MANY_SEEDS pass by them as a few bytes a term (``similarity.coded``).
    """
    check_count("k", k)
    seeds = seeds.select("seed_id").distinct()
    if is_packed(index):
        from . import packed

        if seeds.limit(MANY_SEEDS + 1).count() > MANY_SEEDS:
            vectors = similarity.coded(index.rows, "chunk_id", index.df, index.n_docs)
            near = vectors.nearest(k, 0.5 * 10**-similarity.DECIMALS, seeds)
        else:
            near = packed.neighbors(index, seeds, k)
        return near.select(F.col("a").alias("seed_id"), F.col("r").alias("rank"), F.col("b").alias("chunk_id"), F.col("similarity").alias("score"))
    if vectors is None or seeds.limit(LITERALS + 1).count() > LITERALS:
        rows = keep(similarity.as_rows(index, "chunk_id", "w_tfidf"), "vectors")
        probes = rows.join(seeds.withColumnRenamed("seed_id", "paper_id"), "paper_id", "left_semi")
        near = similarity.nearest_of(rows, probes, k, 0.5 * 10**-similarity.DECIMALS, rows.count(), seeds.count())
        return near.select(F.col("a").alias("seed_id"), F.col("r").alias("rank"), F.col("b").alias("chunk_id"), F.col("similarity").alias("score"))
    own = only(vectors, "chunk_id", seeds).select(F.col("chunk_id").alias("seed_id"), F.explode("vector").alias("v")).select("seed_id", "v.term", "v.w")
    index = only(index, "term", own.select("term"))
    pairs = index.join(own, "term").filter("chunk_id <> seed_id").groupBy("seed_id", "chunk_id").agg(F.round(F.sum(F.col("w") * F.col("w_tfidf")), DECIMALS).alias("score")).filter("score > 0")
    order = Window.partitionBy("seed_id").orderBy(F.desc("score"), "chunk_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("seed_id", "rank", "chunk_id", "score")


def is_noise(term: Column) -> Column:
    """Terms that keywords never show: citation words, numbers, undecoded glyph names."""
    return term.isin(NOISE) | term.rlike(r"^[0-9]+$") | term.rlike("(?i)^uni[0-9a-f]{8}$")


def stop_words() -> list[str]:
    """English stop words as Spark ML lists them."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")


def keyword_table(docs: DataFrame, top_k: int = 6, stop: list[str] | None = None) -> DataFrame:
    """``doc_id, keywords``: each document's first terms by TF-IDF (three or more ASCII letters, no stop or noise words)."""
    stop = stop_words() if stop is None else stop
    counts = term_counts(docs, "doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)), stop)
    raw = with_df(counts, "doc_id").withColumn("w", F.col("tf") * (F.log((1.0 + docs.count()) / (1.0 + F.col("df"))) + 1.0))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    w = raw.withColumn("w", F.round(F.col("w") / norm, DECIMALS)).filter(~is_noise(F.col("term")))
    first = w.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("w"), "term"))).filter(F.col("rank") <= top_k)
    named = first.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("keywords"))
    return docs.select("doc_id").join(named, "doc_id", "left").select("doc_id", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))


#: Chunks of a block of the positional index, on average, and words of a stretch that places are counted from.
BLOCK_CHUNKS, STRETCH = 1_024, 256


def positions(chunks: DataFrame, blocks: int | None = None) -> DataFrame:
    """``term, block, n, places``: the positional index, a row for each term and block of chunks.

    ``places`` has (chunk_id, base, steps) in order: the places of the term in a stretch of STRETCH words of a chunk, as
    distances from the stretch's first word; ``n`` counts them. Terms are folded (case and marks) words of one or more
    letters or digits. Chunks are dealt to blocks by hash, about BLOCK_CHUNKS to each, so no row grows with the corpus.
    """
    blocks = max(1, -(-chunks.count() // BLOCK_CHUNKS)) if blocks is None else blocks
    dealt = chunks.select("chunk_id", "text").repartition("chunk_id")  # texts move, not their words
    words = dealt.select("chunk_id", F.posexplode(folded_tokens(F.col("text"))).alias("pos", "term")).withColumn("step", F.col("pos") % STRETCH)
    own = words.groupBy("chunk_id", "term", (F.col("pos") - F.col("step")).alias("base")).agg(F.sort_array(F.collect_list("step")).alias("steps"))
    own = own.withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int"))
    out = own.groupBy("term", "block").agg(F.sum(F.size("steps")).alias("n"), F.sort_array(F.collect_list(F.struct("chunk_id", "base", "steps"))).alias("places"))
    return out.select("term", "block", "n", "places")


def folded_tokens(text: Column) -> Column:
    from ..functions.names import _FROM, _TO

    plain = F.regexp_replace(F.translate(F.lower(F.translate(text, "äöüÄÖÜ", "aouAOU")), _FROM, _TO), r"\p{M}+", "")
    return F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


#: Parameters of the relevance of phrase hits, words of a snippet, and words of it before the hit: fixed values.
PHRASE_K1, PHRASE_B, SNIPPET_WORDS, SNIPPET_LEAD = 1.2, 0.75, 16, 8


def folded_words(pos: DataFrame, text: str) -> list[str]:
    """The words of a query, folded and cut as those of the positional index are."""
    return list(pos.sparkSession.range(1).select(folded_tokens(F.lit(text)).alias("w")).first().w)


def _starts(pos: DataFrame, words: list[str], prefix: bool = False) -> DataFrame:
    """``chunk_id, starts``: where the words are in sequence; with ``prefix`` the last may go on.

    The index is read once for all words. Blocks that lack one are passed over whole; in each chunk of the others the
    places of a word, shifted to where the phrase would begin, are one array, and the arrays are intersected.
    """
    exact = words[:-1] if prefix else words
    parts = [F.col("term") == w for w in dict.fromkeys(exact)] + ([F.col("term").startswith(words[-1])] if prefix else [])
    part_of = [list(dict.fromkeys(exact)).index(w) for w in exact] + ([len(parts) - 1] if prefix else [])
    rows = pos.filter(reduce(lambda a, b: a | b, parts))
    if "bucket" in pos.columns and not prefix:
        rows = rows.filter(F.col("bucket").isin([r.b for r in pos.sparkSession.createDataFrame([(w,) for w in exact], "w string").select(bucket(F.col("w")).alias("b")).collect()]))
    role = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(parts)])))
    blocks = rows.select("block", role.alias("r"), "places").groupBy("block").agg(F.collect_list(F.struct("r", "places")).alias("own"))
    full = blocks.filter(F.size(F.array_distinct(F.transform("own", lambda x: x["r"]))) == len(parts))
    each = full.select("block", F.explode("own").alias("x")).select("block", "x.r", F.explode("x.places").alias("x"))
    each = each.select("block", "r", "x.chunk_id", F.transform("x.steps", lambda s: F.col("x.base") + s).alias("p"))
    # a chunk lies in one block, so its rows are together already
    own = [F.flatten(F.collect_list(F.when(F.col("r") == i, F.col("p")))).alias(f"p{i}") for i in range(len(parts))]
    found = each.groupBy("block", "chunk_id").agg(*own)
    shifted = [F.transform(f"p{r}", (lambda k: lambda x: x - k)(i)) for i, r in enumerate(part_of)]
    common = F.array_distinct(reduce(F.array_intersect, shifted))
    return found.select("chunk_id", common.alias("starts")).filter(F.size("starts") > 0)


def phrase_hits(pos: DataFrame, phrase: str, prefix: bool = False) -> DataFrame:
    """``chunk_id, n_hits, first, width``: chunks with the words of a phrase in sequence, whatever its case, marks and punctuation.

    With ``prefix`` the last word may go on (three letters at least).
    """
    words = folded_words(pos, phrase)
    if not words:
        raise DomainError("invalid_input", "no word in the phrase")
    if prefix and len(words[-1]) < 3:
        raise DomainError("invalid_input", "a prefix has three letters at least")
    found = _starts(pos, words, prefix).select("chunk_id", F.size("starts").cast("long").alias("n_hits"), F.array_min("starts").alias("first"))
    return found.withColumn("width", F.lit(len(words)))


def near_hits(pos: DataFrame, terms: list[str], distance: int = 10) -> DataFrame:
    """``chunk_id, n_hits, first, width``: chunks where all terms (words or phrases) are found near one another.

    They are near where a term starts at most ``distance`` words after the end of each of the others. For each start of
    any term, the last start of every term up to there is a running maximum; the window holds one chunk.
    """
    phrases = [folded_words(pos, t) for t in terms]
    if len({tuple(p) for p in phrases}) < 2 or not all(phrases) or not 0 <= distance <= 50:
        raise DomainError("invalid_input", "two different terms and a distance from 0 to 50")
    rows = reduce(DataFrame.unionByName, [_starts(pos, p).select("chunk_id", F.explode("starts").alias("start"), F.lit(i).alias("i")) for i, p in enumerate(phrases)])
    upto = Window.partitionBy("chunk_id").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    for i in range(len(phrases)):
        rows = rows.withColumn(f"p{i}", F.max(F.when(F.col("i") == i, F.col("start"))).over(upto))
    close = reduce(lambda a, b: a & b, [F.coalesce(F.col("start") - F.col(f"p{i}") - len(p) <= distance, F.lit(False)) for i, p in enumerate(phrases)])
    found = rows.filter(close).groupBy("chunk_id").agg(F.count("*").alias("n_hits"), F.min(F.least(*[F.col(f"p{i}") for i in range(len(phrases))])).alias("first"))
    return found.withColumn("width", F.lit(1))


def word_counts(chunks: DataFrame) -> DataFrame:
    """``chunk_id, n_words``: the words of each chunk, folded and cut as those of the positional index are."""
    return chunks.select("chunk_id", F.size(folded_tokens(F.col("text"))).alias("n_words"))


def text_matches(pos: DataFrame, hits: DataFrame, chunks: DataFrame, paper_ids: DataFrame | None = None, limit: int = 20, lengths: DataFrame | None = None) -> DataFrame:
    """``rank, chunk_id, paper_id, n_hits, score, total, snippet`` of the first ``limit`` of phrase, prefix or near hits.

    Order is by relevance (BM25 of the hits in a chunk, over all chunks), ties by chunk. ``paper_ids`` (``paper_id``) filters
    what is listed and counted in ``total``. The snippet has 16 words with the first hit between marks. ``lengths``
    (``word_counts``) is what a snapshot has; without it words are counted in the texts of the matches. Texts are read
    for what is listed alone; the corpus's size is read off the index.
    """
    check_count("limit", limit)
    hits = hold(hits)
    n_found = hits.count()
    if lengths is None:
        n, words = chunks.count(), pos.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        lengths = word_counts(chunks.join(hits.select("chunk_id"), "chunk_id", "left_semi"))
    else:
        n, words = lengths.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    rows = hits.join(chunks.select("chunk_id", "paper_id"), "chunk_id")
    if paper_ids is not None:
        rows = rows.join(paper_ids.select("paper_id").distinct(), "paper_id", "left_semi")
    total = n_found if paper_ids is None else rows.count()
    idf = max(math.log((n - n_found + 0.5) / (n_found + 0.5)), 1e-6)
    f = F.col("n_hits")
    score = F.lit(idf) * f * (PHRASE_K1 + 1) / (f + PHRASE_K1 * (1 - PHRASE_B + PHRASE_B * F.col("n_words") * n / max(words, 1)))
    first = rows.join(lengths, "chunk_id").withColumn("score", F.round(score, DECIMALS)).orderBy(F.desc("score"), "chunk_id").limit(limit)
    first = first.select("chunk_id", "paper_id", "n_hits", "first", "width", "score")
    some = first.collect()  # at most ``limit`` rows
    first = chunks.filter(F.col("chunk_id").isin([r.chunk_id for r in some])).select("chunk_id", "text").join(F.broadcast(hits.sparkSession.createDataFrame(some, first.schema)), "chunk_id")
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id"))
    shown = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}\p{M}]+"), F.lit(0))
    start = F.greatest(F.col("first") - SNIPPET_LEAD, F.lit(0))
    marked = F.transform(shown, lambda w, i: F.when((i >= F.col("first")) & (i < F.col("first") + F.col("width")), F.concat(F.lit("«"), w, F.lit("»"))).otherwise(w))
    snippet = F.array_join(F.slice(marked, start + 1, F.lit(SNIPPET_WORDS)), " ")
    return first.select(rank.alias("rank"), "chunk_id", "paper_id", "n_hits", "score", F.lit(total).cast("long").alias("total"), snippet.alias("snippet"))
