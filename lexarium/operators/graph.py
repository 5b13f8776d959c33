"""Graphs: mutual nearest neighbours of papers, communities, centrality, citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DomainError, check_count
from ..functions.names import normalize_title, title_from_uri
from ..functions.text import snippet
from ..shared import discard
from ..shared import keep as _keep
from ..shared import keep_by as _keep_by
from . import packed, similarity
from .lexical import BROADCAST_ROWS, DECIMALS, is_noise, stop_words, term_counts, tokens, with_df

TOP_K, MIN_SIMILARITY, REPRESENTATIVES, KEYWORDS = 8, 0.10, 3, 10


def paper_documents(chunks: DataFrame) -> DataFrame:
    """``paper_id, text``: the texts of each paper's chunks that aren't blank, in order, a line each."""
    rows = chunks.filter(F.trim("text") != "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy("paper_id").agg(joined.alias("text"))


def paper_vectors(docs: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """``paper_id, term, w``: TF-IDF of length 1 without English stop words."""
    stop = stop_words() if stop is None else stop
    counts = term_counts(docs, "paper_id", tokens(F.col("text")), stop)
    n = counts.select("paper_id").distinct().count()
    raw = with_df(counts, "paper_id").withColumn("w", F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0))
    return raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("paper_id")))).select("paper_id", "term", "df", "w")


def similarities(vectors: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """``a, b, similarity`` (a < b) of all pairs with enough similarity, by a threshold-bounded join."""
    return similarity.similar_pairs(vectors, min_similarity)


def mutual_edges(pairs: DataFrame, k: int = TOP_K) -> DataFrame:
    """``source, target, weight`` (source < target): pairs where each is among the other's first ``k``; ties by id."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    order = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    return _mutual(both.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k))


def _mutual(near: DataFrame) -> DataFrame:
    back = near.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return near.join(back, ["a", "b"], "left_semi").filter("a < b").select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("similarity").alias("weight"))


def similarity_edges(vectors: DataFrame, k: int = TOP_K, min_similarity: float = MIN_SIMILARITY, keep: Callable[[DataFrame], DataFrame] = _keep) -> DataFrame:
    """The mutual edges of papers by their vectors: each paper's first ``k`` are found without the list of all pairs."""
    return _mutual(keep(similarity.nearest(vectors, k, min_similarity, keep)))


def coded_papers(chunks: DataFrame, stop: list[str] | None = None) -> similarity.Coded:
    """The vectors of ``paper_vectors`` as a row of a few bytes a term for each paper."""
    stop = stop_words() if stop is None else stop
    rows = _keep(packed.counted(paper_documents(chunks), "paper_id", tokens(F.col("text")), stop), "counted")
    df = packed.frequencies(rows)
    out = similarity.coded(rows, "paper_id", df, rows.count())
    discard(rows, df)
    return out


def coded_edges(papers: similarity.Coded, some: DataFrame | None = None, k: int = TOP_K, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """As ``similarity_edges``; with ``some`` (paper_id) those that these are in, whose first ``k`` alone are asked for their own."""
    near = _keep(papers.nearest(k, min_similarity, some), "near")
    return _mutual(near) if some is None else _met(near, _keep(papers.nearest(k, min_similarity, near.select("b")), "near"))


def packed_papers(chunks: DataFrame, stop: list[str] | None = None) -> packed.Packed:
    """A row for each paper with the counts of its words but stop words, as ``paper_vectors`` weighs them, for ``edges_around``."""
    stop = stop_words() if stop is None else stop
    rows = _keep_by(packed.counted(paper_documents(chunks), "paper_id", tokens(F.col("text")), stop), "paper_id", "packed", dealt=True)
    df, n_docs = packed.frequencies(rows), rows.count()
    return packed.Packed(rows, packed.vector_norms(rows, "paper_id", df, n_docs), df, n_docs, 1.0)


def edges_around(papers: packed.Packed, some: DataFrame, k: int = TOP_K, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """The edges of ``similarity_edges`` that ``some`` (paper_id) are in: whose first ``k`` they are among is asked of their own first ``k`` alone."""
    near = _keep(packed.neighbors(papers, some, k, min_similarity, "paper_id"), "near")
    return _met(near, _keep(packed.neighbors(papers, near.select("b"), k, min_similarity, "paper_id"), "near"))


def _met(near: DataFrame, back: DataFrame) -> DataFrame:
    one, other = F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target")
    met = near.select("a", "b", "similarity").join(back.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi")
    return met.groupBy(one, other).agg(F.max("similarity").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """``paper_id, neighbor, weight``: each stored edge in both directions."""
    return edges.select(F.col("source").alias("paper_id"), F.col("target").alias("neighbor"), "weight").unionByName(edges.select(F.col("target").alias("paper_id"), F.col("source").alias("neighbor"), "weight"))


def neighbors(edges: DataFrame, paper_id: str) -> DataFrame:
    """``neighbor, weight`` of a paper, heaviest first, ties by id."""
    return both_ways(edges).filter(F.col("paper_id") == paper_id).orderBy(F.desc("weight"), "neighbor").select("neighbor", "weight")


def louvain(nodes: DataFrame, edges: DataFrame, keep: Callable[[DataFrame], DataFrame], resolution: float = 1.0, rounds: int = 100, levels: int = 20) -> DataFrame:
    """``paper_id, community`` (a member's id) by local moves that raise modularity, then on the graph of communities.

    In a round every node learns the gain of each neighbouring community; a node moves only if its draw for the round is
    the highest around it, so that neighbours don't move at once and no gain is counted twice. ``keep`` writes a table
    and reads it back. Rounds and levels end when nothing moves (each move raises modularity; the bounds only guard against
    rounding). Isolated nodes stay alone.

    Links lie by node and don't move in a round; what a round says of nodes and communities is broadcast to them while a level has
    BROADCAST_ROWS nodes or fewer, and joined after that. Tables of earlier rounds are removed. The number of the round is a column, so
    that all rounds are one plan, which is compiled once.
    """
    member = keep(nodes.select("paper_id", F.col("paper_id").alias("community")))
    links = _keep_by(both_ways(edges), "paper_id", "links")
    for _ in range(levels):
        total = links.agg(F.sum("weight")).first()[0]
        if not total:
            break
        at = keep(links.groupBy("paper_id").agg(F.sum("weight").alias("degree")).select("paper_id", "degree", F.col("paper_id").alias("community"), F.lit(0).alias("turn"), F.lit(True).alias("moved")))
        some = F.broadcast if at.count() <= BROADCAST_ROWS else lambda rows: rows
        others = links.filter("paper_id <> neighbor")
        moved_any = False
        for turn in range(rounds):
            sums = keep(at.groupBy("community").agg(F.sum("degree").alias("total")))
            to = others.join(some(at.select(F.col("paper_id").alias("neighbor"), "community")), "neighbor").groupBy("paper_id", "community").agg(F.sum("weight").alias("inside"))
            own = at.join(some(sums.select(F.col("community"), F.col("total").alias("own_total"))), "community").select("paper_id", "degree", "own_total", "turn", F.col("community").alias("own"))
            options = to.join(some(own), "paper_id").join(some(sums), "community")
            rest = F.col("total") - F.when(F.col("community") == F.col("own"), F.col("degree")).otherwise(0.0)
            options = options.withColumn("gain", F.round(F.col("inside") - resolution * F.col("degree") * rest / total, 12))
            apart = -resolution * F.col("degree") * (F.col("own_total") - F.col("degree")) / total
            best = options.groupBy("paper_id").agg(F.max(F.struct("gain", "community")).alias("best"), F.max(F.when(F.col("community") == F.col("own"), F.col("gain"))).alias("stay"), F.max(apart).alias("apart"), F.max("turn").alias("turn"))
            wish = keep(best.filter(F.col("best.gain") > F.coalesce("stay", "apart") + 1e-10).select("paper_id", F.col("best.community").alias("to"), F.xxhash64("paper_id", "turn").alias("draw")))
            beaten = others.join(some(wish), "paper_id").join(some(wish.select(F.col("paper_id").alias("neighbor"), F.col("draw").alias("other"))), "neighbor").filter("other > draw").select("paper_id").distinct()
            moves = wish.join(some(beaten), "paper_id", "left_anti").select("paper_id", "to")
            before = at
            at = keep(before.join(some(moves), "paper_id", "left").select("paper_id", "degree", F.coalesce("to", "community").alias("community"), (F.col("turn") + 1).alias("turn"), F.col("to").isNotNull().alias("moved")))
            discard(before, sums, wish)
            if at.filter("moved").isEmpty():
                break
            moved_any = True
        if not moved_any:
            break
        before, named = member, at.select(F.col("paper_id").alias("community"), F.col("community").alias("into"))
        member = keep(before.join(some(named), "community", "left").select("paper_id", F.coalesce("into", "community").alias("community")))
        a = at.select("paper_id", F.col("community").alias("from"))
        b = at.select(F.col("paper_id").alias("neighbor"), F.col("community").alias("to"))
        joined = links.join(some(a), "paper_id").join(some(b), "neighbor").groupBy("from", "to").agg(F.sum("weight").alias("weight"))
        links = _keep_by(joined.select(F.col("from").alias("paper_id"), F.col("to").alias("neighbor"), "weight"), "paper_id", "links")
        discard(before, at)
    return member


def numbered_communities(member: DataFrame) -> DataFrame:
    """``paper_id, community_id``: numbers from 0 by size, largest first, ties by first member."""
    sizes = member.groupBy("community").agg(F.count("*").alias("size"), F.min("paper_id").alias("first"))
    ids = sizes.withColumn("community_id", F.row_number().over(Window.orderBy(F.desc("size"), "first")) - 1)  # one row a community
    return member.join(ids.select("community", "community_id"), "community").select("paper_id", "community_id")


def community_members(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """``community_id, paper_id, centrality, is_representative``: weight of a member's edges inside; the first three represent."""
    own, other = communities, communities.select(F.col("paper_id").alias("neighbor"), F.col("community_id").alias("other"))
    inside = both_ways(edges).join(own, "paper_id").join(other, "neighbor").filter("community_id = other").groupBy("paper_id").agg(F.round(F.sum("weight"), DECIMALS).alias("centrality"))
    out = communities.join(inside, "paper_id", "left").withColumn("centrality", F.coalesce("centrality", F.lit(0.0)))
    order = Window.partitionBy("community_id").orderBy(F.desc("centrality"), "paper_id")
    return out.withColumn("is_representative", F.row_number().over(order) <= REPRESENTATIVES).select("community_id", "paper_id", "centrality", "is_representative")


def community_keywords(vectors: DataFrame, communities: DataFrame, n: int = KEYWORDS) -> DataFrame:
    """``community_id, keywords``: terms by summed weight over the members, noise left out."""
    return _first_terms(vectors.join(communities, "paper_id").groupBy("community_id", "term").agg(F.sum("w").alias("w")), n)


def keywords_of(chunks: DataFrame, communities: DataFrame, stop: list[str] | None = None, n: int = KEYWORDS) -> DataFrame:
    """``community_keywords`` from texts, without a row for each weight: a term's idf is one factor of its sum over a community."""
    papers = packed_papers(chunks, stop)
    rows, df, n_docs = papers.rows, papers.df, papers.n_docs
    whole = rows.join(papers.norms.hint("shuffle_hash"), "paper_id").join(communities.select("paper_id", "community_id").hint("shuffle_hash"), "paper_id")
    sums = packed.postings_of(whole, "community_id", "norm").groupBy("community_id", "term").agg(F.sum(F.col("tf") / F.col("norm")).alias("s"))
    idf = F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0
    return _first_terms(sums.filter(~is_noise(F.col("term"))).join(df, "term").select("community_id", "term", (F.col("s") * idf).alias("w")), n)


def _first_terms(sums: DataFrame, n: int) -> DataFrame:
    sums = sums.withColumn("w", F.round("w", DECIMALS)).filter((F.col("w") > 0) & ~is_noise(F.col("term")))
    first = sums.withColumn("r", F.row_number().over(Window.partitionBy("community_id").orderBy(F.desc("w"), "term"))).filter(F.col("r") <= n)
    return first.groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("keywords"))


def community_table(members: DataFrame, keywords: DataFrame, chunks: DataFrame) -> DataFrame:
    """``community_id, size, keywords, summary``: the summary is the first text of the most central member."""
    lead = chunks.filter(F.trim("text") != "").groupBy("paper_id").agg(F.min_by("text", "row_index").alias("text"))
    first = members.groupBy("community_id").agg(F.count("*").alias("size"), F.min_by("paper_id", F.struct(-F.col("centrality"), F.col("paper_id"))).alias("paper_id"))
    out = first.join(lead, "paper_id", "left").join(keywords, "community_id", "left")
    return out.select("community_id", "size", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), snippet(F.coalesce("text", F.lit(""))).alias("summary"))


def list_topics(communities: DataFrame, min_size: int = 2, limit: int = 20) -> DataFrame:
    """Communities of a size or more, largest first, with the total and whether the list was cut."""
    check_count("limit", limit)
    own = communities.filter(F.col("size") >= min_size)
    total = own.agg(F.count("*").alias("total"))
    return own.orderBy(F.desc("size"), "community_id").limit(limit).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > limit)


def citation_keys(papers: DataFrame, front: DataFrame) -> DataFrame:
    """``paper_id, method, pattern``: what a paper is cited by: its DOI or arXiv id if its own first pages have it, its title if long enough.

    ``papers``: ``paper_id, source_uri, identifiers``; ``front``: ``paper_id, text`` of the first pages outside the
    references. The first paper by id owns a pattern.
    """
    rows = papers.join(front, "paper_id", "left").withColumn("text", F.lower(F.coalesce("text", F.lit(""))))
    ids = rows.select("paper_id", "text", F.explode("identifiers").alias("method", "value")).withColumn("pattern", F.lower("value")).filter((F.col("pattern") != "") & F.col("text").contains(F.col("pattern")) & F.col("method").isin("doi", "arxiv")).select("paper_id", "method", "pattern")
    title = normalize_title(title_from_uri(F.col("source_uri")))
    titles = rows.select("paper_id", F.lit("title").alias("method"), title.alias("pattern")).filter((F.length("pattern") >= 30) & (F.size(F.split("pattern", " ")) >= 5))
    return ids.unionByName(titles).groupBy("method", "pattern").agg(F.min("paper_id").alias("paper_id")).select("paper_id", "method", "pattern")


#: Characters of the seed that a pattern is found by; shorter patterns are their own seeds.
SEED = 8
#: Patterns whose seeds are broadcast, at most, and characters of a run that short patterns are found by, at least.
FEW, SHORT = 20_000, 4


def _grams(text: Column, n: int) -> Column:
    """All distinct runs of ``n`` characters, in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def texts_with(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``id, pattern``: which texts (``id, text``) hold which patterns (``pattern``) as substrings, inside words too; none for an empty pattern.

    A pattern's seed is the run of SEED characters in it that the fewest patterns have; texts and patterns meet on equal
    runs, and what meets is compared whole. Exact for patterns of any form, without a pass for each of them.
    """
    patterns = _keep(patterns.select("pattern").distinct().filter("pattern <> ''"), "patterns")
    if patterns.limit(FEW + 1).count() <= FEW:
        return _texts_with_few(texts, patterns)
    short = patterns.filter(F.length("pattern") < SEED)
    lengths = [r.n for r in short.select(F.length("pattern").alias("n")).distinct().collect()]  # SEED - 1 numbers at most
    runs = patterns.filter(F.length("pattern") >= SEED).select("pattern", F.explode(_grams(F.col("pattern"), SEED)).alias("run"))
    often = runs.groupBy("run").agg(F.count("*").alias("n"))
    seeds = runs.join(often, "run").groupBy("pattern").agg(F.min_by("run", F.struct("n", "run")).alias("run"))
    seeds = seeds.unionByName(short.select("pattern", F.col("pattern").alias("run")))
    places = F.flatten(F.array(*[_grams(F.col("text"), n) for n in (SEED, *sorted(lengths))]))
    met = texts.select("id", F.explode(places).alias("run")).join(seeds, "run").select("id", "pattern").distinct()
    return met.join(texts, "id").filter(F.contains("text", "pattern")).select("id", "pattern").distinct()


def _texts_with_few(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``texts_with`` for FEW patterns at most: their seeds are broadcast and compared where the texts lie, so no text and no run of one moves.

    Of a text, runs of SEED characters that follow each other are enough for patterns of 2 * SEED - 1 characters: an occurrence holds one
    of them whole, which begins at one of the pattern's first SEED characters. The others are found by a run as long as the shortest of
    them (at least SHORT), those below SHORT by themselves.
    """
    size = F.length("pattern")
    long = patterns.filter(size >= 2 * SEED - 1)
    lengths = sorted(r.n for r in patterns.filter(size < 2 * SEED - 1).select(size.alias("n")).distinct().collect())  # 14 numbers at most
    places = [F.regexp_extract_all("text", F.lit(f"(?s).{{{SEED}}}"), F.lit(0))] if not long.isEmpty() else []
    seeds = long.select("pattern", F.explode(F.transform(F.sequence(F.lit(1), F.lit(SEED)), lambda i: F.substring(F.col("pattern"), i, F.lit(SEED)))).alias("run"))
    for n in [x for x in lengths if x < SHORT] + [x for x in lengths if x >= SHORT][:1]:
        own = patterns.filter(size == n if n < SHORT else size.between(n, 2 * SEED - 2))
        places.append(_grams(F.col("text"), n))
        runs = own.select("pattern", F.explode(_grams(F.col("pattern"), n)).alias("run"))
        often = runs.groupBy("run").agg(F.count("*").alias("n"))
        seeds = seeds.unionByName(runs.join(often, "run").groupBy("pattern").agg(F.min_by("run", F.struct("n", "run")).alias("run")))
    if not places:
        return texts.select("id", F.lit("").alias("pattern")).filter(F.lit(False))
    runs = F.array_distinct(F.flatten(F.array(*places)))
    met = texts.select("id", "text", F.explode(runs).alias("run")).join(F.broadcast(_keep(seeds.distinct(), "seeds")), "run")
    return met.filter(F.contains("text", "pattern")).select("id", "pattern").distinct()


def citation_edges(references: DataFrame, keys: DataFrame) -> DataFrame:
    """``source_paper_id, target_paper_id, method``: whose reference text (``paper_id, text``) holds which key.

    Identifiers match in the lower-cased text, titles in the normalised one, as substrings: inside words and longer
    identifiers too. DOI goes before arXiv before title; nothing cites itself.
    """
    keys = keys.select(F.col("paper_id").alias("target_paper_id"), "method", "pattern")
    title = F.col("method") == "title"
    found = None
    for text, own in ((F.lower("text"), keys.filter(~title)), (normalize_title(F.col("text")), keys.filter(title))):
        rows = texts_with(references.select(F.col("paper_id").alias("id"), text.alias("text")), own)
        rows = rows.join(own, "pattern").select(F.col("id").alias("source_paper_id"), "target_paper_id", "method")
        found = rows if found is None else found.unionByName(rows)
    rank = F.when(F.col("method") == "doi", 0).when(F.col("method") == "arxiv", 1).otherwise(2)
    found = found.filter("source_paper_id <> target_paper_id")
    return found.groupBy("source_paper_id", "target_paper_id").agg(F.min_by("method", rank).alias("method"))


def get_citations(edges: DataFrame, papers: DataFrame, paper_id: str, limit: int = 50) -> DataFrame:
    """``direction, paper_id, method, total``: cited and citing papers of one paper, each up to the limit, in order of id."""
    check_count("limit", limit)
    if papers.filter(F.col("paper_id") == paper_id).isEmpty():
        raise DomainError("not_found", f"no paper {paper_id}")
    out = edges.filter(F.col("source_paper_id") == paper_id).select(F.lit("cites").alias("direction"), F.col("target_paper_id").alias("paper_id"), "method")
    into = edges.filter(F.col("target_paper_id") == paper_id).select(F.lit("cited_by").alias("direction"), F.col("source_paper_id").alias("paper_id"), "method")
    w = Window.partitionBy("direction")
    rows = out.unionByName(into).withColumn("total", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy("paper_id")))
    return rows.filter(F.col("r") <= limit).select("direction", "paper_id", "method", "total")
