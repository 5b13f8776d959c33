"""Search modes over an index: direct, neighbourhood, communities, communities then direct; evidence and references."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DomainError, check_count
from ..functions.names import citation_key, format_in_text, format_reference, missing_fields, preferred_url
from ..functions.text import page_label, snippet
from ..shared import keep
from . import lexical, packed
from .graph import both_ways, edges_around

MEMBER_TOP = 5


@dataclass
class Index:
    """The tables of a snapshot. ``chunks``: chunk_id, paper_id, row_index, text, page_number, page_end, section_title, document_kind."""

    chunks: DataFrame
    weights: DataFrame
    edges: DataFrame | None = None
    members: DataFrame | None = None
    communities: DataFrame | None = None
    papers: DataFrame | None = None
    positions: DataFrame | None = None
    citations: DataFrame | None = None
    metadata: DataFrame | None = None
    authors: DataFrame | None = None
    forward: DataFrame | None = None
    lengths: DataFrame | None = None
    #: Counted papers (``graph.packed_papers``), for the edges of a few papers where there are no ``edges``.
    counted: packed.Packed | None = None

    def need(self, name: str) -> DataFrame:
        table = getattr(self, name)
        if table is None:
            raise DomainError("constraint_violation", f"the snapshot has no {name}")
        return table

    def edges_of(self, papers: DataFrame) -> DataFrame:
        """The edges that ``papers`` (paper_id) are in, and maybe others."""
        return self.need("edges") if self.edges is not None or self.counted is None else edges_around(self.counted, papers)


def cited(index: Index, hits: DataFrame) -> DataFrame:
    """Hits with their provenance: paper, pages, section and a snippet; texts are fetched for the hits alone.

    Where the snapshot has merged metadata, also the citation key and the identifiers that aren't empty.
    """
    hits = lexical.settled(hits, 10 * lexical.LITERALS)
    own = ["paper_id", "page_number", "page_end", "section_title", "text"]
    rows = index.chunks.select("chunk_id", *own).join(lexical.small(hits), "chunk_id").select("chunk_id", *[c for c in hits.columns if c != "chunk_id"], *own)
    rows = rows.withColumns({"pages": page_label(F.col("page_number"), F.col("page_end")), "snippet": snippet(F.col("text"))}).drop("text", "page_number", "page_end")
    if index.metadata is None:
        return rows
    ids = F.map_filter(F.create_map(F.lit("doi"), F.col("doi"), F.lit("arxiv"), F.col("arxiv_id"), F.lit("url"), F.col("url")), lambda k, v: F.coalesce(v, F.lit("")) != "")
    data = index.metadata.select("paper_id", citation_key(F.col("paper_id"), F.coalesce("title", F.lit("")), F.coalesce("authors", F.array().cast("array<string>")), F.coalesce("year", F.lit(0))).alias("citation_key"), ids.alias("identifiers"))
    return rows.join(data, "paper_id", "left")


def search_basic(index: Index, queries: DataFrame, k: int = 5, scoring: str = "hybrid") -> DataFrame:
    return lexical.search(asked_postings(index, queries), queries, k, scoring, index.chunks)


def asked_postings(index: Index, queries: DataFrame) -> DataFrame:
    """The postings of the queries' terms, where the index is a snapshot's, partitioned by terms."""
    return lexical.only(index.weights, "term", lexical.query_terms(queries).select("term")) if not lexical.is_packed(index.weights) and "bucket" in index.weights.columns else index.weights


def search_local(index: Index, queries: DataFrame, k: int = 5, seeds: int = 5, fan_out: int = 5, scoring: str = "hybrid", scored: DataFrame | None = None, final: DataFrame | None = None, asked: list[packed.Asked] | None = None) -> dict[str, DataFrame]:
    """``seeds``, ``neighborhood`` and ``fan_out`` of each query.

    The neighbourhood fuses the ``k`` nearest chunks of each seed and leaves the seeds out afterwards; the fan-out takes
    the heaviest edges of the first seed's paper, and of each neighbour the best chunk for the query. ``scored`` and
    ``final`` are the queries' scores where they are known already; with ``asked`` (``packed.ask``) these have the first alone, the others are asked for.
    """
    for name, value in (("k", k), ("seeds", seeds)):
        check_count(name, value)
    if fan_out:  # 0 leaves the fan-out out
        check_count("fan_out", fan_out)
    if lexical.is_packed(index.weights) and scored is None and (final is None or asked is not None):
        asked = packed.ask(index.weights, queries) if asked is None else asked
        final = packed.first(index.weights, queries, seeds, scoring, asked) if final is None else final
    elif scored is None:
        scored = lexical.hold(lexical.scores(asked_postings(index, queries), queries))
    hits = lexical.settled(lexical.search(index.weights, queries, seeds, scoring, index.chunks, scored=scored, final=final))
    near = lexical.chunk_neighbors(index.weights, hits.select(F.col("chunk_id").alias("seed_id")), k, index.forward)
    lists = hits.select("query_id", F.col("chunk_id").alias("seed_id")).join(near, "seed_id").select("query_id", "chunk_id", "rank")
    fused = lexical.fuse_rankings([lists]).join(hits, ["query_id", "chunk_id"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    fused = fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    first = hits.filter("rank = 1").join(index.chunks.select("chunk_id", "paper_id"), "chunk_id").select("query_id", "paper_id")
    by_weight = Window.partitionBy("query_id").orderBy(F.desc("weight"), "neighbor")
    around = first.join(both_ways(index.edges_of(first.select("paper_id"))), "paper_id").withColumn("r", F.row_number().over(by_weight)).filter(F.col("r") <= fan_out).select("query_id", "neighbor", "weight")
    around = lexical.settled(around)
    own = index.chunks.select("chunk_id", F.col("paper_id").alias("neighbor")).join(lexical.small(around), "neighbor")
    wanted = lexical.settled(own.select("query_id", "chunk_id", "neighbor", "weight").distinct())
    pairs = wanted.select("query_id", "chunk_id").distinct()
    if asked is not None:
        chunk_scores = packed.wanted(asked, pairs, scoring)
    else:
        chunk_scores = lexical.final_scores(scored, scoring, wanted=pairs) if final is None else final.join(lexical.small(pairs), ["query_id", "chunk_id"], "left_semi")
    best = chunk_scores.join(lexical.small(wanted), ["query_id", "chunk_id"]).groupBy("query_id", "neighbor", "weight").agg(F.min_by(F.struct("chunk_id", "score"), F.struct(-F.col("score"), F.col("chunk_id"))).alias("c"))
    return {"seeds": hits, "neighborhood": fused.select("query_id", "rank", "chunk_id", "score"), "fan_out": best.select("query_id", "neighbor", "weight", "c.chunk_id", "c.score")}


def rank_communities(index: Index, queries: DataFrame, n: int = 5, final: DataFrame | None = None) -> DataFrame:
    """``query_id, rank, community_id, score``: the mean of the best five chunk scores among a community's members."""
    check_count("n", n)
    if final is None and lexical.is_packed(index.weights):
        best = first_of_communities(index, queries, MEMBER_TOP)
    else:
        final = lexical.final_scores(lexical.hold(lexical.scores(asked_postings(index, queries), queries))) if final is None else final
        best = final.join(index.chunks.select("chunk_id", "paper_id"), "chunk_id").join(index.need("members").select("paper_id", "community_id"), "paper_id")
    return _ranked_communities(best, n)


def communities_of_chunks(index: Index) -> DataFrame:
    """``chunk_id, own``: the community of each chunk's paper; a paper is in one community."""
    return index.chunks.select("chunk_id", "paper_id").join(index.need("members").select("paper_id", "community_id"), "paper_id").select("chunk_id", F.col("community_id").alias("own"))


def first_of_communities(index: Index, queries: DataFrame, k: int, asked: list[packed.Asked] | None = None) -> DataFrame:
    """``query_id, community_id, chunk_id, score``: the first ``k`` chunks of each community for each query. ``asked`` (``packed.ask`` with ``communities_of_chunks``) is what has been asked for already."""
    kind = index.need("members").schema["community_id"].dataType
    return packed.first_of_groups(index.weights, queries, communities_of_chunks(index), k, asked).select("query_id", F.col("own").cast(kind).alias("community_id"), "chunk_id", "score")


def _ranked_communities(best: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("query_id", "community_id").orderBy(F.desc("score"), "chunk_id")
    top = best.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= MEMBER_TOP).groupBy("query_id", "community_id").agg(F.round(F.avg("score"), 12).alias("score")).filter("score > 0")
    out = Window.partitionBy("query_id").orderBy(F.desc("score"), "community_id")
    return top.withColumn("rank", F.row_number().over(out)).filter(F.col("rank") <= n).select("query_id", "rank", "community_id", "score")


def community_matches(index: Index, chosen: DataFrame) -> DataFrame:
    """``chosen`` communities with their keywords, size and summary, and ``representatives`` (paper_id, title, citation_key), most central first."""
    own = index.need("members").filter("is_representative").join(chosen.select("community_id").distinct(), "community_id")
    if index.metadata is None:
        own = own.withColumns({"title": F.lit(""), "citation_key": F.col("paper_id")})
    else:
        title = F.coalesce("title", F.lit(""))
        key = citation_key(F.col("paper_id"), title, F.coalesce("authors", F.array().cast("array<string>")), F.coalesce("year", F.lit(0)))
        own = own.join(index.metadata.select("paper_id", title.alias("title"), key.alias("citation_key")), "paper_id", "left")
    order = F.array_sort(F.collect_list(F.struct((-F.col("centrality")).alias("c"), "paper_id", "title", "citation_key")))
    own = own.groupBy("community_id").agg(F.transform(order, lambda x: F.struct(x["paper_id"].alias("paper_id"), x["title"].alias("title"), x["citation_key"].alias("citation_key"))).alias("representatives"))
    return chosen.join(index.need("communities"), "community_id").join(own, "community_id", "left")


def search_global(index: Index, queries: DataFrame, n: int = 5) -> DataFrame:
    """The communities with what they are known by (``community_matches``)."""
    return community_matches(index, rank_communities(index, queries, n))


def search_drift(index: Index, queries: DataFrame, k: int = 6, communities: int = 5, scoring: str = "hybrid") -> DataFrame:
    """``query_id, rank, chunk_id, score, fallback``: the best chunks within the best communities; of all where those have none."""
    return search_drift_parts(index, queries, k, communities, scoring)["hits"]


def search_drift_parts(index: Index, queries: DataFrame, k: int = 6, communities: int = 5, scoring: str = "hybrid", scored: DataFrame | None = None, fused: DataFrame | None = None, asked: list[packed.Asked] | None = None) -> dict[str, DataFrame]:
    """``hits`` (see ``search_drift``) and the ``communities`` (query_id, rank, community_id, score) that they were looked for in."""
    check_count("k", k)
    if scored is None and fused is None and scoring == "hybrid" and lexical.is_packed(index.weights):
        return _packed_drift(index, queries, k, communities, asked)
    scored = lexical.hold(lexical.scores(asked_postings(index, queries), queries)) if scored is None else scored
    fused = lexical.hold(lexical.final_scores(scored)) if fused is None else fused
    chosen = lexical.settled(rank_communities(index, queries, communities, fused))
    papers = chosen.join(index.need("members").select("community_id", "paper_id"), "community_id").select("query_id", "paper_id").distinct()
    final = fused if scoring == "hybrid" else lexical.final_scores(scored, scoring)
    inside = lexical.settled(lexical.search(index.weights, queries, k, scoring, index.chunks, papers, final=final).withColumn("fallback", F.lit(False)))
    rest = queries.join(inside.select("query_id").distinct(), "query_id", "left_anti").select("query_id")
    if rest.isEmpty():
        return {"hits": inside, "communities": chosen}
    others = lexical.search(index.weights, rest, k, scoring, index.chunks, scored=scored.join(rest, "query_id", "left_semi"))
    return {"hits": inside.unionByName(others.withColumn("fallback", F.lit(True))), "communities": chosen}


def _packed_drift(index: Index, queries: DataFrame, k: int, communities: int, asked: list[packed.Asked] | None = None) -> dict[str, DataFrame]:
    """``search_drift_parts`` by the first chunks of each community, without the other scores."""
    check_count("n", communities)
    best = keep(first_of_communities(index, queries, max(k, MEMBER_TOP), asked), "best")
    chosen = lexical.settled(_ranked_communities(best, communities))
    final = best.join(lexical.small(chosen.select("query_id", "community_id")), ["query_id", "community_id"], "left_semi").select("query_id", "chunk_id", "score")
    inside = lexical.settled(lexical.search(index.weights, queries, k, "hybrid", index.chunks, final=final).withColumn("fallback", F.lit(False)))
    rest = queries.join(inside.select("query_id").distinct(), "query_id", "left_anti")
    if rest.isEmpty():
        return {"hits": inside, "communities": chosen}
    others = lexical.search(index.weights, rest, k, "hybrid", index.chunks)
    return {"hits": inside.unionByName(others.withColumn("fallback", F.lit(True))), "communities": chosen}


def evidence(blocks: list[tuple[str, DataFrame]]) -> DataFrame:
    """``query_id, n, block, paper_id, content``: blocks (rows with query_id, rank, paper_id, content) one after another, numbered from 1."""
    rows = None
    for i, (name, df) in enumerate(blocks):
        own = df.select("query_id", F.lit(i).alias("i"), F.lit(name).alias("block"), "rank", "paper_id", "content")
        rows = own if rows is None else rows.unionByName(own)
    order = Window.partitionBy("query_id").orderBy("i", "rank", "paper_id")
    return rows.withColumn("n", F.row_number().over(order)).select("query_id", "n", "block", "paper_id", "content")


def context_text(found: DataFrame) -> DataFrame:
    """``query_id, context``: the evidence as numbered lines."""
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.col("content"))
    return found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


def references_for(found: DataFrame, metadata: DataFrame) -> DataFrame:
    """``query_id, position, paper_id, reference``: the papers of the evidence in order of first mention (``metadata``: paper_id, reference)."""
    first = found.groupBy("query_id", "paper_id").agg(F.min("n").alias("n"))
    out = first.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("n")))
    out = lexical.settled(out, 10 * lexical.LITERALS)
    own = metadata.select("paper_id", "reference").join(lexical.small(out.select("paper_id").distinct()), "paper_id", "left_semi")
    return out.join(own, "paper_id", "left").select("query_id", "position", "paper_id", "reference")


def answer_question(index: Index, query: str, mode: str = "auto", k: int = 5, provider=None, scoring: str = "hybrid") -> dict:
    """Route, search, gather evidence, and let ``provider`` (evidence text -> answer) write; without one nothing is generated."""
    from .routing import route

    spark = index.chunks.sparkSession
    if not query.strip():
        raise DomainError("invalid_input", "empty query")
    queries = spark.createDataFrame([("q", query)], "query_id string, query string")
    routing = route(queries).first() if mode == "auto" else None
    chosen = routing.mode if routing else mode
    if chosen not in ("basic", "local", "global", "drift"):
        raise DomainError("invalid_input", f"unknown mode {mode!r}")
    as_block = lambda hits: cited(index, hits).select("query_id", "rank", "paper_id", F.col("snippet").alias("content"))
    if chosen == "basic":
        blocks = [("hits", as_block(search_basic(index, queries, k, scoring)))]
    elif chosen == "drift":
        blocks = [("hits", as_block(search_drift(index, queries, k, scoring=scoring).drop("fallback")))]
    elif chosen == "local":
        parts = search_local(index, queries, k, scoring=scoring)
        fan = parts["fan_out"].withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "neighbor"))).select("query_id", "rank", "chunk_id", "score")
        blocks = [("seeds", as_block(parts["seeds"])), ("neighborhood", as_block(parts["neighborhood"])), ("fan_out", as_block(fan))]
    else:
        top = index.need("members").filter("is_representative").groupBy("community_id").agg(F.min_by("paper_id", F.struct(-F.col("centrality"), F.col("paper_id"))).alias("paper_id"))
        blocks = [("communities", search_global(index, queries, k).join(top, "community_id").select("query_id", "rank", "paper_id", F.col("summary").alias("content")))]
    found = evidence(blocks)
    entries = [r.asDict() for r in found.orderBy("n").collect()]  # at most 150 rows: k, seeds and fan-out are bounded
    text = "\n".join(f"[{e['n']}] {e['content']}" for e in entries)
    answer = provider(text) if provider and entries else None
    return {"mode": chosen, "routing": routing.asDict() if routing else None, "evidence": entries, "answer": answer, "generated": answer is not None}


def get_paper(index: Index, paper_id: str) -> DataFrame:
    """One row: pages, chunks, section titles in order of first appearance, first snippet; not_found if there is none.

    From a snapshot also the paper's kind, source and identifiers as they were read, and its merged record as ``reference``.
    """
    if not paper_id.strip():
        raise DomainError("invalid_input", "no paper id")
    rows = index.chunks.filter(F.col("paper_id") == paper_id)
    if rows.isEmpty():
        raise DomainError("not_found", f"no paper {paper_id}")
    titles = rows.filter(F.col("section_title") != "").groupBy("paper_id", "section_title").agg(F.min("row_index").alias("at")).groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "section_title"))), lambda x: x["section_title"]).alias("sections"))
    head = rows.groupBy("paper_id").agg(F.max("page_end").alias("n_pages"), F.count("*").alias("n_chunks"), snippet(F.min_by("text", "row_index")).alias("snippet"))
    out = head.join(titles, "paper_id", "left").withColumn("sections", F.coalesce("sections", F.array().cast("array<string>")))
    if index.papers is not None:
        out = out.join(index.papers.filter(F.col("paper_id") == paper_id).select("paper_id", "document_kind", "source_uri", "identifiers"), "paper_id", "left")
    if index.metadata is not None:
        record = F.struct(*[c for c in index.metadata.columns if c != "paper_id"]).alias("reference")
        out = out.join(index.metadata.filter(F.col("paper_id") == paper_id).select("paper_id", record), "paper_id", "left")
    return out


def references(metadata: DataFrame) -> DataFrame:
    """``paper_id, reference, in_text`` in both styles, ``citation_key, url, missing`` of merged metadata."""
    none = F.array().cast("array<string>")
    title, authors, year = F.coalesce("title", F.lit("")), F.coalesce("authors", none), F.coalesce("year", F.lit(0))
    url = preferred_url(F.coalesce("doi", F.lit("")), F.coalesce("arxiv_id", F.lit("")), F.coalesce("url", F.lit("")))
    styles = {s: format_reference(title, authors, year, F.coalesce("venue", F.lit("")), url, s) for s in ("apa", "harvard")}
    short = {f"{s}_in_text": format_in_text(title, authors, year, s) for s in ("apa", "harvard")}
    return metadata.select("paper_id", *[c.alias(n) for n, c in (styles | short).items()], citation_key(F.col("paper_id"), title, authors, year).alias("citation_key"), url.alias("url"), missing_fields(title, authors, year).alias("missing"))


def get_reference(index: Index, paper_id: str) -> DataFrame:
    """One row: a paper's reference in both styles and the fields that it lacks; not_found for an unknown paper."""
    if not paper_id.strip():
        raise DomainError("invalid_input", "no paper id")
    rows = index.need("metadata").filter(F.col("paper_id") == paper_id)
    if rows.isEmpty():
        raise DomainError("not_found", f"no paper {paper_id}")
    return references(rows)


def paper_files(papers: DataFrame, files: DataFrame) -> DataFrame:
    """``paper_id, available, path, size_bytes, reason`` of papers against a listing (``path, length``): reference entries have no file, others may lack theirs."""
    plain = lambda c: F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    there = files.select(plain(F.col("path")).alias("p"), "path", F.col("length").alias("size_bytes"))
    rows = papers.select("paper_id", "document_kind", F.when(F.col("source_uri").startswith("file:"), plain(F.col("source_uri"))).alias("p")).join(there, "p", "left")
    entry = F.col("document_kind") == "reference"
    has = ~entry & F.col("path").isNotNull()
    reason = F.when(entry, "reference_only").when(~has, "file_missing").otherwise("")
    return rows.select("paper_id", has.alias("available"), F.when(has, F.col("path")).otherwise("").alias("path"), F.when(has, F.col("size_bytes")).otherwise(0).alias("size_bytes"), reason.alias("reason"))


def get_paper_file(index: Index, paper_id: str) -> DataFrame:
    """One row of ``paper_files``: only the paper's own file is looked for."""
    from ..sources.sinks import exists

    row = index.need("papers").filter(F.col("paper_id") == paper_id).first()
    if row is None:
        raise DomainError("not_found", f"no paper {paper_id}")
    spark = index.chunks.sparkSession
    there = row.document_kind != "reference" and row.source_uri.startswith("file:") and exists(spark, row.source_uri)
    files = spark.read.format("binaryFile").load(row.source_uri).select("path", "length") if there else spark.createDataFrame([], "path string, length long")
    return paper_files(index.papers.filter(F.col("paper_id") == paper_id), files)


def get_topic(index: Index, community_id: int) -> DataFrame:
    """One row: a community with all its members, most central first, and its representatives; not_found without it."""
    rows = index.need("communities").filter(F.col("community_id") == community_id)
    if rows.isEmpty():
        raise DomainError("not_found", f"no community {community_id}")
    return rows.join(topic_members(index.need("members").filter(F.col("community_id") == community_id)), "community_id")


def topic_members(members: DataFrame) -> DataFrame:
    """``community_id, members, representatives``: ids in order of id, representatives in order of centrality."""
    by_rank = F.array_sort(F.collect_list(F.when(F.col("is_representative"), F.struct((-F.col("centrality")).alias("c"), "paper_id"))))
    return members.groupBy("community_id").agg(F.array_sort(F.collect_list("paper_id")).alias("members"), F.transform(by_rank, lambda x: x["paper_id"]).alias("representatives"))


def search_author_papers(index: Index, person: str, query: str, k: int = 5) -> DataFrame:
    """The first ``k`` chunks of a question among the papers of one person; ranks are the corpus's, the filter comes after."""
    if not person.strip() or not query.strip():
        raise DomainError("invalid_input", "a person and a question are needed")
    own = index.need("authors").filter(F.col("person_key") == person).select("paper_id").distinct()
    if own.isEmpty():
        raise DomainError("not_found", f"no person {person}")
    asked = index.chunks.sparkSession.createDataFrame([("q", query)], "query_id string, query string")
    return lexical.search(asked_postings(index, asked), asked, k, "hybrid", index.chunks, own)
