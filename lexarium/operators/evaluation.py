"""Evaluation: gold labels, hit rate and reciprocal rank, coverage and lift, rank baselines, consistency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import numbered

#: Gold questions that a scan is tested against at once.
GROUP = 1_000


def expected_papers(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """``qid, paper_id``: full texts with a chunk that holds all terms of a question (``qid, match_all``), case folded.

    Terms are plain substrings (no wildcards), so that no key joins them: the questions are an array that every task has, and
    a chunk is tested against them in place, each question up to the first term that is missing. Questions come in groups of
    GROUP, each a scan, so that no group's size depends on how many there are.
    """
    full = chunks.filter("document_kind = 'full'").select("paper_id", F.lower("text").alias("text"))
    terms = questions.select(F.struct("qid", F.transform("match_all", lambda t: F.lower(t)).alias("terms")).alias("q"))
    n = questions.count()
    out = full.select(F.lit("").alias("qid"), "paper_id").filter(F.lit(False))
    for g in range(-(-n // GROUP)):
        group = terms.withColumn("g", F.pmod(F.xxhash64("q.qid"), F.lit(-(-n // GROUP)))).filter(F.col("g") == g)
        asked = F.broadcast(group.agg(F.collect_list("q").alias("asked")))  # one row of about GROUP questions
        hits = F.transform(F.filter("asked", lambda q: F.forall(q["terms"], lambda t: F.contains(F.col("text"), t))), lambda q: q["qid"])
        out = out.unionByName(full.crossJoin(asked).select("paper_id", F.explode(hits).alias("qid")).select("qid", "paper_id"))
    return out.distinct()


def label_findings(gold: DataFrame, derived: DataFrame) -> DataFrame:
    """``qid, missing, surplus``: where frozen labels (``qid, paper_id``) differ from those derived again."""
    rows = gold.withColumn("g", F.lit(1)).join(derived.withColumn("d", F.lit(1)), ["qid", "paper_id"], "full_outer")
    out = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.when(F.col("g").isNull(), F.col("paper_id")))).alias("missing"), F.array_sort(F.collect_list(F.when(F.col("d").isNull(), F.col("paper_id")))).alias("surplus"))
    return out.filter((F.size("missing") > 0) | (F.size("surplus") > 0))


def first_hits(entries: DataFrame, expected: DataFrame, questions: DataFrame) -> DataFrame:
    """``qid, rank, component, rr`` of every question: the first relevant entry (``qid, rank, paper_id, component``), nulls and 0 without one."""
    hits = entries.join(expected, ["qid", "paper_id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("rank"), F.min_by("component", "rank").alias("component"))
    return questions.select("qid").join(hits, "qid", "left").withColumn("rr", F.coalesce(1.0 / F.col("rank"), F.lit(0.0)))


def report(scored: DataFrame, questions: DataFrame) -> DataFrame:
    """``kind, n, hit_rate, mrr`` by kind, and over all (kind null)."""
    rows = scored.join(questions.select("qid", "kind"), "qid")
    return rows.rollup("kind").agg(F.count("*").alias("n"), F.round(F.avg(F.col("rank").isNotNull().cast("double")), 6).alias("hit_rate"), F.round(F.avg("rr"), 6).alias("mrr"))


def lift(coverage: Column, selectivity: Column) -> Column:
    return F.when(selectivity > 0, coverage / selectivity).otherwise(0.0)


def community_coverage(chosen: DataFrame, members: DataFrame, expected: DataFrame, n_papers: int) -> DataFrame:
    """``qid, coverage, selectivity, lift`` of the communities chosen for each question (``qid, community_id``)."""
    covered = chosen.join(members.select("community_id", "paper_id"), "community_id").select("qid", "paper_id").distinct().withColumn("in", F.lit(1))
    found = expected.join(covered, ["qid", "paper_id"], "left").groupBy("qid").agg(F.avg(F.coalesce("in", F.lit(0))).alias("coverage"))
    size = covered.groupBy("qid").agg((F.count("*") / n_papers).alias("selectivity"))
    return found.join(size, "qid", "left").withColumn("selectivity", F.coalesce("selectivity", F.lit(0.0))).withColumn("lift", lift(F.col("coverage"), F.col("selectivity")))


#: The frame of multi-hop questions, and groups of anchors by the number of papers that cite them: fixed values.
QUERY_FRAME = "Which papers build on %s?"
CITED = [(10, "cited 10+"), (5, "cited 5-9"), (0, "cited 3-4")]
LEVELS = ["graph", "basic_title", "local_title", "basic_topic", "local_topic"]


def derive_questions(edges: DataFrame, min_sources: int = 3) -> DataFrame:
    """``qid, anchor_paper_id, expected, kind``: papers that enough others cite, numbered in order of id."""
    rows = edges.groupBy("target_paper_id").agg(F.array_sort(F.collect_set("source_paper_id")).alias("expected")).filter(F.size("expected") >= min_sources)
    kind = reduce(lambda a, b: a.when(F.size("expected") >= b[0], b[1]), CITED[1:], F.when(F.size("expected") >= CITED[0][0], CITED[0][1]))
    return numbered(rows, "target_paper_id").select(F.format_string("C%02d", "number").alias("qid"), F.col("target_paper_id").alias("anchor_paper_id"), "expected", kind.alias("kind"))


def multihop_questions(edges: DataFrame, papers: DataFrame, docs: DataFrame, min_sources: int = 3, stop: list[str] | None = None) -> DataFrame:
    """Anchors with their title, topic terms (first keywords of ``docs``: doc_id, text) and two queries: by title and by topic."""
    from ..functions.names import title_from_uri
    from .lexical import keyword_table

    own = papers.select(F.col("paper_id").alias("target_paper_id"), title_from_uri(F.col("source_uri")).alias("anchor_title"))
    asked = derive_questions(edges.join(own.select("target_paper_id"), "target_paper_id", "left_semi"), min_sources)
    terms = keyword_table(docs, stop=stop).select(F.col("doc_id").alias("anchor_paper_id"), F.col("keywords").alias("topic_terms"))
    rows = asked.join(own.withColumnRenamed("target_paper_id", "anchor_paper_id"), "anchor_paper_id").join(terms, "anchor_paper_id", "left")
    rows = rows.withColumn("topic_terms", F.coalesce("topic_terms", F.array().cast("array<string>")))
    return rows.withColumns({"query_title": F.format_string(QUERY_FRAME, "anchor_title"), "query_topic": F.format_string(QUERY_FRAME, F.array_join("topic_terms", ", "))})


def verify_questions(frozen: DataFrame, derived: DataFrame) -> DataFrame:
    """``qid, finding``: how frozen questions differ from those derived again (both: qid, anchor_paper_id, anchor_title, topic_terms, expected)."""
    mine, theirs = frozen.select("qid", F.struct("anchor_paper_id", "anchor_title", "topic_terms", "expected").alias("a")), derived.select("qid", F.struct("anchor_paper_id", "anchor_title", "topic_terms", "expected").alias("b"))
    rows = mine.join(theirs, "qid", "full_outer")
    differs = lambda f, name: F.when(F.col(f"a.{f}") != F.col(f"b.{f}"), name)
    found = F.when(F.col("a").isNull(), F.array(F.lit("not_frozen"))).when(F.col("b").isNull(), F.array(F.lit("not_derivable"))).otherwise(
        F.array_compact(F.array(differs("anchor_paper_id", "anchor"), differs("anchor_title", "title"), differs("topic_terms", "terms"), differs("expected", "expected")))
    )
    return rows.select("qid", F.explode(found).alias("finding"))


def recall_bounds(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """``paper_id, no_references, no_title_key, no_identifier_key, unreachable``: which papers can't cite, or can't be cited, whatever the matching.

    No reference section; a title too short to be searched for; no identifier on its own first pages; neither of the two.
    """
    from ..functions.names import normalize_title, title_from_uri
    from ..functions.text import is_reference_section
    from .records import front_texts

    cites = chunks.filter(is_reference_section(F.col("section_title"))).select("paper_id").distinct().withColumn("cites", F.lit(True))
    title = normalize_title(title_from_uri(F.col("source_uri")))
    rows = papers.join(cites, "paper_id", "left").join(front_texts(chunks).select("paper_id", F.lower("text").alias("front")), "paper_id", "left")
    backed = F.exists(F.map_values("identifiers"), lambda v: (v != "") & F.contains(F.coalesce(F.col("front"), F.lit("")), F.lower(v)))
    rows = rows.select("paper_id", F.col("cites").isNull().alias("no_references"), ((F.length(title) < 30) | (F.size(F.split(title, " ")) < 5)).alias("no_title_key"), (~F.coalesce(backed, F.lit(False))).alias("no_identifier_key"))
    return rows.withColumn("unreachable", F.col("no_title_key") & F.col("no_identifier_key"))


def without_anchor(entries: DataFrame, questions: DataFrame) -> DataFrame:
    """Entries without each question's anchor, ranks closed up; the component says whether a section is the references."""
    from ..functions.text import is_reference_section

    rows = entries.join(questions.select("qid", F.col("anchor_paper_id").alias("paper_id")), ["qid", "paper_id"], "left_anti")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    return rows.withColumn("component", F.when(is_reference_section(F.col("section_title")), "ref").otherwise("body"))


def compare_ranks(before: DataFrame, after: DataFrame) -> DataFrame:
    """``label, qid, before, after, severity``: ranks (``label, qid, rank``) that changed: regression, worse, better or new."""
    rows = before.withColumnRenamed("rank", "before").join(after.withColumnRenamed("rank", "after"), ["label", "qid"], "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))
    severity = F.when(F.col("after").isNull(), "regression").when(F.col("before").isNull(), "new").when(F.col("after") > F.col("before"), "worse").otherwise("better")
    return rows.withColumn("severity", severity)


def router_report(routed: DataFrame, gold: DataFrame) -> DataFrame:
    """``confidence, n, accuracy`` of routed questions against the modes that each may have (``query_id, expected_modes``)."""
    rows = routed.join(gold.select("query_id", "expected_modes"), "query_id").withColumn("right", F.array_contains("expected_modes", F.col("mode")).cast("double"))
    return rows.rollup("confidence").agg(F.count("*").alias("n"), F.round(F.avg("right"), 6).alias("accuracy"))


def consistency(papers: DataFrame, manifest: DataFrame) -> DataFrame:
    """``side, paper_id``: papers without a manifest entry, and entries without a paper."""
    a, b = papers.select("paper_id").distinct(), manifest.select("paper_id").distinct()
    return a.exceptAll(b).select(F.lit("papers").alias("side"), "paper_id").unionByName(b.exceptAll(a).select(F.lit("manifest").alias("side"), "paper_id"))


def global_scores(chosen: DataFrame, members: DataFrame, expected: DataFrame, questions: DataFrame) -> DataFrame:
    """``qid, rank, diagnosis`` of the communities chosen for each question (``qid, rank, community_id``): the first that holds an expected paper."""
    wanted = expected.join(members.select("paper_id", "community_id"), "paper_id").select("qid", "community_id").distinct()  # labels, not members of what is chosen
    hits = chosen.join(wanted, ["qid", "community_id"]).groupBy("qid").agg(F.min("rank").alias("rank"))
    any_ = chosen.select("qid").distinct().withColumn("any", F.lit(True))
    rows = questions.select("qid").join(hits, "qid", "left").join(any_, "qid", "left")
    return rows.select("qid", "rank", F.when(F.col("any").isNull(), "no_community").when(F.col("rank").isNull(), "community_missed").otherwise("in_community").alias("diagnosis"))


def coverage_stats(chosen: DataFrame, members: DataFrame, expected: DataFrame, questions: DataFrame, n_papers: int) -> DataFrame:
    """``strategy, coverage, selectivity, lift``: means over all questions of strategies that choose communities (``strategy, qid, community_id``).

    Papers are counted by the set of communities that they are in (mostly one), so that no row is made for a question and a paper
    but those that are expected.
    """
    sizes = expected.groupBy("qid").agg(F.count_distinct("paper_id").alias("n_expected"))
    sets = members.groupBy("paper_id").agg(F.array_sort(F.collect_set("community_id")).alias("own")).groupBy("own").agg(F.count("*").alias("n"))
    in_sets = sets.select("own", "n", F.explode("own").alias("community_id"))
    covered = chosen.join(in_sets, "community_id").select("strategy", "qid", "own", "n").distinct().groupBy("strategy", "qid").agg(F.sum("n").alias("n"))
    found = expected.distinct().join(members.select("paper_id", "community_id"), "paper_id").join(chosen, ["qid", "community_id"])
    found = found.select("strategy", "qid", "paper_id").distinct().groupBy("strategy", "qid").agg(F.count("*").alias("n_hit"))
    hit = covered.join(found, ["strategy", "qid"], "left")
    every = questions.select("qid").crossJoin(F.broadcast(chosen.select("strategy").distinct()))  # a few strategies
    rows = every.join(hit, ["strategy", "qid"], "left").join(sizes, "qid", "left")
    rows = rows.select("strategy", F.coalesce(F.coalesce("n_hit", F.lit(0)) / F.col("n_expected"), F.lit(0.0)).alias("c"), (F.coalesce("n", F.lit(0)) / n_papers).alias("s"))
    out = rows.groupBy("strategy").agg(F.avg("c").alias("coverage"), F.avg("s").alias("selectivity"))
    return out.withColumn("lift", lift(F.col("coverage"), F.col("selectivity")))


def community_baselines(members: DataFrame, questions: DataFrame, n: int, draws: int = 100, seed: int = 42) -> DataFrame:
    """``strategy, qid, community_id`` of the ``n`` largest communities, and of ``draws`` seeded random choices of ``n`` (one strategy each), for every question."""
    sizes = members.groupBy("community_id").agg(F.count("*").alias("size"))
    largest = sizes.orderBy(F.desc("size"), "community_id").limit(n).select(F.lit("largest").alias("strategy"), "community_id")
    drawn = sizes.select("community_id", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    order = Window.partitionBy("draw").orderBy(F.xxhash64(F.lit(seed), "draw", "community_id"))
    drawn = drawn.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n).select(F.concat(F.lit("random-"), F.col("draw").cast("string")).alias("strategy"), "community_id")
    return largest.unionByName(drawn).crossJoin(F.broadcast(questions.select("qid")))  # a gold set


def drift_scores(hits: DataFrame, chosen: DataFrame, members: DataFrame, expected: DataFrame, questions: DataFrame) -> DataFrame:
    """``qid, rank, rr, diagnosis`` of hits (``qid, rank, paper_id, fallback``): by way of the fallback, within a chosen community, or with the community missed."""
    scored = first_hits(hits.withColumn("component", F.lit("citation")), expected, questions).drop("component")
    fell = hits.groupBy("qid").agg(F.max("fallback").alias("fell"))
    inside = global_scores(chosen, members, expected, questions).select("qid", (F.col("diagnosis") == "in_community").alias("inside"))
    rows = scored.join(fell, "qid", "left").join(inside, "qid", "left")
    return rows.select("qid", "rank", "rr", F.when(F.coalesce("fell", F.lit(False)), "fallback").when(F.col("inside"), "in_community").otherwise("community_missed").alias("diagnosis"))


def bundle(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """``qid, rank, paper_id, component``: blocks of hits (``qid, rank, paper_id``) one after another, ranks counted through."""
    rows = reduce(DataFrame.unionByName, [df.select("qid", F.lit(i).alias("i"), "rank", "paper_id", F.lit(name).alias("component")) for i, (name, df) in enumerate(parts)])
    order = Window.partitionBy("qid").orderBy("i", "rank", "paper_id")
    return rows.withColumn("rank", F.row_number().over(order)).select("qid", "rank", "paper_id", "component")


def level_scores(entries: DataFrame, questions: DataFrame) -> DataFrame:
    """``level, qid, kind, rank, rr, component`` of bundles (``level, qid, rank, paper_id, section_title, component``) without each question's anchor.

    ``questions``: qid, kind, anchor_paper_id, expected. The component says what part of a bundle was right, and whether that
    was in the references.
    """
    from ..functions.text import is_reference_section

    rows = entries.join(questions.select("qid", F.col("anchor_paper_id").alias("paper_id")), ["qid", "paper_id"], "left_anti")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("level", "qid").orderBy("rank")))
    part = F.when(F.col("component") == "neighbor", F.col("component")).otherwise(F.concat_ws(":", "component", F.when(is_reference_section(F.coalesce("section_title", F.lit(""))), "ref").otherwise("body")))
    wanted = questions.select("qid", F.explode("expected").alias("paper_id"))
    hits = rows.withColumn("part", part).join(wanted, ["qid", "paper_id"], "left_semi").groupBy("level", "qid").agg(F.min("rank").alias("rank"), F.min_by("part", "rank").alias("component"))
    every = questions.select("qid", "kind").crossJoin(F.broadcast(entries.select("level").distinct()))  # five levels
    return every.join(hits, ["level", "qid"], "left").select("level", "qid", "kind", "rank", F.coalesce(1.0 / F.col("rank"), F.lit(0.0)).alias("rr"), "component")


def fingerprint(papers: DataFrame, chunks: DataFrame, communities: DataFrame | None, gold_version: str, index_version: str, parameters: dict) -> dict:
    """What a measurement depends on, read off the snapshot itself."""
    return {"gold_set_version": gold_version, "index_schema_version": index_version, "n_papers": papers.count(), "n_chunks": chunks.count(), "n_communities": communities.count() if communities is not None else 0, "parameters": dict(parameters)}


def differences(before: dict, after: dict) -> list[str]:
    """The fields in which two fingerprints differ: none of them may, if ranks are to be compared."""
    return [f"{k}: {before[k]} -> {after.get(k)}" for k in before if before[k] != after.get(k)]


def confusion(routed: DataFrame, gold: DataFrame) -> DataFrame:
    """``expected, mode, n`` of routed questions that missed the modes that they may have."""
    rows = routed.join(gold.select("query_id", "expected_modes"), "query_id").filter(~F.array_contains("expected_modes", F.col("mode")))
    return rows.groupBy(F.array_join("expected_modes", "|").alias("expected"), "mode").agg(F.count("*").alias("n"))


def uncovered_signals(signals: DataFrame, questions: DataFrame) -> DataFrame:
    """``ordinal, signal`` of routing signals that no question (``query``) touches, in their order."""
    asked = questions.select(F.trim(F.lower("query")).alias("q"))
    touched = asked.join(F.broadcast(signals), F.expr("q rlike pattern")).select("signal").distinct()  # a fixed 69 rows
    return signals.join(touched, "signal", "left_anti").select("ordinal", "signal").orderBy("ordinal")


def render(title: str, rows: DataFrame, columns: list[str]) -> str:
    """A report's rows as a markdown table; reports are a few rows for each question at most."""
    cell = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    body = [f"| {' | '.join(cell(r[c]) for c in columns)} |" for r in rows.select(*columns).collect()]
    return "\n".join([f"# {title}", "", f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}", *body, ""])


def unlabelled(questions: DataFrame, expected: DataFrame) -> DataFrame:
    """``qid`` of questions without any expected paper."""
    return questions.select("qid").join(expected.select("qid"), "qid", "left_anti")


def relabel(gold: DataFrame, derived: DataFrame, mechanical: DataFrame) -> DataFrame:
    """Labels (``qid, paper_id``) with those of mechanical questions (``qid``) made anew; labels by hand stay."""
    return gold.join(mechanical, "qid", "left_anti").unionByName(derived.join(mechanical, "qid", "left_semi").select("qid", "paper_id"))
