"""Evaluation of a snapshot end to end: every search mode over a gold set, and multi-hop questions on five levels.

All questions of all labels are searched at once: scores and fused scores are made once for the set, and what differs by label is
rows. A bundle is what a mode answers with, in order; what counts is the first entry that is expected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DomainError, check_count
from ..operators import evaluation, lexical, packed, retrieval
from ..operators.graph import both_ways
from ..operators.retrieval import Index
from ..shared import keep

#: What is measured of a gold set, and parameters of a run: fixed values.
LABELS = ("primitive", "basic", "local", "global", "drift")
K, SEEDS, FAN_OUT, COMMUNITIES, DRIFT_K = 5, 5, 5, 5, 6


def _papers(index: Index, hits: DataFrame) -> DataFrame:
    return hits.join(index.chunks.select("chunk_id", "paper_id", "section_title"), "chunk_id")


def _fan_ranks(fan: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("weight"), "neighbor")
    return fan.withColumn("rank", F.row_number().over(order))


def local_bundle(index: Index, queries: DataFrame, k: int, seeds: int, fan_out: int, scoring: str, scored: DataFrame | None, final: DataFrame | None = None, asked: list[packed.Asked] | None = None) -> DataFrame:
    """``query_id, rank, paper_id, section_title, component``: seeds, their neighbourhood, then the fan-out, ranks counted through."""
    parts = retrieval.search_local(index, queries, k, seeds, fan_out, scoring, scored, final, asked)
    blocks = [_papers(index, parts["seeds"]), _papers(index, parts["neighborhood"]), _fan_ranks(_papers(index, parts["fan_out"]))]
    rows = [b.select("query_id", F.lit(i).alias("i"), F.lit(name).alias("component"), "rank", "paper_id", "section_title") for i, (name, b) in enumerate(zip(("seed", "neighborhood", "fan_out"), blocks, strict=True))]
    order = Window.partitionBy("query_id").orderBy("i", "rank", "paper_id")
    return reduce(DataFrame.unionByName, rows).withColumn("rank", F.row_number().over(order)).drop("i")


def evaluate_all(index: Index, questions: DataFrame, expected: DataFrame, labels: tuple[str, ...] = LABELS, k: int = K, seeds: int = SEEDS, fan_out: int = FAN_OUT, communities: int = COMMUNITIES, drift_k: int = DRIFT_K, scoring: str = "hybrid") -> DataFrame:
    """``label, qid, kind, rank, rr, diagnosis`` of every question (``qid, query, kind``) against ``expected`` (qid, paper_id) on every label.

    The diagnosis of local is the part of the bundle that was right first, of global and drift how their communities did;
    the others have none.
    """
    for label in labels:
        if label not in LABELS:
            raise DomainError("invalid_input", f"unknown label {label!r}", allowed=LABELS)
    check_count("k", k)
    queries = questions.select(F.col("qid").alias("query_id"), "query")
    expected = keep(expected, "expected")  # every label reads it
    asked = scored = fused = None
    if scoring == "hybrid" and lexical.is_packed(index.weights):  # the postings are asked for once, and scores are made where they lie
        asked = packed.ask(index.weights, queries, retrieval.communities_of_chunks(index) if index.members is not None else None)
        final = keep(packed.first(index.weights, queries, max(k, seeds), scoring, asked), "final") if {"primitive", "basic", "local"} & set(labels) else None
    else:
        scored = lexical.hold(lexical.scores(retrieval.asked_postings(index, queries), queries))
        fused = lexical.hold(lexical.final_scores(scored))
        final = fused if scoring == "hybrid" else lexical.hold(lexical.final_scores(scored, scoring))
    qid = lambda df: df.withColumnRenamed("query_id", "qid")
    none = F.lit(None).cast("string")
    out = []

    def add(label: str, rows: DataFrame) -> None:
        out.append(rows.select(F.lit(label).alias("label"), "qid", "rank", "diagnosis"))

    def hits_of(entries: DataFrame) -> DataFrame:
        return evaluation.first_hits(qid(entries), expected, questions)

    if "primitive" in labels or "basic" in labels:
        hits = lexical.search(index.weights, queries, k, scoring, index.chunks, final=final)
        plain = lexical.hold(hits_of(_papers(index, hits).withColumn("component", F.lit("citation"))).withColumn("diagnosis", none))
        for label in ("primitive", "basic"):
            if label in labels:
                add(label, plain)
    if "local" in labels:
        bundle = keep(local_bundle(index, queries, k, seeds, fan_out, scoring, scored, final, asked), "bundle")
        add("local", hits_of(bundle).withColumnRenamed("component", "diagnosis"))
    if "global" in labels or "drift" in labels:
        parts = retrieval.search_drift_parts(index, queries, drift_k, communities, scoring, scored, fused, asked) if asked is not None or "drift" in labels else None
        chosen = lexical.hold(retrieval.rank_communities(index, queries, communities, fused)) if asked is None else parts["communities"]
        if "global" in labels:
            add("global", evaluation.global_scores(qid(chosen), index.need("members"), expected, questions))
        if "drift" in labels:
            add("drift", evaluation.drift_scores(qid(_papers(index, parts["hits"])), qid(chosen), index.need("members"), expected, questions))
    rows = reduce(DataFrame.unionByName, out).join(questions.select("qid", "kind"), "qid")
    return rows.select("label", "qid", "kind", "rank", F.coalesce(1.0 / F.col("rank"), F.lit(0.0)).alias("rr"), "diagnosis")


def summary(scores: DataFrame) -> DataFrame:
    """``label, kind, n, hit_rate, mrr`` of scores by label and kind, and over all kinds (kind null)."""
    rows = scores.rollup("label", "kind").agg(F.count("*").alias("n"), F.round(F.avg(F.col("rank").isNotNull().cast("double")), 6).alias("hit_rate"), F.round(F.avg("rr"), 6).alias("mrr"))
    return rows.filter("label is not null")


def multihop_bundles(index: Index, questions: DataFrame, k: int = K, seeds: int = SEEDS, fan_out: int = FAN_OUT, scoring: str = "hybrid") -> DataFrame:
    """``level, qid, rank, paper_id, section_title, component``: the bundles of multi-hop questions on all levels.

    Questions as ``evaluation.multihop_questions`` gives them. The graph level is the anchor's heaviest neighbours, without
    a search; the others search by title and by topic, both forms of all questions as one query set.
    """
    forms = F.explode(F.array(*[F.struct(F.lit(f).alias("form"), F.col(f"query_{f}").alias("query")) for f in ("title", "topic")]))
    asked = questions.select("qid", forms.alias("f")).select("qid", "f.form", "f.query", F.concat_ws(":", "f.form", "qid").alias("query_id"))
    queries = asked.select("query_id", "query")
    scored = lexical.hold(lexical.scores(retrieval.asked_postings(index, queries), queries))
    final = lexical.hold(lexical.final_scores(scored, scoring))
    basic = _papers(index, lexical.search(index.weights, queries, k, scoring, index.chunks, final=final)).withColumn("component", F.lit("chunk"))
    local = local_bundle(index, queries, k, seeds, fan_out, scoring, scored, final)
    columns = ["query_id", "rank", "paper_id", "section_title", "component"]
    both = basic.select(F.lit("basic").alias("mode"), *columns).unionByName(local.select(F.lit("local").alias("mode"), *columns))
    both = both.join(asked.select("query_id", "qid", "form"), "query_id")
    near = both_ways(index.need("edges")).withColumnRenamed("paper_id", "anchor_paper_id")
    order = Window.partitionBy("qid").orderBy(F.desc("weight"), "neighbor")
    graph = questions.select("qid", "anchor_paper_id").join(near, "anchor_paper_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    graph = graph.select(F.lit("graph").alias("level"), "qid", "rank", F.col("neighbor").alias("paper_id"), F.lit("").alias("section_title"), F.lit("neighbor").alias("component"))
    return graph.unionByName(both.select(F.concat_ws("_", "mode", "form").alias("level"), "qid", "rank", "paper_id", "section_title", "component"))


def evaluate_multihop(index: Index, questions: DataFrame, **parameters) -> DataFrame:
    """``level, qid, kind, rank, rr, component`` on every level, each question's anchor taken out of its bundles."""
    rows = evaluation.level_scores(multihop_bundles(index, questions, **parameters), questions)
    every = questions.select("qid", "kind", F.explode(F.array(*[F.lit(x) for x in evaluation.LEVELS])).alias("level"))  # a level without any bundle has its rows too
    return every.join(rows.drop("kind"), ["level", "qid"], "left").select("level", "qid", "kind", "rank", F.coalesce("rr", F.lit(0.0)).alias("rr"), "component")


def graph_coverage(edges: DataFrame, papers: DataFrame, questions: DataFrame, k: int = K) -> DataFrame:
    """``strategy, coverage, selectivity, lift`` of the anchors' first ``k`` neighbours, and of as many papers drawn by chance.

    Chance is the mean over all draws of ``k`` papers but the anchor, not a sample of draws: each expected paper is in k of
    the other n - 1 by equal odds.
    """
    n = papers.select("paper_id").distinct().count()
    if n < 2 or questions.isEmpty():
        return questions.sparkSession.createDataFrame([], "strategy string, coverage double, selectivity double, lift double")
    order = Window.partitionBy("qid").orderBy(F.desc("weight"), "neighbor")
    near = questions.select("qid", "anchor_paper_id", "expected").join(both_ways(edges).withColumnRenamed("paper_id", "anchor_paper_id"), "anchor_paper_id")
    near = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).groupBy("qid").agg(F.count("*").alias("size"), F.count_if(F.array_contains("expected", F.col("neighbor"))).alias("hits"))
    rows = questions.select("qid", F.size("expected").alias("wanted")).join(near, "qid", "left")
    drawn = min(k, n - 1)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    real = rows.agg(F.avg(share(zero("hits"), F.col("wanted"))).alias("coverage"), F.avg(zero("size") / n).alias("selectivity")).select(F.lit("graph").alias("strategy"), "*")
    chance = rows.agg(F.avg(share(F.lit(drawn / (n - 1)) * F.col("wanted"), F.col("wanted"))).alias("coverage"), F.lit(drawn / n).alias("selectivity")).select(F.lit("chance").alias("strategy"), "*")
    return real.unionByName(chance).withColumn("lift", evaluation.lift(F.col("coverage"), F.col("selectivity")))
