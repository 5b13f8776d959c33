"""Evaluation results as text: sections of markdown tables, a few rows each, made from the results' tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation

COVERAGE_NOTE = "Coverage can only be read beside selectivity: a lift of 1 is chance."
LABEL_NOTE = "Expected papers are found by their words, so a lexical search is favoured."
CITATION_NOTE = "Expected papers are those that cite the anchor: a lookup of its citations finds all of them."


def _shares(right: Column, rr: Column) -> list[Column]:
    return [F.count("*").alias("n"), F.avg(right.cast("double")).alias("hit_rate"), F.avg(rr).alias("mrr")]


def _by_label(scores: DataFrame, label: str, diagnosis: str) -> DataFrame:
    """One row a label: counts, shares, and how often each diagnosis was made."""
    own = scores.groupBy(label).agg(*_shares(F.col("rank").isNotNull(), F.col("rr")))
    made = scores.filter(F.col(diagnosis).isNotNull()).groupBy(label, diagnosis).agg(F.count("*").alias("times"))
    named = F.array_sort(F.collect_list(F.struct((-F.col("times")).alias("o"), F.concat_ws(" ", diagnosis, F.col("times").cast("string")).alias("t"))))
    made = made.groupBy(label).agg(F.array_join(F.transform(named, lambda x: x["t"]), ", ").alias("diagnoses"))
    return own.join(made, label, "left").orderBy(label)


def _sections(parts: list[tuple[str, DataFrame, list[str]]], notes: list[str]) -> str:
    return "\n".join([*(evaluation.render(title, rows, columns) for title, rows, columns in parts), *notes, ""])


def questions_report(scores: DataFrame, questions: DataFrame) -> str:
    """Every question of one label (``qid, kind, rank, rr``) with its text, then shares by kind and over all."""
    rows = scores.join(questions.select("qid", "query"), "qid").orderBy("qid")
    kinds = evaluation.report(scores.drop("kind"), scores.select("qid", "kind")).withColumn("kind", F.coalesce("kind", F.lit("all"))).orderBy(F.col("kind") == "all", "kind")
    return _sections([("Questions", rows, ["qid", "kind", "rank", "rr", "query"]), ("By kind", kinds, ["kind", "n", "hit_rate", "mrr"])], [LABEL_NOTE])


def modes_report(scores: DataFrame, coverage: DataFrame | None = None) -> str:
    """All labels of ``evaluate.evaluate_all``, with the choice of communities (``evaluation.coverage_stats``) if it is given."""
    parts = [("Modes", _by_label(scores, "label", "diagnosis"), ["label", "n", "hit_rate", "mrr", "diagnoses"])]
    if coverage is not None:
        parts.append(("Choice of communities", coverage.orderBy("strategy"), ["strategy", "coverage", "selectivity", "lift"]))
    return _sections(parts, [COVERAGE_NOTE, LABEL_NOTE] if coverage is not None else [LABEL_NOTE])


def multihop_report(scores: DataFrame, coverage: DataFrame | None = None, bounds: DataFrame | None = None) -> str:
    """All levels of ``evaluate.evaluate_multihop``, hit rates by how often anchors are cited, ``evaluate.graph_coverage``, and the bounds (``evaluation.recall_bounds``) summed up."""
    by_kind = scores.groupBy("level", "kind").agg(*_shares(F.col("rank").isNotNull(), F.col("rr"))).orderBy("level", "kind")
    parts = [("Levels", _by_label(scores, "level", "component"), ["level", "n", "hit_rate", "mrr", "diagnoses"]), ("By citations of the anchor", by_kind, ["level", "kind", "n", "hit_rate"])]
    if coverage is not None:
        parts.append(("Neighbours against chance", coverage.orderBy("strategy"), ["strategy", "coverage", "selectivity", "lift"]))
    if bounds is not None:
        flags = ["no_references", "no_title_key", "no_identifier_key", "unreachable"]
        parts.append(("Bounds of the citation graph", bounds.agg(F.count("*").alias("papers"), *[F.count_if(f).alias(f) for f in flags]), ["papers", *flags]))
    return _sections(parts, [COVERAGE_NOTE, CITATION_NOTE])


def router_report(routed: DataFrame, gold: DataFrame) -> str:
    """Shares of right modes by kind and by confidence, and the questions that were missed (``gold``: query_id, kind, expected_modes)."""
    rows = routed.join(gold, "query_id").withColumn("right", F.array_contains("expected_modes", F.col("mode")))
    share = [F.count("*").alias("n"), F.avg(F.col("right").cast("double")).alias("accuracy")]
    missed = rows.filter(~F.col("right")).select("query_id", "kind", F.array_join("expected_modes", "|").alias("expected"), "mode", "confidence").orderBy("query_id")
    return _sections([
        ("By kind", rows.groupBy("kind").agg(*share).orderBy("kind"), ["kind", "n", "accuracy"]), ("By confidence", rows.groupBy("confidence").agg(*share).orderBy("confidence"), ["confidence", "n", "accuracy"]),
        ("Missed", missed, ["query_id", "kind", "expected", "mode", "confidence"]),
    ], [])


def comparison_report(before: dict, after: dict, changes: DataFrame) -> str:
    """Ranks that changed (``evaluation.compare_ranks``), worst first; where the fingerprints differ, those instead, as ranks can't be compared."""
    differ = evaluation.differences(before, after)
    if differ:
        return "\n".join(["# Not comparable", "", *(f"- {d}" for d in differ), ""])
    order = F.array_position(F.array(*[F.lit(x) for x in ("regression", "worse", "new", "better")]), F.col("severity"))
    counts = changes.groupBy("severity").agg(F.count("*").alias("n")).orderBy(order)
    return _sections([("Changes", counts, ["severity", "n"]), ("Ranks", changes.orderBy(order, "label", "qid"), ["severity", "label", "qid", "before", "after"])], [])
