"""Which search mode a question asks for: signals in its words, counted by mode."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Signals by mode and kind of match, in order of evaluation: fixed values.
SIGNALS = [
    ("drift", "stem", ["widerspr", "gegensatz", "gegensätz", "vergleich"]),
    ("drift", "prefix", ["contradict", "disagree"]),
    ("drift", "word", ["versus", "vs", "differ", "differs", "difference", "differences", "compare", "compares", "compared", "comparison", "comparisons", "unterschied", "unterschiede", "unterschieden"]),
    ("global", "stem", ["forschungsrichtung", "themen", "überblick", "landschaft", "insgesamt", "übergreifend", "korpusweit"]),
    ("global", "prefix", ["research direction", "thematic cluster"]),
    ("global", "word", ["across the corpus", "across papers", "corpus-wide", "im korpus", "über den korpus", "themes", "landscape", "big picture", "overall", "trends"]),
    ("local", "stem", ["zitier", "zitat", "methodennetz", "folgearbeit"]),
    ("local", "prefix", ["cite", "citation"]),
    ("local", "word", ["build on", "builds on", "built on", "build upon", "related work", "relate to", "relates to", "related to", "bauen auf", "baut auf", "aufbauen", "verwandte arbeiten", "verwandt mit"]),
    ("basic", "stem", ["abkürzung", "exakt"]),
    ("basic", "word", ["metrik", "metriken"]),
    ("basic", "prefix", ["score", "metric"]),
    ("basic", "word", ["doi", "f1", "exact", "accuracy", "abbreviation"]),
]
STRUCTURAL = ["drift", "global", "local"]


def signal_table(spark: SparkSession) -> DataFrame:
    """``ordinal, mode, signal, pattern``: 69 rows."""
    rows = []
    for mode, kind, texts in SIGNALS:
        for t in texts:
            at = r"(?U)\b" if kind != "stem" else ""
            rows.append((len(rows), mode, t, at + re.escape(t).replace(r"\ ", " ").replace(r"\-", "-") + (r"\b" if kind == "word" else "")))
    return spark.createDataFrame(rows, "ordinal int, mode string, signal string, pattern string")


def route(queries: DataFrame) -> DataFrame:
    """``query_id, mode, confidence, signals`` of queries (``query_id, query``).

    The structural mode with most signals wins (strong); a tie (weak) or none (none) is ``basic``. The signals are those
    of the mode chosen, in their order.
    """
    table = F.broadcast(signal_table(queries.sparkSession))  # a fixed 69 rows
    hits = queries.select("query_id", F.trim(F.lower("query")).alias("q")).join(table, F.expr("q rlike pattern"), "left")
    by_mode = hits.groupBy("query_id", "mode").agg(F.count("signal").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "signal"))), lambda x: x["signal"]).alias("signals"))
    structural = F.col("mode").isin(STRUCTURAL)
    best = by_mode.groupBy("query_id").agg(F.max(F.when(structural, F.col("n"))).alias("best"), F.collect_list(F.when(structural, F.struct("mode", "n", "signals"))).alias("candidates"), F.first(F.when(F.col("mode") == "basic", F.col("signals")), ignorenulls=True).alias("confirming"))
    leaders = F.filter("candidates", lambda c: c["n"] == F.col("best"))
    one = F.get(leaders, F.lit(0))
    strong = F.size(leaders) == 1
    none = F.array().cast("array<string>")
    return best.select(
        "query_id",
        F.when(strong, one["mode"]).otherwise("basic").alias("mode"),
        F.when(strong, "strong").when(F.size(leaders) > 1, "weak").otherwise("none").alias("confidence"),
        F.when(strong, one["signals"]).otherwise(F.coalesce("confirming", none)).alias("signals"),
    )
