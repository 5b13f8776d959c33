"""The state of a corpus, read only: what is published, what it holds, and where folder, manifest and stored papers differ."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.sinks import _fs, exists, read_text
from . import ingest, snapshot

#: Names that a report lists of each finding; the counts are whole.
SHOWN = 100


def findings(files: DataFrame, manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """``finding, name``: files (``name``) that the manifest doesn't have, its entries (``name, paper_id``) without a file, its papers that aren't stored (``paper_id``), and stored ones that it doesn't name."""
    parts = (
        ("untracked_file", files.select("name"), manifest.select("name")),
        ("missing_file", manifest.select("name"), files.select("name")),
        ("missing_paper", manifest.select("paper_id"), stored.select("paper_id")),
        ("orphan_paper", stored.select("paper_id"), manifest.select("paper_id")),
    )
    out = None
    for kind, these, those in parts:
        rows = these.toDF("name").distinct().join(those.toDF("name").distinct(), "name", "left_anti").select(F.lit(kind).alias("finding"), "name")
        out = rows if out is None else out.unionByName(rows)
    return out


def _names(spark: SparkSession, folder: str | None) -> DataFrame:
    """Names of a folder's full texts and stubs; no content is read."""
    if folder is None or not exists(spark, folder):
        return spark.createDataFrame([], "name string")
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return files.filter(F.lower("name").rlike(r"\.(pdf|refjson)$"))


def _counts(spark: SparkSession, base: str) -> dict:
    """Counts of a snapshot's tables, None of those that it lacks; one aggregate a table."""
    has_ids = F.exists(F.map_values("identifiers"), lambda v: v != "")
    filled = (F.coalesce("title", F.lit("")) != "") & (F.coalesce("year", F.lit(0)) > 0) & (F.size(F.coalesce("authors", F.array().cast("array<string>"))) > 0)
    n = F.count("*")
    wanted = {
        "papers": {"n_papers": n, "n_identified": F.count_if(has_ids), "n_reference_entries": F.count_if(F.col("document_kind") == "reference")},
        "chunks": {"n_chunks": n},
        "communities": {"n_communities": n},
        "citation_edges": {"n_citation_edges": n},
        "paper_metadata": {"n_citable": F.count_if(filled), "n_weak_metadata": F.count_if(F.col("confidence") == "weak")},
        "paper_authors": {"n_author_rows": n, "n_persons": F.count_distinct("person_key")},
    }
    out: dict = {}
    for table, counts in wanted.items():
        if exists(spark, f"{base}/{table}"):
            out |= spark.read.parquet(f"{base}/{table}").agg(*[c.alias(k) for k, c in counts.items()]).first().asDict()
        else:
            out |= dict.fromkeys(counts)
    return out


def status(spark: SparkSession, root: str, folder: str | None = None) -> dict:
    """What is published below ``root`` (None: nothing), its counts, and findings on its manifest against ``folder`` and the stored papers.

    Nothing is written. Findings have a count each and up to SHOWN names in order.
    """
    pointer = json.loads(read_text(spark, f"{root}/{snapshot.POINTER}") or "null")
    out: dict = {"published": pointer["snapshot"] if pointer else None, "schema_version": pointer["schema_version"] if pointer else None}
    manifest = ingest.read_manifest(spark, root, pointer.get("manifest") if pointer else None)
    files = _names(spark, folder)
    stored = spark.createDataFrame([], "paper_id string")
    if pointer:
        base = f"{root}/snapshot={pointer['snapshot']}"
        out |= _counts(spark, base)
        stored = spark.read.parquet(f"{base}/papers").select("paper_id")
    place = F.row_number().over(Window.partitionBy("finding").orderBy("name"))
    rows = findings(files, manifest, stored)
    named: dict[str, list[str]] = {}
    for r in rows.withColumn("place", place).filter(F.col("place") <= SHOWN).orderBy("finding", "place").collect():
        named.setdefault(r.finding, []).append(r.name)
    found = {r.finding: {"n": r.n, "names": named[r.finding]} for r in rows.groupBy("finding").agg(F.count("*").alias("n")).collect()}
    fs, path = _fs(spark, root)
    kept = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return out | {"n_files": files.count(), "n_manifest": manifest.count(), "n_snapshots": sum(x.startswith("snapshot=") for x in kept), "findings": found}
