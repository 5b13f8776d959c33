"""Incremental ingest: files of a folder to a published snapshot, as one step.

What was read from a file lies below ``root/canonical/run=<run>`` and is never written again; the manifest says which file
in which content gave which paper in which run. A run reads new and changed files only, writes a manifest of its own and
builds a snapshot from what that manifest names; the snapshot's pointer names the manifest, so both are published by one
rename. Until then nothing that a reader sees has changed, and a run that fails takes its files away again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DomainError
from ..functions.text import extract_identifiers
from ..operators import extraction, lexical
from ..sources import readers
from ..sources.sinks import _fs, exists, read_text
from ..streaming.ingest import pending
from . import snapshot

#: Version of what is read from files: another one has every file read again.
VERSION = "1"
MANIFEST = "name string, sha256 string, paper_id string, schema_version string, run string"


def current(spark: SparkSession, root: str) -> str | None:
    """The published manifest's run, None before the first."""
    pointer = read_text(spark, f"{root}/{snapshot.POINTER}")
    return json.loads(pointer).get("manifest") if pointer else None


def read_manifest(spark: SparkSession, root: str, run: str | None) -> DataFrame:
    return spark.createDataFrame([], MANIFEST) if run is None else spark.read.schema(MANIFEST).parquet(f"{root}/manifest={run}")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """``name, path, sha256`` of the full texts and stubs of a folder; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), "path", F.sha2("content", 256).alias("sha256")).filter(F.lower("name").rlike(r"\.(pdf|refjson)$"))


def _contents(files: DataFrame, folder: str) -> DataFrame:
    """``path, sha256, content`` of some files: these alone are opened where they are few."""
    spark = files.sparkSession
    some = [r.path for r in files.select("path").limit(lexical.LITERALS + 1).collect()]
    if not some:
        return spark.createDataFrame([], "path string, sha256 string, content binary")
    names = files.select("path", "sha256")
    if len(some) <= lexical.LITERALS:
        own = spark.read.format("binaryFile").load(some)
    else:
        own = spark.read.format("binaryFile").load(folder)
    return own.select("path", "content").join(names, "path").select("path", "sha256", "content")


def extracted(contents: DataFrame, parse: Callable[[bytes], list[str]], keep) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``papers``, ``chunks`` and ``errors`` (sha256, error) of files (``path, sha256, content``); equal files are one paper, of the first path.

    ``keep`` writes the pages and reads them back, so that each file is parsed once.
    """
    one = contents.groupBy("sha256").agg(F.min("path").alias("path")).join(contents, ["sha256", "path"]).dropDuplicates(["sha256"])
    stub = F.lower("path").endswith(".refjson")
    pages = keep(readers.parse_binary(one.filter(~stub), parse))
    good = pages.filter("error is null")
    front = good.filter("page_number <= 2").groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: x["text"]), "\n").alias("front"))
    uri = F.replace("path", F.lit("%"), F.lit("%25"))  # paths come as they are, addresses are decoded
    papers = good.groupBy("paper_id", uri.alias("source_uri"), "sha256").agg(F.max("page_number").alias("n_pages")).join(front, "paper_id", "left")
    none = F.lit(None).cast(snapshot.BIBLIOGRAPHY)
    papers = papers.select("paper_id", "source_uri", "sha256", F.lit("full").alias("document_kind"), "n_pages", extract_identifiers(F.coalesce("front", F.lit(""))).alias("identifiers"), none.alias("bibliography"))
    chunks = extraction.chunks_of(good.select("paper_id", "page_number", "text")).withColumn("document_kind", F.lit("full"))

    stubs = readers.parse_stubs(one.filter(stub).withColumn("payload", F.col("content").cast("string"))).withColumn("paper_id", F.substring("sha256", 1, 16))
    ids = F.map_filter(F.create_map(F.lit("doi"), F.col("doi"), F.lit("arxiv"), F.col("arxiv_id")), lambda k, v: v != "")
    known = ("title", "authors", "author_ids", "author_orcids", "year", "venue", "url", "source", "requested")
    entries = stubs.filter("error is null").select("paper_id", uri.alias("source_uri"), "sha256", F.lit("reference").alias("document_kind"), F.lit(0).alias("n_pages"), ids.alias("identifiers"), F.struct(*known).cast(snapshot.BIBLIOGRAPHY).alias("bibliography"))
    columns = ["paper_id", "chunk_id", "row_index", "section_id", "section_title", "section_kind", "page_number", "page_end", "text", "char_count", "document_kind"]
    errors = pages.filter("error is not null").select("sha256", "error").unionByName(stubs.filter("error is not null").select("sha256", "error"))
    return papers.unionByName(entries), chunks.select(*columns).unionByName(readers.stub_chunks(stubs).select(*columns)), errors


def run_ingest(spark: SparkSession, folder: str, root: str, parse: Callable[[bytes], list[str]], force: bool = False, **sources: DataFrame | None) -> dict:
    """Bring the snapshot below ``root`` up to date with the files of ``folder``; counts and the files that can't be read.

    New and changed files are read (``parse``: the pages of a PDF), files that are gone or have other content leave no trace.
    Without a change nothing is built, unless ``force`` (as when ``sources``, see ``snapshot.build``, have changed). A file
    that can't be read is reported and tried again by the next run.
    """
    if not exists(spark, folder):
        raise DomainError("not_found", f"no folder {folder}")
    before, run = current(spark, root), uuid.uuid4().hex
    manifest, files = read_manifest(spark, root, before), listing(spark, folder)
    own = f"{root}/canonical/run={run}"
    try:
        files.write.parquet(f"{own}/files")
        files = spark.read.parquet(f"{own}/files")
        new = pending(files, manifest, VERSION)
        kept = manifest.filter(F.col("schema_version") == VERSION).join(files.select("name", "sha256"), ["name", "sha256"], "left_semi")

        def keep(df: DataFrame) -> DataFrame:
            df.write.parquet(f"{own}/pages")
            return spark.read.parquet(f"{own}/pages")

        papers, chunks, errors = extracted(_contents(new, folder), parse, keep)
        for df, name in ((papers, "papers"), (chunks, "chunks"), (errors, "errors")):
            df.write.parquet(f"{own}/{name}")
        papers = spark.read.parquet(f"{own}/papers")
        rows = new.join(papers.select("sha256", "paper_id"), "sha256").select("name", "sha256", "paper_id", F.lit(VERSION).alias("schema_version"), F.lit(run).alias("run"))
        kept.select(*rows.columns).unionByName(rows).write.parquet(f"{root}/manifest={run}")
        after = read_manifest(spark, root, run)
        counts = {"files": files.count(), "extracted": papers.count(), "kept": kept.count(), "removed": manifest.join(after, ["name", "sha256"], "left_anti").count()}
        bad = files.join(spark.read.parquet(f"{own}/errors"), "sha256").select("name", "error").orderBy("name")
        counts["errors"] = {r.name: r.error for r in bad.limit(100).collect()}
        built = force or before is None or counts["extracted"] > 0 or counts["removed"] > 0
        if built:
            live = after.select("run", "paper_id").distinct()
            base = f"{root}/canonical"
            table = lambda name: spark.read.option("basePath", base).parquet(*[f"{base}/run={r.run}/{name}" for r in live.select("run").distinct().collect()]).join(live, ["run", "paper_id"], "left_semi").drop("run")
            if live.isEmpty():
                raise DomainError("invalid_input", "no file gives a paper")
            # a paper that two runs read, as its content came back under another name, counts once
            snapshot.build(spark, root, table("chunks").dropDuplicates(["chunk_id"]), table("papers").dropDuplicates(["paper_id"]), extra={"manifest": run}, **sources)
    except BaseException:
        for path in (own, f"{root}/manifest={run}"):
            _drop(spark, path)
        raise
    _drop_unused(spark, root, run if built else before)
    return {**counts, "built": built}


def _drop(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _drop_unused(spark: SparkSession, root: str, run: str) -> None:
    """Delete manifests but the published one, and what runs read that it doesn't name."""
    used = {r.run for r in read_manifest(spark, root, run).select("run").distinct().collect()}  # a run is a call of this function
    for base, wanted, prefix in ((root, {run}, "manifest="), (f"{root}/canonical", used, "run=")):
        fs, p = _fs(spark, base)
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if name.startswith(prefix) and name.removeprefix(prefix) not in wanted:
                fs.delete(s.getPath(), True)
