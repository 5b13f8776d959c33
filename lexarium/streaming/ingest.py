"""Incremental ingest: files that are new or changed, derived data that lost its source, an inbox as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MANIFEST_SCHEMA = "name string, sha256 string, paper_id string, schema_version string"


def pending(files: DataFrame, manifest: DataFrame, schema_version: str) -> DataFrame:
    """Files (``name, sha256``) that the manifest doesn't have in this content and version."""
    done = manifest.filter(F.col("schema_version") == schema_version).select("name", "sha256")
    return files.join(done, ["name", "sha256"], "left_anti")


def stale(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``paper_id`` of papers that no present file (``name, sha256``) gives any more."""
    alive = manifest.join(files, ["name", "sha256"], "left_semi").select("paper_id")
    return manifest.select("paper_id").distinct().join(alive, "paper_id", "left_anti")


def watch(spark: SparkSession, inbox: str, checkpoint: str, handle: Callable[[DataFrame, int], None], glob: str = "*") -> StreamingQuery:
    """Files of a folder as a stream: ``handle`` gets each batch (``path, sha256, content``) once; ends when all are handled."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(inbox)
    rows = stream.select("path", F.sha2("content", 256).alias("sha256"), "content")
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events by type and time window; works on a stream (late events up to ``late`` count) and on a table."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
