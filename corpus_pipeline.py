"""The corpus pipeline: quality rules, near-duplicates, decontamination, secret scans, mixing to target weights."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm.common import BROADCAST_ROWS, discard, materialise, scratch, scratch_folder
from lexarium.llm.decontaminate import drop_contaminated
from lexarium.llm.mixing import mix
from lexarium.llm.near_dup import near_duplicates
from lexarium.llm.quality import quality_rules
from lexarium.llm.queries import MIX_WEIGHTS, domain_of_source
from lexarium.llm.secret_scan import redact_secrets

#: The columns that stages work on; others are carried along under names of their own.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _plain(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with distinct names whatever they were, and the names to give back."""
    names = docs.columns
    return docs.toDF(*[n if n in COLUMNS else f"_other{i}" for i, n in enumerate(names)]), names


def _without(docs: DataFrame, gone: DataFrame, on: str) -> DataFrame:
    """``docs`` without the rows of the distinct keys ``gone``: where they are, if the keys are few, else by a shuffle."""
    gone = materialise(gone.distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, on, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Rows of one content share a verdict, whatever their ids; a null text fails. An empty table gives no rows.
    """
    plain, names = _plain(docs)
    own = ["doc_id", "text", "lang", "source"]
    keyed = plain.withColumn("_row", F.struct(F.xxhash64(*own).alias("a"), F.xxhash64(F.lit(7), *own).alias("b")))
    rejected = quality_rules(keyed, id_col="_row").filter("not kept").select("_row")
    return _without(keyed, rejected, "_row").drop("_row").toDF(*names)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id.

    Of rows that share an id one stays, the first by a hash of its text. Rows without an id stay. An empty table gives no rows.
    """
    plain, names = _plain(docs)
    kept = _without(plain, near_duplicates(plain).filter("not kept").select("doc_id"), "doc_id").select(*plain.columns)
    again = materialise(plain.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").select("doc_id"), "again")
    if again.isEmpty():
        return kept.toDF(*names)
    few = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    firsts = kept.join(few, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*plain.columns), F.xxhash64("text")).alias("row")).select("row.*")
    return kept.join(few, "doc_id", "left_anti").select(*plain.columns).unionByName(firsts).toDF(*names)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a test item. A null text has none; beside an empty benchmark all stay."""
    plain, names = _plain(docs)
    return drop_contaminated(plain, spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet"))).toDF(*names)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark. A null text stays null; an empty table gives no rows."""
    plain, names = _plain(docs)
    return redact_secrets(plain, length_col="n_chars").toDF(*names)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Which documents the training mixture uses, and how often. Documents without a word are never used; an empty table gives no rows."""
    return mix(docs, domain_of_source(), MIX_WEIGHTS)


STAGES = [("quality rules", quality), ("near duplicates", near_dup), ("decontamination", decontaminate), ("secret scans", secrets), ("mixing", mixture)]
#: SQL can't express the estimates, alignments and seeded orders of the stages; they are tested by themselves.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written and read again; what a stage wrote for itself goes with it."""
    docs, before = spark.read.parquet(os.path.join(sf_dir, "documents.parquet")), None
    for name, stage in STAGES:
        path = scratch(spark, name.replace(" ", "-"))
        with scratch_folder(spark, "stage"):
            docs = materialise(stage(spark, docs, sf_dir), name, path)
        if before is not None:
            discard(before)
        before = docs
    return docs
