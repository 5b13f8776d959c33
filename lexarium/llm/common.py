"""Helpers shared by the training-data operators of this subpackage."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the control characters 9 to 13.
WHITE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of our own in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lexarium-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Folders that scratch files go to, innermost last (see ``scratch_folder``).
_folders: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, or below the innermost open ``scratch_folder``."""
    base = _folders[-1] if _folders else shared_dir(spark).rstrip("/")
    return f"{base}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scratch_folder(spark: SparkSession, label: str) -> Iterator[str]:
    """All that is materialised inside goes when the block ends: what it returns must be written elsewhere by then."""
    path = scratch(spark, label)
    _folders.append(path)
    try:
        yield path
    finally:
        _folders.remove(path)
        remove(spark, path)


#: Shuffle files of a finished write go at once: nothing reads them again.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, and survives lost executors.

    The files stay until ``discard``, the end of the ``scratch_folder`` or the cluster's policy for spark.checkpoint.dir removes them.
    """
    spark = df.sparkSession
    path = path or scratch(spark, label)
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove what ``materialise`` wrote, once nothing reads it any more."""
    for df in frames:
        remove(df.sparkSession, df.scratch_path)


#: Rows that a counted table may have to be broadcast, and copies of a larger one's rows that its keys are spread over.
BROADCAST_ROWS, SPREAD = 200_000, 64


def lookup(rows: DataFrame, state: DataFrame, on: str, salt: Column, how: str = "inner", n: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``state``, a written table of one row for each key ``on``; ``n`` of them, counted if not given.

    Up to BROADCAST_ROWS rows are broadcast. A larger table has each row SPREAD times, and ``rows`` go to one of the
    copies by ``salt`` (any hash that differs between rows of a key), so that no key is one task.
    """
    if (state.count() if n is None else n) <= BROADCAST_ROWS:
        return rows.join(F.broadcast(state), on, how)
    copies = state.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return rows.withColumn("_salt", F.pmod(salt, F.lit(SPREAD)).cast("int")).join(copies, [on, "_salt"], how).drop("_salt")


#: Keys that a join sets apart, and rows below which none is.
HEAVY_KEYS, HEAVY_ROWS = 20_000, 1_000


def spread_join(rows: DataFrame, side: DataFrame, on: list[str], n_rows: int, size: str = "size", how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side``, a table of one row for each key, its column ``size`` the number of ``rows`` with that key.

    Keys of more than ``n_rows`` / HEAVY_KEYS rows are HEAVY_KEYS at most, so those are broadcast and their rows stay where
    they are; the others are shuffled, and none has more than that share. Both inputs should be written tables.
    """
    heavy = F.col(size) > max(HEAVY_ROWS, n_rows / HEAVY_KEYS)
    if side.filter(heavy).isEmpty():
        return rows.join(side, on, how)
    few, many = F.broadcast(side.filter(heavy)), side.filter(~heavy)
    return rows.join(few, on).unionByName(rows.join(few.select(*on), on, "left_anti").join(many, on, how))


def pick(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """The named columns alone, found by exact case, so that further columns of clashing names don't matter."""
    wanted = {**{n: n for n in names}, **{new: old for new, old in renamed.items()}}
    columns = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(columns))])
    return plain.select(*[F.col(f"_c{columns.index(old)}").alias(new) for new, old in wanted.items()])


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def let(value: Column, body) -> Column:
    """``body`` of a lambda variable bound to ``value``, so that ``value`` is evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
