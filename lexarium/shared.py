"""Tables that a job writes for itself: in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lexarium-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str = "kept") -> DataFrame:
    """``df`` written and read back: its lineage is cut, and lost executors don't matter."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    was = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


#: Shuffle files of a write go when it is done.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def discard(*frames: DataFrame) -> None:
    """Remove what ``keep`` wrote, once nothing reads it any more; tables that others wrote stay."""
    for df in frames:
        if path := getattr(df, "kept_path", None):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def keep_by(df: DataFrame, key: str, label: str = "kept", dealt: bool = False) -> DataFrame:
    """As ``keep``, but dealt and sorted by ``key``, which Spark knows of what is read back: joins and groups by ``key`` move no row of it. What is ``dealt`` so already is written where it lies."""
    spark = df.sparkSession
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df if dealt else df.repartition(n, key)).write.bucketBy(n, key).sortBy(key).option("path", fresh_path(spark, label)).saveAsTable(name)
    return spark.table(name)


def numbered(rows: DataFrame, key: str, name: str = "number") -> DataFrame:
    """``rows`` with their places in the order of ``key`` (distinct), from 1: ranges of keys are sorted and written each by a task, with their places; the rows of the ranges before are added when they are read."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id())  # range, and place in it
    placed = keep(placed, "numbered")
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dict(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each range
    before = [0]
    for i in range(max(sizes, default=0)):
        before.append(before[-1] + sizes.get(i, 0))
    return placed.withColumn(name, F.get(F.array(*[F.lit(b).cast("long") for b in before]), part.cast("int")) + at + 1).drop("_at")
