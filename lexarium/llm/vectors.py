"""Vectors as rows of bytes: what the vector operators of this subpackage share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialise, pick


def sound(vector: Column) -> Column:
    """Whether a vector is there, with no component null, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def squared_norm(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda sum_, x: sum_ + x.cast("double") * x.cast("double"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as rows of ``dim`` doubles, missing places zero."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def unpacked(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of a binary column of equal lengths, as an array of ``kind``."""
    return np.array([np.frombuffer(b, kind) for b in column.to_pylist()])


def packed(vectors: DataFrame, dim: int, kind: str) -> DataFrame:
    """``vec_id, digest, vec`` of ``vec_id, vector`` and further columns: components as bytes of ``kind``, equal rows of a batch once.

    A negative zero counts as zero.
    """
    rest = [f for f in vectors.schema.fields if f.name != "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r.tobytes() for r in (matrix(batch.column("vector"), dim) + 0.0).astype(kind)]
            own = list(zip(*(batch.column(f.name).to_pylist() for f in rest), rows, strict=True))
            first = sorted({x: i for i, x in reversed(list(enumerate(own)))}.values())
            digests = pa.array([hashlib.blake2b(rows[i], digest_size=16).digest() for i in first], pa.binary())
            kept = [batch.column(f.name).take(pa.array(first, pa.int64())) for f in rest]
            yield pa.RecordBatch.from_arrays([*kept, digests, pa.array([rows[i] for i in first], pa.binary())], names=[*(f.name for f in rest), "digest", "vec"])

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest)
    return vectors.mapInArrow(run, f"{columns}, digest binary, vec binary")


def single(rows: DataFrame, *order: str) -> DataFrame:
    """``rows``, a written table, with one vector for each vec_id: the first by ``order``; ids move alone, and only repeated ones are looked up."""
    best = F.struct(*order)
    twice = rows.groupBy("vec_id").agg(F.min(best).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    twice = materialise(twice, "repeated-ids")
    if twice.isEmpty():
        return rows
    known = lookup(rows, twice, "vec_id", F.xxhash64("digest"), how="left")
    again = known.filter(F.col("first") == best).dropDuplicates(["vec_id"])
    return known.filter("first is null").unionByName(again).drop("first")


def usable(embeddings: DataFrame, **columns: str) -> DataFrame:
    """``vec_id, vector`` and further named columns of the rows with an id and a sound vector."""
    rows = pick(embeddings, **columns)
    return rows.filter(F.col("vec_id").isNotNull() & sound(F.col("vector")))
