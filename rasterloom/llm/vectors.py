"""Vectors in tiles: bounded blocks of rows as one matrix each, for exact work on pairs of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a tile; groups with more are split by a hash.
TILE = 2048
#: Vectors that rotations, trees and pivots are fitted on.
SAMPLE = 8192


def usable(column: str) -> Column:
    """Whether a vector is there, not empty, and without null or non-finite components."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & fine, F.lit(False))


def sample(rows: DataFrame, vector: str, dim: int, most: int = SAMPLE) -> np.ndarray:
    """At most ``most`` vectors of one length, chosen by a hash of their components."""
    picked = rows.where(F.size(vector) == dim).select(vector).orderBy(F.xxhash64(vector)).limit(most).collect()
    return np.array([r[0] for r in picked], dtype=np.float64).reshape(-1, dim)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of vectors of one length as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def tiles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group of ``rows(*keys, id, vector)``: ids and vectors in one order, as binaries.

    Groups must be bounded: callers split large ones by :func:`split_column` first.
    """

    def build(table: pa.Table) -> pa.Table:
        ids = [-1 if i is None else i for i in table.column("id").to_pylist()]
        vectors = table.column("vector").combine_chunks()
        body = matrix(vectors, len(vectors[0]))
        order = np.lexsort((*body.T[:4], np.array(ids)))
        out = {k: table.column(k)[:1].combine_chunks() for k in keys}
        out["ids"] = pa.array([table.column("id").take(pa.array(order)).to_pylist()], pa.list_(pa.int64()))
        out["dim"] = pa.array([body.shape[1]], pa.int32())
        narrow = narrowest(body)
        out["kind"] = pa.array([narrow], pa.string())
        out["body"] = pa.array([body[order].astype(narrow).tobytes()], pa.binary())
        return pa.Table.from_pydict(out)

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", ids array<bigint>, dim int, kind string, body binary"
    return rows.select(*keys, F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).groupBy(*keys).applyInArrow(build, schema)


def split_column(counts: dict[int, int], key: str, size: int = TILE) -> Column:
    """The number of the part, of about ``size`` rows, that a row of group ``key`` falls in.

    Rows are dealt by their place in the table, so equal rows part as well; the table must lie in
    checkpointed files, where places stay.
    """
    spark_map = F.create_map(*(F.lit(x) for k, n in counts.items() if n > size for x in (k, -(-n // size)))) if any(n > size for n in counts.values()) else None
    parts = F.coalesce(F.element_at(spark_map, F.col(key)), F.lit(1)) if spark_map is not None else F.lit(1)
    return F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), parts.cast("long")).cast("int")


def narrowest(body: np.ndarray) -> str:
    """The smallest type that holds the values exactly."""
    for kind in ("<i2", "<f4"):
        with np.errstate(invalid="ignore", over="ignore"):
            if (body.astype(kind) == body).all():
                return kind
    return "<f8"


def unpack(body: bytes, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(body, dtype=kind).reshape(-1, dim).astype(np.float64)


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time: each holds matrices."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
