"""Shared pieces of the training-data operators: cut lineage, exact connected components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Mixed into join keys so that both sides of a skewed join are exchanged for that join alone.
#: A side that reuses the partitioning of an aggregation cannot be split by adaptive execution.
_REKEY = 0x5DEECE66D


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests, local mode) a temporary folder is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path of its own below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove what was written below the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bound_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches of some MB, so that long texts do not add up to large ones.

    Spark reads these settings when a query runs, after the query's function has returned, so they
    stay set in the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def give_back() -> None:
    """Return freed memory of this Python worker to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, where a lost executor cannot take it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def rekey(column: Column) -> Column:
    """A bigint key under another name for Catalyst, equal where the key is equal."""
    return column.bitwiseXOR(F.lit(_REKEY))


def join_on_hot_key(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on a bigint ``key`` of which one value may hold a large part of ``left``.

    Both sides get an exchange of their own, so that adaptive execution can split the hot
    partition of ``left``; ``right`` must hold each key once. Null keys match nothing.
    """
    other = right.withColumnRenamed(key, "__key")
    return left.join(other, rekey(F.col(key)) == rekey(F.col("__key")), how).drop("__key")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a bigint, b bigint)`` as ``(node, root)``, root the smallest node.

    Alternates large-star and small-star contraction (Kiveris et al., 2014), which ends after a
    logarithmic number of rounds in practice. All state stays in DataFrames; each round is
    checkpointed to the shared folder. Minima are aggregated map-side, and the join that hands
    a minimum to the neighbours of a hub can be split. Self loops and null ends are ignored,
    so isolated nodes are not in the result. An empty table gives an empty table.
    """
    own = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    own, before = cut(own), None
    for _ in range(max_rounds):
        now = own.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] == 0 or (now["n"], now["h"]) == before:
            break
        before = (now["n"], now["h"])
        both = own.union(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = join_on_hot_key(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_on_hot_key(large, least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        own = cut(small.distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return own.select(F.col("u").alias("node"), F.col("v").alias("root")).union(own.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
