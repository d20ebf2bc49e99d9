"""Watching a folder of scans: each new file is cleaned once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rasterloom.sources.images import EXTENSIONS, map_images

_SCHEMA = "image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of packed images from files that appear in a folder; what is no image is left out."""
    glob = "*.{" + ",".join(e for x in EXTENSIONS for e in (x, x.upper())) + "}"
    raw = spark.readStream.schema(_SCHEMA).format("image").option("pathGlobFilter", glob).load(folder)
    good = raw.where("image.height > 0")
    return good.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def clean_new(spark: SparkSession, folder: str, kernel: Callable[[np.ndarray], np.ndarray], out: str, checkpoint: str) -> StreamingQuery:
    """Clean all files that have come since the last run and stop; results are packed rows in Parquet."""
    cleaned = map_images(watch(spark, folder), kernel)
    return cleaned.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
