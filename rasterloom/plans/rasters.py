"""Images derived from the driver's embeddings, alike in Spark and in SQL.

R1: one gray 8 x 8 image per vector. R2: one BGR 8 x 8 image per three vectors. R3: one gray
64 x 64 mosaic per 64 vectors. Only complete images count in R2 and R3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    level = F.floor(F.least(F.greatest((F.col("e").cast("double") + 0.5) * 255, F.lit(0.0)), F.lit(255.0))).cast("int")
    return vectors.select(F.col("vec_id").alias("img"), F.expr("cast(i div 8 as int)").alias("y"), (F.col("i") % 8).cast("int").alias("x"), level.alias("v"))


def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = r1(spark, sf_dir).select(F.expr("cast(img div 3 as int)").alias("img"), (F.col("img") % 3).alias("c"), "y", "x", "v")
    channel = lambda c: F.max(F.when(F.col("c") == c, F.col("v")))
    return planes.groupBy("img", "y", "x").agg(channel(0).alias("b"), channel(1).alias("g"), channel(2).alias("r")).where("b is not null and g is not null and r is not null")


def r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = r1(spark, sf_dir)
    whole = small.groupBy(F.expr("cast(img div 64 as int)").alias("mosaic")).agg(F.count("*").alias("n")).where("n = 4096").select("mosaic")
    placed = small.select(F.expr("cast(img div 64 as int)").alias("mosaic"), F.expr("cast((img % 64) div 8 * 8 + y as int)").alias("y"), F.expr("cast((img % 8) * 8 + x as int)").alias("x"), "v")
    return placed.join(whole, "mosaic", "left_semi").withColumnRenamed("mosaic", "img")


_SQL = {
    "r1": "r1 AS (SELECT vec_id AS img, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, CAST(floor(least(greatest((CAST(e AS DOUBLE) + 0.5) * 255, 0), 255)) AS INT) AS v "
    "FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))",
    "r2": "r2 AS (SELECT CAST(img // 3 AS INT) AS img, y, x, max(v) FILTER (img % 3 = 0) AS b, max(v) FILTER (img % 3 = 1) AS g, max(v) FILTER (img % 3 = 2) AS r "
    "FROM r1 GROUP BY 1, 2, 3 HAVING count(DISTINCT r1.img) = 3)",
    "r3": "r3 AS (SELECT CAST(img // 64 AS INT) AS img, CAST((img % 64) // 8 * 8 + y AS INT) AS y, CAST((img % 8) * 8 + x AS INT) AS x, v FROM r1 "
    "WHERE img // 64 IN (SELECT img // 64 FROM r1 GROUP BY 1 HAVING count(*) = 4096))",
}


def sql(raster: str, body: str) -> str:
    """A statement over a raster: ``body`` may begin with further common tables."""
    tables = [_SQL["r1"]] + ([_SQL[raster]] if raster != "r1" else [])
    recursive = body.startswith("RECURSIVE ")
    body = body.removeprefix("RECURSIVE ")
    return f"WITH {'RECURSIVE ' * recursive}" + ", ".join(tables) + (", " + body if not body.startswith("SELECT") else " " + body)
