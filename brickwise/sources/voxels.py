"""Voxel views of tables that hold one brick of values per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwise.functions.codec import encode_sdf
from brickwise.sources.tables import table

EDGE = 4
GRID = 8
CLIP = 0.25


def voxels(spark: SparkSession, folder: str) -> DataFrame:
    """(vec_id, label, z, y, x, v): the 64 values of each ``embeddings`` row as a brick of 4 x 4 x 4 voxels.

    Bricks lie in rows of eight along x, eight rows along y, and layers along z.
    """
    rows = table(spark, folder, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "value"))
    return rows.select(
        "vec_id", "label",
        (F.floor(F.col("vec_id") / (GRID * GRID)) * EDGE + F.floor(F.col("pos") / (EDGE * EDGE))).cast("int").alias("z"),
        (F.floor(F.col("vec_id") / GRID) % GRID * EDGE + F.floor(F.col("pos") / EDGE) % EDGE).cast("int").alias("y"),
        (F.col("vec_id") % GRID * EDGE + F.col("pos") % EDGE).cast("int").alias("x"),
        F.col("value").cast("double").alias("v"),
    )


#: The same view in DuckDB, as the first common table expression of a query.
VOXELS_SQL = """
vox AS (
  SELECT vec_id, label, CAST(vec_id // 64 * 4 + pos // 16 AS INT) AS z, CAST(vec_id // 8 % 8 * 4 + pos // 4 % 4 AS INT) AS y,
    CAST(vec_id % 8 * 4 + pos % 4 AS INT) AS x, CAST(value AS DOUBLE) AS v
  FROM (SELECT vec_id, label, unnest(embedding) AS value, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
), coded AS (
  SELECT *, CAST(least(255.0, greatest(1.0, round_even(128 + greatest(-0.25::DOUBLE, least(0.25::DOUBLE, v)) * (127.0::DOUBLE / 0.25::DOUBLE),
  0))) AS INT) AS u,
    CASE WHEN label % 5 = 0 THEN 0 WHEN label % 5 = 4 THEN 2 ELSE 1 END AS valid
  FROM vox
)"""


def coded_voxels(spark: SparkSession, folder: str) -> DataFrame:
    """Voxels with the signed-distance byte ``u`` of their value and a three-valued validity by label."""
    valid = F.when(F.col("label") % 5 == 0, 0).when(F.col("label") % 5 == 4, 2).otherwise(1)
    return voxels(spark, folder).withColumn("u", encode_sdf(F.col("v"), CLIP)).withColumn("valid", valid)
