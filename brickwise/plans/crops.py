"""Queries on crops with all their targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwise.operators import crops, grid
from brickwise.plans.catalog import register
from brickwise.plans.winding import CENTRE, PRIOR_SQL, winding_rows
from brickwise.runtime import materialize, shuffled
from brickwise.sources.tables import table
from brickwise.sources.voxels import VOXELS_SQL, coded_voxels

AXES = list(grid.AXES)
PATCH, CORE = 6, 4.0


@register("crop_targets", f"""WITH {VOXELS_SQL}, {PRIOR_SQL},
p AS (SELECT p_partkey AS crop, p_size % 20 AS lz, p_partkey % 29 AS ly, p_partkey * 5 % 27 AS lx FROM part),
r AS (SELECT pr.*, coded.u AS ct, coded.label, (sdf_in - 128) * (20.0::DOUBLE / 127.0::DOUBLE) AS a, (sdf_out - 128) * (20.0::DOUBLE / 127.0::DOUBLE) AS b,
  sqrt((y - {CENTRE})**2 + (x - {CENTRE})**2) < {CORE} AS core, CASE WHEN label % 4 = 0 THEN 0 ELSE ct END AS w FROM pr JOIN coded USING (z, y, x)),
t AS (SELECT *, CASE WHEN faces_valid > 0 THEN least(abs(a), abs(b)) ELSE 0 END AS side, CASE WHEN faces_valid > 0 AND a > 0 AND b < 0 THEN 1.0::DOUBLE
  ELSE 0 END AS inside,
  CASE WHEN core AND faces_valid > 0 THEN 2 ELSE faces_valid END AS sv, CASE WHEN w > 0 THEN w ELSE 1 END AS weight, label % 2 = 1 AS fine, CASE WHEN core
  THEN 0 WHEN label % 2 = 1 THEN 1
  ELSE pv END AS wv, CASE WHEN label % 2 = 1 THEN sin(ct) ELSE p_s END AS sine FROM r)
SELECT crop, sv AS surface_valid, count(*) AS n, round(sum(ct / 255.0::DOUBLE), 6) AS ct, round(sum(side), 6) AS side, CAST(sum(inside) AS BIGINT) AS inside,
  CAST(sum(weight) AS BIGINT) AS weight, CAST(sum(wv) AS BIGINT) AS winding_valid, round(sum(sine), 6) AS winding_sine, CAST(sum(z - lz) AS BIGINT) AS moment
FROM t JOIN p ON z >= lz AND z < lz + {PATCH} AND y >= ly AND y < ly + {PATCH} AND x >= lx AND x < lx + {PATCH} GROUP BY 1, 2""")
def crop_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Many crops with intensity, unordered surface targets, weights and a winding that is fine where it can be and coarse elsewhere, summed by crop and validity."""
    own = coded_voxels(spark, folder).select(*AXES, F.col("u").alias("ct"), "label")
    rows = winding_rows(spark, folder).join(shuffled(own), AXES)
    rows = materialize(rows.withColumn("faces_weight", F.when(F.col("label") % 4 == 0, 0).otherwise(F.col("ct"))), "crop-rows")
    fine = {"valid": (F.col("label") % 2).cast("int"), "sine": F.sin("ct")}
    wound = crops.merged_winding(fine, {"valid": F.col("prior_valid"), "sine": F.col("prior_sine")}, "merge")
    core = F.hypot(F.col("y") - CENTRE, F.col("x") - CENTRE) < CORE
    key = F.col("p_partkey")
    asked = table(spark, folder, "part").select(key.alias("crop"), (F.col("p_size") % 20).cast("int").alias("low_z"), (key % 29).cast("int").alias("low_y"),
        (key * 5 % 27).cast("int").alias("low_x"))
    found = crops.load_crops(asked, rows, PATCH, "sides", wound, core, 8)
    total = lambda c: F.round(F.sum(c), 6)
    return found.groupBy("crop", "surface_valid").agg(F.count(F.lit(1)).alias("n"), total("ct").alias("ct"), total("target_side").alias("side"),
        F.sum("inside").cast("long").alias("inside"), F.sum("weight").cast("long").alias("weight"), F.sum("winding_valid").alias("winding_valid"),
        total("winding_sine").alias("winding_sine"), F.sum("z").alias("moment"))
