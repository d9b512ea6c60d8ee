"""Queries on components' sizes, grey modes, soft skeletons and class directions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwise.functions import vectors
from brickwise.operators import grid, stencil
from brickwise.plans.catalog import register
from brickwise.plans.encoding import _TRIPLES_SQL, triples
from brickwise.plans.volumes import _CC_SQL, _labelled
from brickwise.sources.voxels import VOXELS_SQL, coded_voxels

AXES = list(grid.AXES)


@register("component_stats", _CC_SQL + """ SELECT count(*) AS n, count(*) FILTER (WHERE size >= 3) AS n_large, max(size) AS largest,
  CAST(sum(size) AS BIGINT) AS voxels, array_to_string(list_slice(list(size ORDER BY size DESC), 1, 10), ',') AS top FROM sizes""")
def component_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Number and sizes of 26-connected components: sizes are counted before they are listed, so the list is short."""
    sizes = _labelled(coded_voxels(spark, folder).where("u > 205")).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    top = sizes.orderBy(F.desc("size")).limit(10).agg(F.array_join(F.transform(F.sort_array(F.collect_list("size"), asc=False), lambda s: s.cast("string")),
        ",").alias("top"))
    stats = sizes.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("size") >= 3, 1)).alias("n_large"), F.max("size").alias("largest"),
        F.sum("size").alias("voxels"))
    return stats.crossJoin(F.broadcast(top))  # one row each


def _two_means_sql(rounds: int) -> str:
    """Rounds of two-means on the histogram ``h``; the nearer mode takes a code, the lower one if both are as near."""
    out = "m0 AS (SELECT min(u)::DOUBLE AS low, max(u)::DOUBLE AS high FROM h)"
    near = "abs(u - low) <= abs(u - high)"
    for k in range(rounds):
        mean = lambda w: f"sum(n * u) FILTER (WHERE {w})::DOUBLE / sum(n) FILTER (WHERE {w})"  # noqa: B023, E731
        out += f", m{k + 1} AS (SELECT {mean(near)} AS low, coalesce({mean(f'NOT ({near})')}, max(high)) AS high FROM h, m{k})"
    return out


@register("grey_modes", f"""WITH {VOXELS_SQL}, h AS (SELECT u, count(*) AS n FROM coded GROUP BY u), {_two_means_sql(10)}
SELECT 'low' AS mode, round(m10.low, 6) AS value, CAST((SELECT sum(n) FROM h, m9 WHERE abs(u - low) <= abs(u - high)) AS BIGINT) AS n FROM m10
UNION ALL SELECT 'high', round(m10.high, 6), CAST((SELECT sum(n) FROM h, m9 WHERE abs(u - low) > abs(u - high)) AS BIGINT) FROM m10""")
def grey_modes(spark: SparkSession, folder: str) -> DataFrame:
    """Two modes of the codes by ten rounds of two-means on their histogram of 256 bins at most."""
    hist = coded_voxels(spark, folder).groupBy("u").agg(F.count(F.lit(1)).alias("n")).orderBy("u").collect()
    value, count = np.array([r["u"] for r in hist], dtype=float), np.array([r["n"] for r in hist], dtype=float)
    low, high = value.min(), value.max()
    for _ in range(10):
        near = np.abs(value - low) <= np.abs(value - high)
        low = np.average(value[near], weights=count[near])
        high = np.average(value[~near], weights=count[~near]) if (~near).any() else high
    return spark.createDataFrame([("low", round(float(low), 6), int(count[near].sum())), ("high", round(float(high), 6), int(count[~near].sum()))],
        "mode string, value double, n long")


@register("soft_skeleton_step", f"""WITH {VOXELS_SQL}, e AS (SELECT a.z, a.y, a.x, a.u, min(b.u) AS low FROM coded a JOIN coded b ON b.z BETWEEN a.z - 1
  AND a.z + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY 1, 2, 3, 4),
o AS (SELECT a.z, a.y, a.x, a.u, max(b.low) AS opened FROM e a JOIN e b ON b.z BETWEEN a.z - 1 AND a.z + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1
  AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY 1, 2, 3, 4)
SELECT z, CAST(sum(greatest(0, u - opened)) AS BIGINT) AS total, count(*) FILTER (WHERE u > opened) AS n FROM o GROUP BY z""")
def soft_skeleton_step(spark: SparkSession, folder: str) -> DataFrame:
    """What an opening of the codes takes away: one step of a soft skeleton."""
    eroded = stencil.neighbour_extreme(coded_voxels(spark, folder).select(*AXES, "u"), "u", 1, False, "low")
    opened = stencil.neighbour_extreme(eroded, "low", 1, True, "opened")
    return opened.groupBy("z").agg(F.sum(F.greatest(F.lit(0), F.col("u") - F.col("opened"))).alias("total"), F.count(F.when(F.col("u") > F.col("opened"),
        1)).alias("n"))


@register("class_direction", f"""WITH {_TRIPLES_SQL}, p AS (SELECT label, abs(a) AS pv, abs(b) AS ph FROM tri)
SELECT label, round(sum(pv / sqrt(pv*pv + ph*ph)), 6) AS along_v, round(sum(ph / sqrt(pv*pv + ph*ph)), 6) AS along_h, round(avg(greatest(pv, ph)),
  6) AS strength FROM p GROUP BY label""")
def class_direction(spark: SparkSession, folder: str) -> DataFrame:
    """Direction and strength from two class probabilities along two fixed axes."""
    pv, ph = F.abs("a"), F.abs("b")
    axis = lambda k: tuple(F.lit(1.0 if i == k else 0.0) for i in range(3))
    d, strength = vectors.class_direction(pv, ph, axis(0), axis(1))
    rows = triples(spark, folder).select("label", d[0].alias("v"), d[1].alias("h"), strength.alias("s"))
    return rows.groupBy("label").agg(F.round(F.sum("v"), 6).alias("along_v"), F.round(F.sum("h"), 6).alias("along_h"), F.round(F.avg("s"), 6).alias("strength"))
