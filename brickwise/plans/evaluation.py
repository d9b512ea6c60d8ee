"""Queries that score a predicted body against bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwise.operators import evaluation, grid
from brickwise.plans.catalog import register
from brickwise.plans.faces import crest_of_sql, _d2, _near, face_rows, gradient_sql
from brickwise.sources.voxels import VOXELS_SQL

AXES = list(grid.AXES)
NEAR, TOLERANCE, LEAST = 3, 1, 3


def _within(rows: str, others: str) -> str:
    return f"SELECT DISTINCT a.z, a.y, a.x FROM {rows} a JOIN {others} b ON {_near('a', 'b', TOLERANCE)}"


def _way(name: str, rows: str, others: str) -> str:
    return f"SELECT '{name}' AS side, sqrt(min({_d2('a', 'b')})) AS d FROM {rows} a, {others} b GROUP BY a.z, a.y, a.x"


_SQL = f"""WITH RECURSIVE {VOXELS_SQL}, {gradient_sql()}, w AS (SELECT z, y, x, CASE WHEN s > 146 OR s < 110 THEN 1 ELSE 0 END AS band, s > 142 AS pred FROM f),
{crest_of_sql("all", (1, 1))},
nb AS (SELECT DISTINCT a.z, a.y, a.x, a.pred FROM w a JOIN w b ON b.band = 1 AND {_near("a", "b", NEAR)} WHERE {_d2("a", "b")} <= {NEAR**2}),
  pr AS (SELECT z, y, x FROM nb WHERE pred),
hits AS (SELECT (SELECT count(*) FROM ({_within("pr", "t_all")})) + (SELECT count(*) FROM ({_within("t_all", "pr")})) AS hit),
di AS ({_way("pred_to_band", "pr", "t_all")} UNION ALL {_way("band_to_pred", "t_all", "pr")}), du AS (SELECT * FROM di UNION ALL SELECT 'symmetric', d
  FROM di)"""


@register("upstream_body", f"""{_SQL} SELECT (SELECT count(*) FROM nb) AS n_near, (SELECT count(*) FROM pr) AS n_pred, (SELECT count(*) FROM t_all) AS n_band,
  round(hit / ((SELECT count(*) FROM pr) + (SELECT count(*) FROM t_all)), 6) AS dice FROM hits""")
def upstream_body(spark: SparkSession, folder: str) -> DataFrame:
    """How far a predicted body and the crest of the bands meet within a voxel, near the bands."""
    return _passed(spark, folder)[0].withColumn("dice", F.round("dice", 6))


@register("upstream_body_distances", f"""{_SQL} SELECT side, count(*) AS n, round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(quantile_cont(d,
  0.9), 6) AS p90,
  round(avg(CASE WHEN d > 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS frac_gt3, round(avg(CASE WHEN d > 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS frac_gt5 FROM du
  GROUP BY side""")
def upstream_body_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Distances between a predicted body and the crest of the bands, both ways and together."""
    found = _passed(spark, folder)[1]
    return found.select("side", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p90", "frac_gt3", "frac_gt5")])


def _passed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    s = F.col("smooth")
    rows = face_rows(spark, folder).select(*AXES, (s > 142).alias("pred"), ((s > 146) | (s < 110)).alias("band"))
    return evaluation.body_pass(rows, NEAR, TOLERANCE, LEAST)
